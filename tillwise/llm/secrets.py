"""Secrets in texts: fixed patterns, and strings that look random.

Strings beyond the patterns are judged by two Markov models of characters: one of random
strings, one of ordinary identifiers, both learnt from labelled samples. A string is a span if
the ratio of its likelihoods is large enough. All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.llm.common import drawn

# The kinds in their order, their patterns, and the least length of the part
# that decides whether a match counts (group 2 of an assignment, else the match).
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (
        "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\\x20*[:=]\\x20*[\"']?"
        "([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
#: The scan of a kind whose short matches can be left out at once, as a match is a whole run.
RUNS = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
RANDOM = "random"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STRINGS = "[A-Za-z0-9+/_=-]{%d,}"
LEAST_LENGTH = 20
LEAST_RATIO = 15.0
TRAIN_DOCUMENTS = 4_000
BACK_OFF = 10

SPAN = "array<struct<start:int,kind:int,end:int>>"
MATCHES = "array<struct<start:int,kind:int,end:int,match:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _scan(array: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An array of what ``step`` says of the elements in turn, with a state that goes along.

    ``step`` takes the state and an element and returns (state, says), ``says`` a text without
    commas. Texts grow by copying, so the array is cut into about as many parts as each has
    elements: n elements take n times its root of copied bytes, not n times n.
    """

    def one(so_far: Column, x: Column) -> Column:
        said = lambda r: F.concat(so_far["out"], F.lit(","), r["says"]).alias("out")
        return _let(step(so_far["state"], x), lambda r: F.struct(r["state"].alias("state"), said(r)))

    def part(so_far: Column, elements: Column) -> Column:
        begin = F.struct(so_far["state"].alias("state"), F.lit("").alias("out"))
        joined = lambda d: F.concat(so_far["out"], d["out"]).alias("out")
        return _let(F.aggregate(elements, begin, one), lambda d: F.struct(d["state"].alias("state"), joined(d)))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array)))).cast("int")
    cuts = F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1)
    parts = _let(size, lambda n: F.transform(cuts, lambda k: F.slice(array, k * n + 1, n)))
    said = F.aggregate(parts, F.struct(zero.alias("state"), F.lit("").alias("out")), part, lambda s: s["out"])
    none = F.array().cast("array<string>")
    return F.when(F.size(array) > 0, F.split(F.substring(said, 2, (1 << 31) - 1), ",")).otherwise(none)


def _places(text: Column, pattern: str, group: int, least: int, kind: int, with_match: bool = False) -> Column:
    """Spans of a pattern's matches: what lies between matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pieces = F.arrays_zip(
        F.transform(between, F.length).alias("gap"), F.transform(matches, F.length).alias("length"),
        F.transform(values, F.length).alias("value"), *([matches.alias("match")] if with_match else []),
    )

    def step(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct((start + x["length"]).alias("state"), start.cast("string").alias("says"))

    def spans(p: Column) -> Column:
        placed = F.arrays_zip(p.alias("p"), _scan(p, F.lit(0), step).alias("start"))
        counted = F.filter(placed, lambda x: x["p"]["value"] >= least)

        def span(x: Column) -> Column:
            start = x["start"].cast("int")
            match = [x["p"]["match"].alias("match")] if with_match else []
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["p"]["length"]).alias("end"), *match)

        return F.transform(counted, span)

    return F.when(text.rlike(pattern), _let(pieces, spans)).otherwise(F.array().cast(MATCHES if with_match else SPAN))


def _apart(runs: Column, spans: Column) -> Column:
    """Of ``runs``, which don't overlap each other, those that overlap none of ``spans``.

    Both go by in order of their start. What becomes of a run is said when the next one comes,
    as a span may still begin inside of it; how far the spans so far reach goes along.
    """
    place = lambda x, is_run: F.struct(x["start"].alias("start"), F.lit(is_run).alias("is_run"), x["end"].alias("end"))
    beyond = F.lit((1 << 31) - 1)
    last = F.array(F.struct(beyond.alias("start"), F.lit(True).alias("is_run"), beyond.alias("end")))
    everything = F.array_sort(F.concat(F.transform(spans, lambda x: place(x, False)), F.transform(runs, lambda x: place(x, True)), last))
    # ``free``: the end of the run that waits, 0 once a span has met it, -1 before the first run.

    def step(state: Column, x: Column) -> Column:
        free, reach = state["free"], state["reach"]
        after = F.when(
            x["is_run"],
            F.struct(F.when(reach <= x["start"], x["end"]).otherwise(0).alias("free"), reach.alias("reach")),
        ).otherwise(
            F.struct(F.when(free > x["start"], F.lit(0)).otherwise(free).alias("free"), F.greatest(reach, x["end"]).alias("reach"))
        )
        says = F.when(~x["is_run"] | (free < 0), "").when(free > 0, "1").otherwise("0")
        return F.struct(after.alias("state"), says.alias("says"))

    zero = F.struct(F.lit(-1).alias("free"), F.lit(0).alias("reach"))
    said = _let(everything, lambda e: F.filter(_scan(e, zero, step), lambda t: t != ""))
    kept = F.filter(F.arrays_zip(runs.alias("run"), said.alias("said")), lambda x: x["said"] == "1")
    return F.when(F.size(runs) > 0, F.transform(kept, lambda x: x["run"])).otherwise(F.array().cast(MATCHES))


def base_spans(text: Column) -> Column:
    """Leftmost spans of each kind that don't overlap others of the kind; nulls have none."""
    parts = []
    for k, kind in enumerate(KINDS):
        pattern, group, least = PATTERNS[kind]
        parts.append(_places(F.coalesce(text, F.lit("")), RUNS.get(kind, pattern), group, least, k))
    return F.array_sort(F.concat(*parts))


@dataclass
class Markov:
    """Per pair of characters the logarithm of random over ordinary; [n * a + b]."""

    ratios: list[float]

    def score(self, string: Column) -> Column:
        """The sum over a string's neighbouring characters; it takes each character once."""
        n = len(ALPHABET)
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        # Characters are single bytes, so a table by their codes finds their number.
        numbers = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
        codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), lambda c: F.get(numbers, F.ascii(c)))
        step = lambda s, c: F.struct(
            c.alias("last"), (s["sum"] + F.when(s["last"].isNull(), 0.0).otherwise(F.get(table, s["last"] * n + c))).alias("sum")
        )
        zero = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
        return F.aggregate(codes, zero, step, lambda s: s["sum"])


def fit(samples: DataFrame) -> Markov:
    """Models from labelled samples (string, random).

    A character's chances after a rare one lean on its chances overall, as if seen
    ``BACK_OFF`` times; overall counts have one added.


    What reaches the driver is a count per pair of characters and label, whatever the number
    of samples. Null strings, null labels and characters beyond the alphabet are left out.
    """
    n = len(ALPHABET)
    string = F.col("string")
    pair = F.transform(F.sequence(F.lit(1), F.length(string) - 1), lambda i: F.substr(string, i, F.lit(2)))
    long = samples.where("string IS NOT NULL AND random IS NOT NULL AND length(string) > 1")
    counts = long.select("random", F.explode(pair).alias("pair")).groupBy("random", "pair").count()
    inside = counts.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    logs = []
    for label in (True, False):
        table = [[0.0] * n for _ in range(n)]
        for r in inside.where(F.col("random") == label).collect():
            table[ALPHABET.index(r.pair[0])][ALPHABET.index(r.pair[1])] += r["count"]
        single = [1 + sum(column) for column in zip(*table)]
        alone = [c / sum(single) for c in single]
        logs.append([[math.log((c + BACK_OFF * p) / (sum(row) + BACK_OFF)) for c, p in zip(row, alone)] for row in table])
    return Markov([a - b for x, y in zip(*logs) for a, b in zip(x, y)])


def labelled_samples(documents: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Samples (string, random): the values of pattern matches, and ordinary words.

    They come from about ``limit`` documents, which is the bound of the training sample: those
    with the smallest hashes. The bound on hashes is a share of 62 bits, so it holds for any
    number of documents.
    """
    n = documents.where("text IS NOT NULL").count()
    some = documents.where(F.col("text").isNotNull() & drawn(min(1.0, limit / max(1, n)), "doc_id", "text")).select("text")
    found = []
    for kind in KINDS:
        pattern, group, least = PATTERNS[kind]
        values = F.regexp_extract_all("text", F.lit(RUNS.get(kind, pattern)), F.lit(group))
        found.append(F.filter(values, lambda v, least=least: F.length(v) >= least))
    secrets = some.select(F.explode(F.concat(*found)).alias("string"), F.lit(True).alias("random"))
    # Words without what the patterns find.
    rest = F.col("text")
    for kind in KINDS:
        rest = F.regexp_replace(rest, RUNS.get(kind, PATTERNS[kind][0]), " ")
    words = F.regexp_extract_all(rest, F.lit("[A-Za-z_-]{4,}"), F.lit(0))
    ordinary = some.select(F.explode(words).alias("string"), F.lit(False).alias("random"))
    return secrets.union(ordinary)


def find_secrets(
    documents: DataFrame, model: Markov, least_length: int = LEAST_LENGTH, least_ratio: float = LEAST_RATIO
) -> DataFrame:
    """The documents' columns with ``_base`` and ``_spans``: arrays of (start, kind, end).

    ``kind`` is a place in ``KINDS``; ``len(KINDS)`` marks strings that only the models found.
    Those are runs of ``least_length`` characters or more that touch no other span and whose
    log-likelihood ratio is at least ``least_ratio``. Places count code points. Null text is
    empty; rows are independent, so repeated rows get the same spans. Columns of the input that
    have the results' names are replaced. A text takes time in proportion to its length, but
    for matches, whose number counts to the power of one and a half.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.drop("_base", "_spans").withColumn("_base", base_spans(F.col("text")))
    runs = _places(text, STRINGS % least_length, 0, least_length, len(KINDS), with_match=True)
    alone = _let(runs, lambda r: _apart(r, F.col("_base")))
    random = F.filter(alone, lambda s: model.score(s["match"]) >= least_ratio)
    extra = F.transform(random, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", extra)))


def as_text(spans: str) -> Column:
    """``kind:start:end`` of each span, in order, with commas between."""
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
