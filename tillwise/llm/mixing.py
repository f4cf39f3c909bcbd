"""Mixing sources to target weights along a curriculum that changes over training.

Each source has a schedule: its weight as a function of training time 0..1, linear between
knots. The integral of the schedule up to a time is the share of the source's words that
training has asked for by then. A source's documents follow one another in a fixed shuffled
order and start again when they are used up. The inverse of the integral, at the words that
lie before a document, is the document's training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.llm.common import SPACES, running_totals, set_aside
from tillwise.session import materialize

Knots = Sequence[tuple[float, float]]

# Relative weight over training, by weight class: light sources fade, heavy ones grow. Each
# has the mean 1, so the totals follow the weights alone.
CURRICULUM: dict[int, Knots] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (1.0, 1.5)),
}


def training_position(share: Column, weight: Column, curriculum: dict[int, Knots]) -> Column:
    """The time at which a source with ``weight`` has given ``share`` of its words."""
    position = None
    for cls, knots in curriculum.items():
        pieces, total = [], 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            pieces.append((t0, t1 - t0, a, b, total))
            total += (t1 - t0) * (a + b) / 2
        for t0, length, a, b, done in pieces:
            rest = share * total - done
            # Root of a*x + (b - a)*x*x / (2*length) = rest, in the form that has no cancellation.
            root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) * rest / length))
            time = F.when(rest <= 0, F.lit(t0)).otherwise(t0 + 2 * rest / (a + root))
            fits = (weight == cls) & (rest <= (a + b) / 2 * length * (1 + 1e-12))
            position = F.when(fits, time) if position is None else position.when(fits, time)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), position.otherwise(1.0)))


def source_targets(sizes: DataFrame, max_repeats: int, n_weights: int) -> DataFrame:
    """Per source its words, weight and target; ``sizes`` has source and size.

    Sources are numbered by code point (null last) and weigh 1..n_weights in turn. The target
    is the source's share of all words, at most ``max_repeats`` times its own; what a source
    can't give is shared out again by weight. All sums are whole numbers, so the level at
    which sources stop is found exactly: in order of words per weight, the first source that
    the level of the rest doesn't fill.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull().asc(), F.col("source").asc()]
    numbered = running_totals(sources, by_name, "sources", number=F.lit(1).cast("long"))
    weighed = numbered.withColumn("weight", F.col("number") % n_weights + 1).drop("number")
    scale = 1
    for k in range(2, n_weights + 1):
        scale *= k
    fill = (F.col("source_size") * scale / F.col("weight")).cast("long")
    ordered = running_totals(
        weighed.withColumn("fill", fill), [F.col("fill"), *by_name], "fills",
        size_before=F.col("source_size"), weight_before=F.col("weight"),
    )
    ordered = materialize(ordered, "ordered")
    all_words, all_weight = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    if not all_words:
        return ordered.select("source", "source_size", "weight", F.lit(0.0).alias("target"))
    # words of the rest / weight of the rest <= max_repeats * source_size / weight
    rest_words = F.lit(all_words) - max_repeats * F.col("size_before")
    rest_weight = F.lit(all_weight) - F.col("weight_before")
    open_ = rest_words * F.col("weight") <= max_repeats * F.col("source_size") * rest_weight
    level = ordered.where(open_).agg(F.min(F.struct("weight_before", "size_before")).alias("x"))
    weight_before, size_before = level.select("x.*").first()
    left = float(all_words - max_repeats * size_before)
    share = F.col("weight") * F.lit(left) / F.lit(float(all_weight - weight_before))
    target = F.least((max_repeats * F.col("source_size")).cast("double"), share)
    return ordered.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    documents: DataFrame, max_repeats: int = 3, curriculum: dict[int, Knots] | None = None
) -> DataFrame:
    """Per document: source, size, source_size, target, taken and position.

    ``taken`` counts the words that the mix takes of the document, repeats included: whole
    rounds of its source, then the first words of a last round up to the target. So a
    source's words meet its target to a word, and no document exceeds ``max_repeats`` times
    its size. ``position`` is where training first meets the document (1.0 if never).

    The order inside a source is by MD5 of the id; then id and size, so that reruns agree.
    Null text has size 0; null ids come first in their source; null sources form one source.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    curriculum = curriculum or CURRICULUM
    sized = documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACES)), F.lit(0)).cast("long").alias("size")
    )
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized, max_repeats, len(curriculum)), "targets")
    order = [F.col("source"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"), F.col("size")]
    placed = running_totals(sized, order, "placed", before=F.col("size"))
    # Sources follow one another in the same order, so a source begins where those before end.
    begins = running_totals(targets, [F.col("source")], "begins", begin=F.col("source_size"))
    begins = begins.withColumnRenamed("source", "of_source")
    rows = placed.join(begins, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    before, size, whole = F.col("before") - F.col("begin"), F.col("size"), F.col("source_size")
    words = F.floor("target")
    rounds = F.when(whole > 0, F.floor(words / F.greatest(whole, F.lit(1)))).otherwise(0)
    last = F.greatest(F.lit(0), F.least(size, words - rounds * whole - before))
    share = F.when(F.col("target") > 0, before / F.col("target")).otherwise(1.0)
    position = F.when(
        rounds * size + last > 0, training_position(share, F.col("weight"), curriculum)
    ).otherwise(1.0)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (rounds * size + last).cast("long").alias("taken"), position.alias("position"),
    )


def curriculum_order(mixed: DataFrame) -> DataFrame:
    """The documents of a mix range-sorted by training position."""
    return mixed.orderBy("position", "source", "doc_id")


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with their own columns.

    A document that is taken more than once gives a row for each time. The last time may be
    in part: then its text is cut after the words taken. Rows that share id, source and size
    are treated alike, as the one of them that the mix takes most of. Columns may have any names.
    """
    documents, named_back = set_aside(documents, "doc_id", "source", "text")
    columns = documents.columns
    mixed = mix_sources(documents, **options)
    plan = mixed.where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max("taken").alias("_taken"))
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size")], "_taken")
    words = F.regexp_count("text", F.lit(SPACES)).cast("long")
    rows = documents.withColumn("_words", words).join(
        plan,
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_words") == F.col("_size")),
    )
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    copies = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    part = F.col("_taken") - (F.col("_time") - 1) * F.col("_size")
    words_kept = F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*" + SPACES), F.lit(0)), F.lit(1), F.col("_part").cast("int"))
    cut = F.array_join(words_kept, "")
    copies = copies.withColumn("_part", F.least(F.col("_size"), part))
    text = F.when(F.col("_part") < F.col("_size"), cut).otherwise(F.col("text"))
    return named_back(copies.withColumn("text", text).select(*columns))
