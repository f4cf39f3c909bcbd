"""Benchmark decontamination: test phrases looked up in an FM-index of each training shard.

A shard is a run of documents of one task. Its index holds the stretches of words that could
hold a test phrase at all: words of the benchmark, at least as many in a row as the shortest
phrase. Nothing else can match, so nothing is lost. Phrases are searched backwards, all at
once; their places mark removal spans, which are merged where they touch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillwise.llm.common import LOWER, giving_back, set_aside, small_batches, texts
from tillwise.llm.fm_index import FmIndex
from tillwise.session import materialize

# Digits, letters and all bytes beyond ASCII make words; A-Z as a-z.
WORD_BYTES = bytes(
    b if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20 for b in LOWER
)
WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SHARD_WORDS = 1 << 19
SHARD_DOCUMENTS = 20_000

RESULT = T.StructType(
    [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Phrases:
    """The windows of a block of items, as numbers of words, grouped by length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        known: dict[tuple, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        owners: list[tuple[int, int]] = []
        for item_id, words in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(window, len(numbers))
            for i in range(len(numbers) - length + 1) if length else ():
                phrase = known.setdefault(tuple(numbers[i : i + length]), len(known))
                if item_id is not None:
                    owners.append((phrase, number[item_id]))
        self.shortest = min(map(len, known), default=0)
        self.groups = []
        for length in sorted({len(p) for p in known}):
            same = [p for p in known if len(p) == length]
            self.groups.append((length, np.array([known[p] for p in same]), np.array(same)))
        pairs = np.array(sorted(set(owners)), np.int64).reshape(-1, 2)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(known) + 1))
        self.owner = pairs[:, 1]


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.runs: list[np.ndarray] = []
        self.run_document: list[int] = []
        self.run_start: list[int] = []
        self.n_words: list[int] = []
        self.size = 0
        shortest = phrases.shortest
        self.pattern = re.compile(b"\x01{%d,}" % shortest) if shortest else None

    def add(self, text: bytes) -> None:
        words = words_of(text)
        vocabulary = self.phrases.vocabulary
        if self.pattern:
            for m in self.pattern.finditer(bytes(map(vocabulary.__contains__, words))):
                run = [vocabulary[w] for w in words[m.start() : m.end()]]
                self.runs.append(np.array([*run, 0], np.int64))
                self.run_document.append(len(self.n_words))
                self.run_start.append(m.start())
                self.size += len(run) + 1
        self.n_words.append(len(words))

    def hits(self) -> tuple[list[list[dict]], list[list[str]]]:
        """Per document its merged spans of hit words and the items found."""
        n = len(self.n_words)
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        if not self.runs:
            return spans, items
        symbols = np.concatenate(self.runs)
        begins = np.concatenate([[0], np.cumsum([len(r) for r in self.runs])[:-1]])
        index = FmIndex(symbols, len(self.phrases.vocabulary) + 1)
        document, start = np.array(self.run_document), np.array(self.run_start)
        cover, pairs = np.zeros(len(symbols) + 1, np.int64), []
        for length, numbers, rows in self.phrases.groups:
            low, high = index.search(rows)
            many = high - low
            total = int(many.sum())
            if not total:
                continue
            phrase = np.repeat(numbers, many)
            places = index.locate(np.arange(total) + np.repeat(low - np.cumsum(many) + many, many))
            np.add.at(cover, places, 1)
            np.add.at(cover, places + length, -1)
            run = np.searchsorted(begins, places, "right") - 1
            pairs.append(np.unique(np.stack([document[run], phrase], 1), axis=0))
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        first, last = edges[::2], edges[1::2]
        run = np.searchsorted(begins, first, "right") - 1
        shift = start[run] - begins[run]
        for d, a, b in zip(document[run].tolist(), (first + shift).tolist(), (last + shift).tolist()):
            spans[d].append({"start": a, "end": b})
        if pairs:
            found = np.concatenate(pairs)
            at = self.phrases.owner_start
            many = at[found[:, 1] + 1] - at[found[:, 1]]
            owner = np.arange(int(many.sum())) + np.repeat(at[found[:, 1]] - np.cumsum(many) + many, many)
            both = np.unique(np.stack([np.repeat(found[:, 0], many), self.phrases.owner[owner]], 1), axis=0)
            for d, item in both.tolist():
                items[d].append(self.phrases.ids[item])
        return spans, items


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order, those that overlap or touch made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _scan(documents: DataFrame, phrases: Phrases) -> DataFrame:
    """One pass over the documents; adds to what an earlier pass has found."""
    names = [c for c in documents.columns if c not in ("_found_spans", "_found_items")]
    again = "_found_spans" in documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(phrases)
    schema = T.StructType([*documents.select(*[f"`{c}`" for c in names]).schema.fields, *RESULT.fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            begin, shard = 0, Shard(shared.value)
            values = texts(batch)
            for row in range(batch.num_rows):
                shard.add(next(values))
                full = shard.size >= SHARD_WORDS or len(shard.n_words) >= SHARD_DOCUMENTS
                if not full and row + 1 < batch.num_rows:
                    continue
                spans, items = shard.hits()
                part = batch.slice(begin, row + 1 - begin)
                if again:
                    for k, (s, i) in enumerate(zip(part.column("_found_spans").to_pylist(), part.column("_found_items").to_pylist())):
                        spans[k], items[k] = merged([*spans[k], *s]), sorted({*items[k], *i})
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in names],
                        pa.array(shard.n_words, pa.int64()),
                        pa.array(spans, result_type),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*names, "_n_words", "_spans", "_items"],
                )
                begin, shard = row + 1, Shard(shared.value)

    return small_batches(documents).mapInArrow(giving_back(search), schema)


def find_benchmark_spans(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000
) -> DataFrame:
    """The documents' columns with ``_n_words``, ``_spans`` and ``_items``.

    ``_spans``: merged word ranges inside any occurrence of a window; ``_items``: ids of the
    items that have one. A window is ``window`` consecutive words of an item, or all
    words of a shorter one. The benchmark goes to all tasks in blocks of about ``block_words``
    words, one pass over the documents for each. A pass is written before the next one begins, so
    a task holds the phrases of one block, whatever the size of the benchmark.

    Null text has no words; an item without words has no window; an item without an id marks
    words but is not listed; repeated items count once. Empty tables find nothing. Ids may be of
    any type. Columns of the input that have the results' names are replaced.
    """
    kind = dict(benchmark.dtypes)["item_id"]
    documents, named_back = set_aside(documents.drop(*RESULT.names), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates()
    n_words = F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD_PATTERN)), F.lit(0))
    items = materialize(items.withColumn("_w", n_words), "items")
    total = items.agg(F.sum("_w")).first()[0]
    n_blocks = max(1, -(-(total or 0) // block_words))
    found = documents
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        rows = [(r.item_id, words_of((r.text or "").encode())) for r in mine.toLocalIterator()]
        if block:
            found = materialize(found, "pass").withColumnsRenamed({"_spans": "_found_spans", "_items": "_found_items"}).drop("_n_words")
        found = _scan(found, Phrases(rows, window))
    found = found.withColumn("_items", F.array_sort(F.col("_items").cast(f"array<{kind}>")))
    return named_back(found, *RESULT.names)


def is_contaminated(n_hit, n_words, part: int = 20):
    """A document is contaminated if hits are at least one ``part``-th of its words."""
    return (n_hit > 0) & (part * n_hit >= n_words)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, unchanged; columns may have any names."""
    rows, named_back = set_aside(documents, "text")
    found = find_benchmark_spans(rows, benchmark, window)
    bad = is_contaminated(hit_words(F.col("_spans")), F.col("_n_words"))
    return named_back(found.where(~bad))
