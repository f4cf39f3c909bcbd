"""Repeated passages across documents, by seed and extend.

Seeds are winnowed anchors: of nine neighbouring five-word runs the one with the smallest
hash. Thirteen words hold nine such runs, so a passage of thirteen words has the same anchor
wherever it stands. Windows in a row that share their anchor form one stretch around it, and
documents are joined on anchors. A stretch brings its name along, a hash of all its words.

Stretches with one anchor and one name are the same words, so all but those of the smallest
document are repeats as they stand; this settles the inside of every passage. Where names
differ, at the ends of passages and in near copies, matches are extended: the windows of these
stretches, which lie over the anchor in every way to the left and to the right, are compared
one by one. Windows found in a smaller document join to maximal repeats.

No pairs of documents are made: a passage in m documents costs m rows. Equal stretches inside
one batch are settled there, so that a passage of very many documents gives a row per batch.
Rows meet in order, and what a task holds of an open anchor are the rows of one document. An
anchor with so many rows that it alone would be a task's work is found by a count beforehand;
its windows meet one by one, by anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillwise.llm.common import giving_back, small_batches, texts
from tillwise.session import materialize

SPAN = 13
SEED = 5
FLUSH_BYTES = 8_000_000
#: An anchor of more stretches is dealt out by window.
HOT_ROWS = 20_000
#: Anchors that a task counts at once.
COUNTED = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of sums so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = len(h) - width + 1
    total = h[:n].copy()
    for k in range(1, width):
        total *= np.uint64(factor)
        total += h[k : n + k]
    return _mix(total)


def _ranges(document: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges that follow one another in a document made one; they come in order."""
    if not len(start):
        return document, start, count
    fresh = np.concatenate([[True], (document[1:] != document[:-1]) | (start[1:] != start[:-1] + count[:-1])])
    at = np.flatnonzero(fresh)
    return document[at], start[at], np.add.reduceat(count, at)


def _seeds(h: np.ndarray) -> np.ndarray:
    return _rolled(h, SEED, 0x9DDFEA08EB382D69)


def _windows(h: np.ndarray) -> np.ndarray:
    return _rolled(h, SPAN, 0xC2B2AE3D27D4EB4F)


def _own(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A key for each window of an anchor."""
    return _mix(anchor ^ _mix(window))


def stretches(doc_ids: np.ndarray, hashes: list[np.ndarray], hot: np.ndarray | None = None) -> tuple[tuple, tuple]:
    """Stretches to compare elsewhere, and ranges of windows settled here.

    The first: anchor, name, doc, start, windows; the second: doc, start, windows. Where equal
    stretches are in documents with different ids, all but those of the smallest id are settled.
    A window of an anchor in ``hot`` is a stretch of its own, with an anchor of its own. Names
    tell the words of stretches of up to thirteen windows.
    """
    lengths = np.array([len(h) for h in hashes])
    h = np.concatenate(hashes)
    none = np.zeros(0, np.int64)
    if len(h) < SPAN:
        return (none, none, none, none, none), (none, none, none)
    seeds = _seeds(h)
    low = seeds
    for step in (1, 2, 4):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(h) - SPAN + 1], seeds[8 : 8 + len(h) - SPAN + 1])
    window = _windows(h)
    of = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    inside = of[: len(window)] == of[SPAN - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (none, none, none, none, none), (none, none, none)
    fresh = np.concatenate([[True], (low[at[1:]] != low[at[:-1]]) | (of[at[1:]] != of[at[:-1]])])
    alone = np.isin(low[at].view(np.int64), hot) if hot is not None and len(hot) else np.zeros(len(at), bool)
    first = np.flatnonzero(fresh | alone)
    count = np.diff(np.append(first, len(at)))
    place = at[first]
    anchor, document = low[place], doc_ids[of[place]]
    anchor = np.where(alone[first], _own(anchor, window[place]), anchor)
    start = place - begin[of[place]]
    # Both ends name a stretch whose windows leave no word between them.
    name = _own(anchor, window[place]) + _mix(window[place + count - 1] + count.astype(np.uint64))
    order = np.lexsort((document, name))
    same = np.concatenate([[False], name[order][1:] == name[order][:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    settled = np.zeros(len(order), bool)
    settled[order] = document[order] > document[order][head]
    settled &= count <= SPAN
    sent = np.flatnonzero(~settled)
    out = (anchor[sent].view(np.int64), name[sent].view(np.int64), document[sent], start[sent], count[sent])
    done = np.flatnonzero(settled)
    # Ranges of one row only: two rows may carry the same id.
    rows, starts, counts = _ranges(of[place[done]], start[done], count[done])
    return out, (doc_ids[rows], starts, counts)


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


SCHEMA = "key long, name long, doc long, start int, n int"
RANGES = "doc long, start int, n int"


def _cut_up(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[tuple[tuple, tuple]]:
    """The stretches of some megabytes of text at a time."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        values, hashes, size, begin = texts(batch), [], 0, 0
        for k in range(batch.num_rows):
            text = next(values)
            hashes.append(_word_hashes(text))
            size += len(text)
            if size < FLUSH_BYTES and k + 1 < batch.num_rows:
                continue
            yield stretches(ids[begin : k + 1], hashes, hot)
            hashes, size, begin = [], 0, k + 1


COUNTS = "key long, n long, missed long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, missed): a task's common anchors by Misra and Gries, and its totals without a key.

    No more than ``COUNTED`` anchors are held. What pushes others out is taken from all, so
    a count is at most ``missed`` short.
    """
    key, n, missed, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    for (found, *_), _ in _cut_up(batches):
        total += len(found)
        key, at = np.unique(np.concatenate([key, found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(len(found), np.int64)]), len(key)).astype(np.int64)
        over = int(np.partition(n, -COUNTED - 1)[-COUNTED - 1]) if len(key) > COUNTED else 0
        missed += over
        key, n = key[n > over], n[n > over] - over
    # Of the rest, what is rare in the task is not worth a row.
    over = total // COUNTED + 1
    key, n = key[n > over], n[n > over] - over
    columns = [[None, *key.tolist()], [total, *n.tolist()], [missed + over, *[0] * len(key)]]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "n", "missed"])


def common_anchors(known: DataFrame) -> np.ndarray:
    """Anchors of so many stretches that they would make a task long: their windows meet one by one.

    All of more than ``HOT_ROWS`` are found, or of more than a few times a ``COUNTED``-th of all
    stretches, if that is more. The latter is less than an even share of a task in any cluster of
    fewer tasks, and memory does not depend on the bound: rows of an anchor pass through a task
    in order, and only those of one document wait.
    """
    counts = known.mapInArrow(giving_back(_count), COUNTS).groupBy("key").agg(F.sum("n").alias("n"), F.sum("missed").alias("missed"))
    # No more than ``COUNTED`` anchors can pass the bound below.
    rows = counts.where((F.col("n") >= HOT_ROWS // 2) | F.col("key").isNull()).orderBy(F.desc("n")).limit(COUNTED + 1).collect()
    total, missed = next(((r.n, r.missed) for r in rows if r.key is None), (0, 0))
    bound = max(HOT_ROWS, 2 * missed, 2 * total // COUNTED)
    return np.array(sorted(r.key for r in rows if r.key is not None and r.n >= bound - missed), np.int64)


def _send(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Stretches, and ranges that are settled, which have no name and go anywhere."""
    for (key, name, doc, start, n), done in _cut_up(batches, hot):
        spread = _mix(done[0].astype(np.uint64) * np.uint64(31) + done[1].astype(np.uint64)).view(np.int64)
        columns = [np.concatenate(x) for x in zip((key, doc, start, n), (spread, *done))]
        key, doc, start, n = (pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32())))
        names = pa.concat_arrays([pa.array(name, pa.int64()), pa.nulls(len(spread), pa.int64())])
        yield pa.RecordBatch.from_arrays([key, names, doc, start, n], names=["key", "name", "doc", "start", "n"])


#: Rows that have met: repeats, and with a key the stretches that are still to be extended.
MET = "doc long, start int, n int, key long"


class _Meeting:
    """Stretches in order of anchor, name and document.

    Gives repeats, and of anchors that several documents hold under several names the stretches
    that no equal one of a smaller document settles. Of the anchor still open only rows of one
    document wait: once there are two documents and two names, rows are given at once.
    """

    def __init__(self) -> None:
        # The open anchor: key, newest name, that name's first document, the anchor's first
        # document and name, and whether it has others of these.
        self.open: tuple[int, int, int, int, int, bool, bool] | None = None
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def meet(self, key: np.ndarray, name: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
        """(doc, start, n, key or None) of the next rows; the newest anchor stays open."""
        carried = self.open is not None and key[0] == self.open[0]
        fresh = np.concatenate([[not carried], key[1:] != key[:-1]])
        other = fresh | np.concatenate([[not carried or name[0] != self.open[1]], name[1:] != name[:-1]])
        # The first document of each name, and the first document and name of each anchor.
        least = self._first(other, doc, self.open[2] if carried else None)
        first_doc = self._first(fresh, doc, self.open[3] if carried else None)
        first_name = self._first(fresh, name, self.open[4] if carried else None)
        repeat = (doc > least) & (n <= SPAN)
        out = [(doc[repeat], start[repeat], n[repeat], None)]

        begin = np.flatnonzero(np.concatenate([[True], fresh[1:]]))
        docs = np.logical_or.reduceat(doc != first_doc, begin)
        names = np.logical_or.reduceat((name != first_name) | (n > SPAN), begin)
        if carried:
            docs[0] |= self.open[5]
            names[0] |= self.open[6]
        group = np.cumsum(np.concatenate([[True], fresh[1:]])) - 1
        wanted = ~repeat
        if self.waiting:
            if carried and docs[0] and names[0]:
                out += [(d, s, c, k) for k, d, s, c in self.waiting]
            if not carried or docs[0] and names[0] or len(begin) > 1:
                self.waiting = []
        give = wanted & (docs & names)[group]
        out.append((doc[give], start[give], n[give], key[give]))
        self.open = (int(key[-1]), int(name[-1]), int(least[-1]), int(first_doc[-1]), int(first_name[-1]), bool(docs[-1]), bool(names[-1]))
        if not (docs[-1] and names[-1]):
            keep = wanted & (group == group[-1])
            self.waiting.append((key[keep], doc[keep], start[keep], n[keep]))
        return out

    @staticmethod
    def _first(fresh: np.ndarray, values: np.ndarray, before: int | None) -> np.ndarray:
        """Of each row the value its group begins with; the first group may have begun before."""
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(values)), 0))
        out = values[head]
        if not fresh[0]:
            out = np.where(np.cumsum(fresh) == 0, before, out)
        return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    meeting = _Meeting()
    for batch in batches:
        settled = batch.column("name").is_null()
        done, rest = batch.filter(settled), batch.filter(pa.compute.invert(settled))
        found = [(*(done.column(c).to_numpy() for c in ("doc", "start", "n")), None)]
        if rest.num_rows:
            found += meeting.meet(*(rest.column(c).to_numpy() for c in ("key", "name", "doc", "start", "n")))
        columns = [np.concatenate([f[k] for f in found]) for k in range(3)]
        keys = pa.concat_arrays([pa.nulls(len(f[0]), pa.int64()) if f[3] is None else pa.array(f[3], pa.int64()) for f in found])
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*arrays, keys], names=["doc", "start", "n", "key"])


WINDOWS = "key long, doc long, start int, settled boolean"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the stretches wanted of each text, a key for each window.

    Of windows that several documents of a batch have, those of the smallest go on; the others
    are settled and go anywhere.
    """
    for batch in batches:
        keys, docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("_wanted")):
            window = _windows(_word_hashes(text))
            start, n, key = (wanted.values.field(c).to_numpy() for c in ("start", "n", "key"))
            n = n.astype(np.int64)
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            anchor = np.repeat(key.view(np.uint64), n)
            # Of rows that share an id one may be shorter than what was found in another.
            there = at < len(window)
            keys.append(_own(anchor[there], window[at[there]]).view(np.int64))
            docs.append(np.full(int(there.sum()), doc, np.int64))
            starts.append(at[there])
        key, doc, start = map(np.concatenate, (keys, docs, starts))
        order = np.lexsort((doc, key))
        key, doc, start = key[order], doc[order], start[order]
        if len(key):
            settled = doc > _Meeting._first(np.concatenate([[True], key[1:] != key[:-1]]), doc, None)
        else:
            settled = np.zeros(0, bool)
        spread = _mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)).view(np.int64)
        columns = (np.where(settled, spread, key), doc, start, settled)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "doc", "start", "settled"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows in order of key and document those that a smaller document has as well."""
    last_key, first = None, 0
    for batch in batches:
        key, doc, start, settled = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "start", "settled"))
        gone = settled.copy()
        rest = np.flatnonzero(~settled)
        if len(rest):
            mine, docs = key[rest], doc[rest]
            fresh = np.concatenate([[last_key is None or mine[0] != last_key], mine[1:] != mine[:-1]])
            least = _Meeting._first(fresh, docs, first)
            last_key, first = int(mine[-1]), int(least[-1])
            gone[rest] = docs > least
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[gone], pa.int64()), pa.array(start[gone], pa.int32()), pa.array(np.ones(int(gone.sum())), pa.int32())],
            names=["doc", "start", "n"],
        )


def repeated_windows(known: DataFrame) -> DataFrame:
    """(doc, start, n): runs of windows that also start in a document with a smaller id.

    ``known`` has a number ``doc_id`` and the bytes ``text``.
    """
    sent = known.mapInArrow(giving_back(partial(_send, hot=common_anchors(known))), SCHEMA)
    ordered = sent.repartition("key").sortWithinPartitions("key", "name", "doc")
    met = materialize(ordered.mapInArrow(giving_back(_meet), MET), "met")
    open_ = met.where("key IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "key")).alias("_wanted"))
    wanted = known.join(open_, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "_wanted")
    windows = small_batches(wanted).mapInArrow(giving_back(_extend), WINDOWS)
    more = windows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(giving_back(_repeats), RANGES)
    return met.where("key IS NULL").select("doc", "start", "n").union(more)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, kept = [], [], []
        for text, found in zip(texts(batch), batch.column("_ranges").to_pylist()):
            words = text.split()
            mine: list[list[int]] = []
            for start, n in sorted((f["start"], f["n"]) for f in found or ()):
                if mine and start <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], start + n + SPAN - 1)
                else:
                    mine.append([start, start + n + SPAN - 1])
            n_words.append(len(words))
            for start, end in reversed(mine):
                del words[start:end]
            spans.append([{"start": a, "end": b} for a, b in mine])
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(kept, pa.string()),
            ],
            names=["doc_id", "n_words", "spans", "kept"],
        )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans (maximal repeats, as word ranges) and kept text.

    A word is removed if a window of thirteen words that covers it also starts in a document
    with a smaller id; the kept words are joined by one space. Null text has no words. A row
    without an id neither removes nor loses words. Identical rows are one document; of rows
    that share an id but not a text, all lose the word places that one of them loses.
    """
    kind = dict(documents.select("doc_id").dtypes)["doc_id"]
    # A cast that does nothing would keep Spark from seeing that both joins read the same shuffle.
    number = F.col("doc_id") if kind == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = documents.select(number, F.col("text").cast("binary").alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    ranges = repeated_windows(known).groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_list(F.struct("start", "n")).alias("_ranges")
    )
    # Both joins of the texts are by document, so the texts are shuffled once.
    joined = known.join(ranges, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "_ranges")
    # Rows without an id lose nothing and are not dealt out by it.
    none = F.lit(None).cast(joined.schema["_ranges"].dataType).alias("_ranges")
    unknown = rows.where("doc_id IS NULL").select("doc_id", "text", none)
    schema = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string"
    cut = small_batches(joined.union(unknown)).mapInArrow(giving_back(_cut), schema)
    return cut.withColumn("doc_id", F.col("doc_id").cast(kind))
