"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile.

Only different fingerprints are compared. The 64 bits are six blocks; two fingerprints that
differ in at most four bits agree in at least two blocks, so each pair within the radius
shares one of fifteen keys of about 21 bits. That is exact, and it keeps the work far from
the square of the corpus. Fingerprints of one key form tiles in order of their population
count. Tile pairs whose counts differ by more than the radius are skipped, the others are
compared by exclusive-or and bit counts in numpy. A key with very many fingerprints has
tiles of its own for each population count, and the tile pairs are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillwise.llm.common import LOWER, giving_back, small_batches, texts
from tillwise.llm.components import components
from tillwise.session import materialize

RADIUS = 4
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
TILE = 16_384


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        slices = map(slice, starts[k : min(n, k + (1 << 15))].tolist(), ends[k : k + (1 << 15)].tolist())
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(seed)), np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, texts(batch)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    ids = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return small_batches(ids).mapInArrow(giving_back(compute), f"doc_id {dict(ids.dtypes)['doc_id']}, fp long")


def _block_keys(fp: str) -> F.Column:
    """The keys of a fingerprint: which two blocks, and their bits."""
    shifts = np.cumsum((0, *BLOCK_BITS[:-1])).tolist()
    blocks = [
        F.shiftrightunsigned(F.col(fp), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, BLOCK_BITS)
    ]
    pairs = combinations(range(len(BLOCK_BITS)), len(BLOCK_BITS) - RADIUS)
    return F.array(
        *[
            F.lit(k << 32).bitwiseOR(F.shiftleft(blocks[i].cast("long"), 11)).bitwiseOR(blocks[j])
            for k, (i, j) in enumerate(pairs)
        ]
    )


def tile_links(fps: np.ndarray, radius: int, rows: int = 64) -> list[tuple[int, int]]:
    """Links that join what is within ``radius`` of each other: a forest, not all pairs."""
    counts = np.bitwise_count(fps)
    order = np.lexsort((fps, counts))
    fps, counts = fps[order], counts[order]
    root = np.arange(len(fps))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    label = root.copy()
    for begin in range(0, len(fps), rows):
        mine = slice(begin, min(len(fps), begin + rows))
        last = np.searchsorted(counts, counts[mine.stop - 1] + radius, "right")
        theirs = slice(begin, last)
        near = np.bitwise_count(fps[mine, None] ^ fps[None, theirs]) <= radius
        near &= label[mine, None] != label[None, theirs]
        i, j = np.nonzero(near)
        if len(i):
            pairs = np.unique(np.stack([label[mine][i], label[theirs][j]], 1), axis=0)
            for a, b in pairs.tolist():
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
            label = np.array([top(x) for x in label.tolist()]) if len(fps) < 4096 else _settle(root)
            root = label.copy()
    smallest: dict[int, int] = {}
    for k, fp in zip(label.tolist(), fps.view(np.int64).tolist()):
        smallest[k] = min(fp, smallest.get(k, fp))
    return [(fp, smallest[k]) for k, fp in zip(label.tolist(), fps.view(np.int64).tolist()) if fp != smallest[k]]


def _settle(root: np.ndarray) -> np.ndarray:
    while True:
        onward = root[root]
        if np.array_equal(onward, root):
            return root
        root = onward


def key_links(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 48) -> list[tuple[int, int]]:
    """Links inside each key; ``keys`` is sorted and holds whole keys."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begins, len(keys)))
    links = []
    # Short tiles all at once: each row against the k-th row after it.
    few = np.repeat(sizes <= small, sizes)
    keys_few, fps_few = keys[few], fps[few]
    for k in range(1, min(small, int(sizes[sizes <= small].max(initial=1)))):
        near = (keys_few[k:] == keys_few[:-k]) & (np.bitwise_count(fps_few[k:] ^ fps_few[:-k]) <= radius)
        at = np.flatnonzero(near)
        links += zip(fps_few[at + k].view(np.int64).tolist(), fps_few[at].view(np.int64).tolist())
    for begin, size in zip(begins[sizes > small].tolist(), sizes[sizes > small].tolist()):
        links += tile_links(fps[begin : begin + size], radius)
    return links


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``radius``, over keys; may repeat."""
    if radius != RADIUS:
        raise ValueError(f"The block keys are made for a radius of {RADIUS}.")
    keyed = nodes.select("fp", F.explode(_block_keys("fp")).alias("key"))
    weights = keyed.groupBy("key", F.bit_count("fp").alias("ones")).count()
    weights = materialize(weights, "weights")
    large = weights.groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") > tile).select("key")
    pieces = weights.join(large, "key").groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile)))).alias("pieces")
    )  # at most 65 entries per key
    pieces = materialize(pieces, "pieces")
    plain, split = keyed, None
    if not pieces.isEmpty():
        plain = keyed.join(pieces, "key", "left_anti")
        split = _tile_pairs(keyed.join(pieces, "key"), radius)
    plain = plain.select("key", F.lit("").alias("pair"), "fp")
    dealt = plain if split is None else plain.union(split)
    dealt = dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_held = 0

        def out(part: list[tuple]) -> pa.RecordBatch:
            # Two parts of the sort key made one number, only its changes matter.
            key = np.concatenate([p[0] for p in part])
            pair = np.concatenate([p[1] for p in part])
            fps = np.concatenate([p[2] for p in part])
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            links = key_links(np.cumsum(fresh), fps, radius)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            key = batch.column("key").to_numpy()
            pair = np.array(batch.column("pair").to_pylist(), object)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = last[-1] + 1 if len(last) else 0
            same = bool(held) and key[0] == held[-1][0][-1] and pair[0] == held[-1][1][-1]
            if n_held >= 100_000 and not same:
                yield out(held)
                held, n_held = [], 0
            if cut and n_held + cut >= 100_000:
                yield out([*held, (key[:cut], pair[:cut], fps[:cut])])
                held, n_held = [(key[cut:], pair[cut:], fps[cut:])], len(key) - cut
            else:
                held.append((key, pair, fps))
                n_held += len(key)
        if held:
            yield out(held)

    return dealt.mapInArrow(compare, "a long, b long")


def _tile_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of large keys, once for each tile pair that can hold a link."""
    ones = F.bit_count("fp")
    tile = lambda o, p: F.format_string("%02d.%d", o, p)
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")[ones])
    mine = tile(ones, piece)
    near = F.filter(F.map_keys("pieces"), lambda o: F.abs(o - ones) <= radius)
    theirs = F.flatten(
        F.transform(near, lambda o: F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces")[o] - 1), lambda p: tile(o, p)))
    )
    pair = F.transform(theirs, lambda t: F.concat_ws("-", F.least(t, mine), F.greatest(t, mine)))
    return rows.select("key", F.explode(pair).alias("pair"), "fp")


def near_duplicates(documents: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints within four bits are linked.

    ``component_id`` is the smallest doc_id reachable over links, itself included. Null text
    and text without words have the fingerprint zero, which links like any other. Repeated
    rows and rows with a null id each give a row; a null id is never a component's id unless
    all ids of the component are null. Empty tables give no rows.
    """
    marked = materialize(with_fingerprints(documents), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = materialize(fingerprint_links(nodes.select("fp"), tile=tile).distinct(), "links")
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "roots")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    names = materialize(rooted.join(least, "root").select("fp", "component_id"), "names")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents without those that have a near copy with a smaller id.

    Of each component the row with the smallest id stays (all rows that share that id). Rows
    without an id stay too, as nothing tells them apart.
    """
    found = near_duplicates(documents)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*[f"`{c}`" for c in documents.columns])
