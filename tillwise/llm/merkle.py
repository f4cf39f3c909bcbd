"""A Merkle manifest of a dataset, and proofs for many leaves at once.

A forest has one tree per value of ``tree``; two neighbouring nodes become the hash of their
digests, a node left alone at the end of a level the hash of its own. Trees are built some
levels at a time: a block of neighbouring nodes climbs on its own, and what it ends in is a
node of the next round.

Leaves are proved in partitions, each a block of neighbouring places. A partition works out
which nodes the proofs of all its leaves need and which of these it can derive itself; what is
missing, at most two nodes per level if its leaves have no gaps, is fetched in one join. The
nodes inside the block are then derived once for all its leaves, and each leaf's own proof is
read off. This is an octopus multiproof.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.session import materialize

#: Levels that one block climbs, and hence the leaves of a partition: 2 ** LEVELS.
LEVELS = 9
#: The columns of a document that its leaf commits to.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree string, n long, level int, pos long, digest string"
STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])


# --- hashes ----------------------------------------------------------------------------


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, steps: str) -> Column:
    """The root that a leaf's digest and the steps of its proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        other = step["digest"]
        both = F.when(other.isNull(), digest).when(step["left"], F.concat(other, digest)).otherwise(F.concat(digest, other))
        return F.sha2(both, 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: str) -> Column:
    """The hash of a proof's siblings in order, whatever their sides."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["digest"]), ""), 256)


# --- octopus ---------------------------------------------------------------------------


def known_and_missing(places: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level, places whose digests the leaves at ``places`` give, and siblings they lack.

    ``places`` is sorted and distinct; the tree has ``n`` leaves. The last level has one node
    and lacks nothing.
    """
    while n > 1:
        others = places ^ 1
        yield places, others[(others < n) & ~np.isin(others, places)]
        places, n = np.unique(places >> 1), (n + 1) >> 1
    yield places, places[:0]


def derived(places: np.ndarray, digests: list[str], n: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Per level, the digests that proofs need: those of the leaves, the fetched, and what they give."""
    levels = []
    now = dict(zip(places.tolist(), digests))
    for level, (mine, missing) in enumerate(known_and_missing(places, n)):
        for p in missing.tolist():
            now[p] = fetched[level, p]
        levels.append(now)
        parents = np.unique(mine >> 1).tolist()
        now = {p: joined(now[2 * p], now.get(2 * p + 1, "")) for p in parents}
    return levels


def steps_of(place: int, levels: list[dict[int, str]]) -> list[dict]:
    """A leaf's proof from bottom to top: the sibling and its side; without one, a null digest."""
    steps = []
    for level in range(len(levels) - 1):
        steps.append({"left": place % 2 == 1, "digest": levels[level].get(place ^ 1)})
        place >>= 1
    return steps


# --- forest ----------------------------------------------------------------------------


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place of each in its ``tree`` by ``order``, and ``n``, the tree's rows.

    Rows are dealt out by ranges and numbered inside each; what lies before comes from one row
    per range and tree. So a tree with most of all rows takes no single task. Rows that are
    equal in ``order`` follow their place in the stored table, and may be parted.
    """
    stored = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    dealt = stored.repartitionByRange("tree", *order, "row").withColumn("part", F.spark_partition_id())
    placed = materialize(dealt, "ranges")
    counts = materialize(placed.groupBy("part", "tree").agg(F.count("*").alias("rows")), "counts")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part").alias("of_part"), F.col("tree").alias("of_tree"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"),
    )
    inside = Window.partitionBy("part", "tree").orderBy(*order, "row")
    local = placed.withColumn("local", F.row_number().over(inside))
    match = (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree"))
    found = local.join(offsets, match).withColumn("pos", F.col("before") + F.col("local") - 1)
    return found.select(*rows.columns, "pos", "n")


def _levels_above(n: int) -> int:
    return max(0, n - 1).bit_length()


def _climb(base: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block of nodes at level ``base``, the nodes of the next ``levels`` levels above it."""

    def climb(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, n = rows.column("tree")[0].as_py(), rows.column("n")[0].as_py()
        now, place = rows.column("digest").to_pylist(), rows.column("pos")[0].as_py()
        found = []
        for level in range(base + 1, min(base + levels, _levels_above(n)) + 1):
            place >>= 1
            now = [joined(*now[k : k + 2]) for k in range(0, len(now), 2)]
            found += [(tree, n, level, place + k, d) for k, d in enumerate(now)]
        columns = list(zip(*found)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["tree", "n", "level", "pos", "digest"])

    return climb


def grown(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All nodes (tree, n, level, pos, digest) over leaves (tree, n, pos, digest), these included.

    Each round lifts all trees by ``levels`` levels, so 10^11 leaves take five rounds.
    """
    leaves = leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "digest")
    height = _levels_above(leaves.agg(F.max("n")).first()[0] or 0)
    parts = [leaves]
    for base in range(0, height, levels):
        open_ = parts[-1].where((F.col("level") == base) & (F.col("n") > 1 << base))
        block = F.shiftright("pos", levels).alias("block")
        rows = open_.select("tree", block, "n", "pos", "digest")
        climbed = rows.groupBy("tree", "block").applyInArrow(_climb(base, levels), NODES)
        parts.append(materialize(climbed, "nodes"))
    return reduce(DataFrame.union, parts)


def tops(nodes: DataFrame) -> DataFrame:
    """The last node of each tree."""
    reach = F.expr("shiftleft(1L, level)")
    return nodes.where((F.col("n") <= reach) & ((F.col("level") == 0) | (F.col("n") * 2 > reach)) & (F.col("pos") == 0))


def _requests(key: tuple, rows: pa.Table) -> pa.Table:
    """The nodes that a partition's leaves lack."""
    places = np.unique(rows.column("pos").to_numpy())
    found = [
        (level, p)
        for level, (_, missing) in enumerate(known_and_missing(places, rows.column("n")[0].as_py()))
        for p in missing.tolist()
    ]
    columns = [[key[0].as_py()] * len(found), [key[1].as_py()] * len(found), *(list(zip(*found)) or [[], []])]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["tree", "block", "level", "pos"])


def proved(leaves: DataFrame, nodes: DataFrame, after: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaves (tree, n, pos, digest, payload) with ``steps``, their proofs, and ``top``.

    ``leaves`` may be any of a tree's leaves; ``payload`` is carried along. ``after`` (tree,
    steps) are steps that follow those of a whole tree. ``top`` is the tree's last node, as
    derived from the leaf. Each partition of 2 ** ``levels`` places fetches what it lacks from
    ``nodes``, the same node only once for all its leaves.
    """
    dealt = leaves.withColumn("block", F.shiftright("pos", levels)).select("tree", "block", "n", "pos", "digest", "payload")
    wanted = dealt.select("tree", "block", "n", "pos").groupBy("tree", "block").applyInArrow(
        _requests, "tree string, block long, level int, pos long"
    )
    wanted = materialize(wanted, "wanted").select(F.col("tree").alias("of"), "block", F.col("level").alias("at"), F.col("pos").alias("place"))
    match = F.col("tree").eqNullSafe(F.col("of")) & (F.col("level") == F.col("at")) & (F.col("pos") == F.col("place"))
    left = F.lit(None).cast("boolean").alias("left")
    sent = nodes.join(wanted, match).select("tree", "block", "level", "pos", left, "digest")
    if after is not None:
        blocks = dealt.select("tree", "block").distinct()
        on = after.select(F.col("tree").alias("of"), F.posexplode("steps").alias("level", "step"))
        more = blocks.join(on, F.col("tree").eqNullSafe(F.col("of")))
        none = F.lit(None).cast("long").alias("pos")
        sent = sent.union(more.select("tree", "block", "level", none, F.col("step.left").alias("left"), F.col("step.digest").alias("digest")))

    sent = materialize(sent, "fetched")

    def expand(mine: pa.Table, got: pa.Table) -> pa.Table:
        places, n = mine.column("pos").to_numpy(), mine.column("n")[0].as_py()
        got = got.to_pylist()
        fetched = {(r["level"], r["pos"]): r["digest"] for r in got if r["pos"] is not None}
        beyond = [{"left": r["left"], "digest": r["digest"]} for r in sorted(got, key=lambda r: r["level"]) if r["pos"] is None]
        at, first = np.unique(places, return_index=True)
        digests = mine.column("digest").to_pylist()
        levels_ = derived(at, [digests[k] for k in first.tolist()], n, fetched)
        steps = [steps_of(p, levels_) + beyond for p in places.tolist()]
        out = mine.drop_columns(["block"]).append_column("steps", pa.array(steps, pa.list_(STEP)))
        return out.append_column("top", pa.array([levels_[-1][0]] * len(places), pa.string()))

    payload = dict(leaves.dtypes)["payload"]
    schema = f"tree string, n long, pos long, digest string, payload {payload}, steps array<struct<left:boolean,digest:string>>, top string"
    keys = ("tree", "block")
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(expand, schema)


# --- manifest --------------------------------------------------------------------------


@dataclass
class Manifest:
    """A dataset's trees: leaves and nodes per language, and the tree over their roots."""

    leaves: DataFrame
    nodes: DataFrame
    upper_leaves: DataFrame
    upper_nodes: DataFrame
    #: None without a single document.
    root: str | None

    def prove(self, leaves: DataFrame | None = None) -> DataFrame:
        """Proofs up to the root for ``leaves``, rows of the manifest's own (all by default)."""
        upper = proved(self.upper_leaves.withColumn("payload", F.col("tops_of")), self.upper_nodes)
        after = materialize(upper.select(F.col("payload").alias("tree"), "steps"), "upper-proofs")
        return proved(self.leaves if leaves is None else leaves, self.nodes, after)


def manifest(documents: DataFrame, payload: Column | None = None) -> Manifest:
    """The manifest of ``documents``: one leaf per row, a tree per ``lang``, a tree over these.

    A leaf commits to ``FIELDS``; other columns may have any names and don't matter. Null is a
    language of its own and comes first, as does a null doc_id. Rows that share a doc_id are in
    order of their digests, and equal rows are leaves next to each other. An empty table has no
    root. ``payload`` is carried to the proofs, by default the doc_id.
    """
    rows = documents.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("doc_id"), leaf_digest(*map(F.col, FIELDS)).alias("digest"),
        (F.struct("doc_id") if payload is None else payload).alias("payload"),
    )
    leaves = materialize(numbered(rows, "doc_id", "digest").drop("doc_id"), "numbered")
    nodes = grown(leaves)
    langs = tops(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("tops_of"), "digest")
    upper_leaves = materialize(numbered(langs, "tops_of"), "upper-leaves")
    upper_nodes = grown(upper_leaves)
    top = tops(upper_nodes).select("digest").first()
    return Manifest(leaves, nodes, upper_leaves, upper_nodes, top and top[0])
