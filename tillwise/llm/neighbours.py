"""Approximate nearest neighbours by inner product: NN-descent graphs and greedy search.

Equal vectors are one node, with the smallest ids of their rows kept as members; no copy can
crowd a result out, and a vector that a third of all rows share costs one node. Nodes are
dealt into shards of bounded size by a hash. In each shard a neighbour graph starts from the
best of random blocks and improves in rounds: joins bring the neighbours of each node
together, both the ones it points to and the ones that point to it, and what meets there and
is better than a node's present neighbours replaces them. A search walks a shard's graph
greedily from a few entries, many queries at a time, and keeps the best nodes it has seen;
the best of all shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillwise.session import materialize

DEGREE = 16
ROUNDS = 4
SHARD_NODES = 4_096
QUERY_BLOCK = 4_096
BLOCK = 256
OFFERS = 5
BEAM = 160
ENTRIES = 32
STEP = 4


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors that were packed as bytes of little-endian floats."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1) if rows else np.zeros((0, 1), np.float32)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(v, "<f4").tobytes() for v in batch.column("vec").to_pylist()]
        columns = [batch.column("id"), batch.column("shard"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "shard", "vec"])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that take part, one for each id.

    Left out are rows without an id, and vectors that are null, empty, all zero or hold a null
    or non-finite component. Vectors of another length than most have no inner product with
    these and are left out too (of equally common lengths the smaller stays). Of rows that
    share an id the one with the smallest vector stays. Components are taken as 32-bit floats, so
    vectors of doubles are rounded to these.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & ~F.exists("embedding", odd)
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (sizes.n if sizes else 0))
    return materialize(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")


def vector_classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(id, vec_id, embedding): of each group of equal vectors the ``keep`` smallest ids.

    ``id`` is the smallest of them. Spark cuts to ``keep`` rows before it shuffles.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = vectors.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep)
    first = F.min("vec_id").over(Window.partitionBy("embedding"))
    return least.select(first.alias("id"), "vec_id", "embedding")


def _best(edges: DataFrame, node: str, other: str) -> DataFrame:
    order = Window.partitionBy("shard", node).orderBy(F.desc("s"), other)
    return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DEGREE).drop("_n")


def _first_edges(table: pa.Table) -> pa.Table:
    """Each node's best neighbours inside two random blocks of its shard."""
    ids, vecs = table.column("id").to_numpy(), _matrix(table.column("vec"))
    order = np.argsort(ids)
    ids, vecs = ids[order], vecs[order]
    rng, n = np.random.default_rng(7), len(ids)
    u, v, s = [], [], []
    for _ in range(2):
        for block in np.array_split(rng.permutation(n), max(1, n // BLOCK)):
            inner = vecs[block] @ vecs[block].T
            np.fill_diagonal(inner, -np.inf)
            k = min(DEGREE, len(block) - 1)
            top = np.argsort(-inner, axis=1)[:, :k]
            u.append(np.repeat(ids[block], k))
            v.append(ids[block][top].ravel())
            s.append(np.take_along_axis(inner, top, 1).ravel())
    u, v, s = (np.concatenate(x) for x in (u, v, s))
    shard = np.full(len(u), table.column("shard")[0].as_py(), np.int32)
    return pa.table({"shard": shard, "u": u, "v": v, "s": s.astype(np.float32)})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, c, w, vec, worst) in order of c: offers between what meets at c."""
    held: list[tuple] = []

    def offers(part: list[tuple]) -> pa.RecordBatch:
        shard, c, w, worst, vecs = (np.concatenate(x) for x in zip(*part))
        fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (shard[1:] != shard[:-1])])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(c)))
        out: list[tuple] = []
        for k in range(0, len(begin), 256):
            b, m = begin[k : k + 256], size[k : k + 256]
            wide = int(m.max())
            at = np.minimum(b[:, None] + np.arange(wide), len(c) - 1)
            real = np.arange(wide) < m[:, None]
            inner = np.matmul(vecs[at], vecs[at].transpose(0, 2, 1))
            inner[~(real[:, :, None] & real[:, None, :])] = -np.inf
            inner[:, np.arange(wide), np.arange(wide)] = -np.inf
            top = np.argsort(-inner, axis=2)[:, :, :OFFERS]
            value = np.take_along_axis(inner, top, 2)
            good = value > worst[at][:, :, None]
            g, i, j = np.nonzero(good)
            out.append((shard[at[g, i]], w[at[g, i]], w[at[g, top[g, i, j]]], value[g, i, j]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "u", "v", "s"])

    for batch in batches:
        if not batch.num_rows:
            continue
        shard, c, w, worst = (batch.column(x).to_numpy() for x in ("shard", "c", "w", "worst"))
        vecs = _matrix(batch.column("vec"))
        open_ = np.flatnonzero((c != c[-1]) | (shard != shard[-1]))
        cut = open_[-1] + 1 if len(open_) else 0
        if cut:
            yield offers([*held, (shard[:cut], c[:cut], w[:cut], worst[:cut], vecs[:cut])])
            held = []
        held.append((shard[cut:], c[cut:], w[cut:], worst[cut:], vecs[cut:]))
    if held:
        yield offers(held)


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(shard, u, v, s): each node's best ``DEGREE`` neighbours found. ``nodes``: shard, id, vec."""
    schema = "shard int, u long, v long, s float"
    edges = nodes.groupBy("shard").applyInArrow(_first_edges, schema)
    edges = materialize(_best(edges.distinct(), "u", "v"), "edges")
    for _ in range(rounds):
        back = _best(edges, "v", "u")
        around = edges.select("shard", F.col("u").alias("c"), F.col("v").alias("w"))
        around = around.union(back.select("shard", F.col("v").alias("c"), F.col("u").alias("w"))).distinct()
        # A node takes only what beats its worst neighbour; with room left it takes anything.
        worst = edges.groupBy("shard", F.col("u").alias("id")).agg(
            F.when(F.count("*") >= DEGREE, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst")
        )
        known = nodes.join(worst, ["shard", "id"], "left").select(
            "shard", F.col("id").alias("w"), "vec", F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst")
        )
        met = around.join(known, ["shard", "w"]).repartition("shard", "c").sortWithinPartitions("shard", "c")
        offers = met.select("shard", "c", "w", "vec", "worst").mapInArrow(_meet, schema)
        every = edges.union(offers).groupBy("shard", "u", "v").agg(F.max("s").alias("s"))
        edges = materialize(_best(every, "u", "v"), "edges")
    return edges


def walk(vecs: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once; ``graph`` has neighbours per row, -1 for none.

    Gives the rows of the best nodes seen and their inner products; -1 where there are fewer.
    """
    n, n_queries = len(vecs), len(queries)
    entries = np.random.default_rng(1).permutation(n)[:ENTRIES]
    width = max(beam, len(entries))
    rows = np.full((n_queries, width), -1)
    scores = np.full((n_queries, width), -np.inf, np.float32)
    rows[:, : len(entries)] = entries
    scores[:, : len(entries)] = queries @ vecs[entries].T
    done = rows < 0
    seen = np.zeros((n_queries, n), bool)
    seen[:, entries] = True
    alive = np.arange(n_queries)
    while len(alive):
        open_scores = np.where(done[alive], -np.inf, scores[alive])
        pick = np.argsort(-open_scores, axis=1)[:, :STEP]
        fresh = ~np.take_along_axis(done[alive], pick, 1)
        done[alive[:, None], pick] = True
        next_ = graph[np.where(fresh, rows[alive[:, None], pick], 0)]
        q = np.broadcast_to(alive[:, None, None], next_.shape)
        ok = fresh[:, :, None] & (next_ >= 0)
        both = np.unique(q[ok].astype(np.int64) * n + next_[ok])
        both = both[~seen.reshape(-1)[both]]
        seen.reshape(-1)[both] = True
        q, node = both // n, both % n
        value = np.einsum("ij,ij->i", queries[q], vecs[node])
        count = np.bincount(q, minlength=n_queries)[alive]
        wide = int(count.max(initial=0))
        if wide:
            place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            more_rows = np.full((len(alive), wide), -1)
            more_scores = np.full((len(alive), wide), -np.inf, np.float32)
            line = np.searchsorted(alive, q)
            more_rows[line, place], more_scores[line, place] = node, value
            all_rows = np.concatenate([rows[alive], more_rows], 1)
            all_scores = np.concatenate([scores[alive], more_scores], 1)
            all_done = np.concatenate([done[alive], more_rows < 0], 1)
            top = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
            rows[alive] = np.take_along_axis(all_rows, top, 1)
            scores[alive] = np.take_along_axis(all_scores, top, 1)
            done[alive] = np.take_along_axis(all_done, top, 1)
        alive = alive[~done[alive].all(axis=1)]
    return rows, scores


def search_shards(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int, n_shards: int, beam: int) -> DataFrame:
    """(q, node, score): the best ``k`` nodes of each query. ``queries``: q, shard (any), vec.

    Every query goes to every shard, in blocks, so that a task holds one shard and one block.
    """
    found = edges.groupBy("shard", F.col("u").alias("id")).agg(F.collect_list("v").alias("next"))
    index = nodes.join(found, ["shard", "id"], "left")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    index = index.withColumn("block", block)
    asked = queries.select(
        "q", "vec", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
    )

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"q": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        left = left.sort_by("id")
        ids, vecs = left.column("id").to_numpy(), _matrix(left.column("vec"))
        graph = np.full((len(ids), DEGREE), -1)
        for row, next_ in enumerate(left.column("next").to_pylist()):
            graph[row, : len(next_ or ())] = np.searchsorted(ids, next_ or [])
        q, asked_vecs = right.column("q").to_numpy(), _matrix(right.column("vec"))
        out = []
        for begin in range(0, len(q), 256):
            mine = asked_vecs[begin : begin + 256]
            rows, _ = walk(vecs, graph, mine, beam)
            exact = np.einsum("id,ikd->ik", mine.astype(np.float64), vecs[rows].astype(np.float64))
            exact[rows < 0] = -np.inf
            order = np.lexsort((ids[rows], -exact), axis=1)[:, :k]
            line, place = np.nonzero(np.take_along_axis(rows, order, 1) >= 0)
            at = order[line, place]
            out.append((q[begin : begin + 256][line], ids[rows[line, at]], exact[line, at]))
        return pa.table(dict(zip(empty, (np.concatenate(x) for x in zip(*out)))))

    met = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    each = met.applyInArrow(apply, "q long, node long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def nearest(embeddings: DataFrame, every: int, k: int = 20, rounds: int = ROUNDS, beam: int = BEAM, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but those
    of the query's own id. Nearness is the inner product in double precision, ties go to the
    smaller vec_id. ``usable`` says which vectors take part. Queries without a candidate, and empty tables, give no rows.
    """
    vectors = usable(embeddings)
    members = materialize(vector_classes(vectors, k + 1), "classes")
    classes = members.where("vec_id = id")
    n_shards = max(1, -(-classes.count() // shard_nodes))
    shard = F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")
    packed = classes.select("id", shard.alias("shard"), F.col("embedding").alias("vec"))
    packed = packed.mapInArrow(_pack, "id long, shard int, vec binary")
    nodes = materialize(packed, "nodes")
    edges = build_graph(nodes, rounds)
    # A query row belongs to the class of its vector; each class is asked once.
    rows = vectors.where(F.col("vec_id") % every == 0)
    owners = classes.select("id", "embedding")
    asked = materialize(rows.join(owners, "embedding").select("vec_id", "id"), "queries")
    queries = nodes.join(asked.select("id").distinct(), "id").select(F.col("id").alias("q"), "vec")
    found = materialize(search_shards(nodes, edges, materialize(queries, "asked"), k + 1, n_shards, beam), "found")
    people = members.select(F.col("id").alias("node"), "vec_id")
    scored = found.join(people, "node").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    # At most k + 1 rows per class that was asked.
    lists = first.groupBy(F.col("q").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    lists = materialize(lists, "lists")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = asked.withColumnRenamed("vec_id", "query_id").join(lists, "id")
    each = answers.select("query_id", F.posexplode(others).alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
