"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from tillwise.llm import neighbours as nn
from tillwise.llm.queries import QUERIES


def brute(rows, every, k=20):
    """query -> [(id, score)], each pair looked at."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    sizes = [len(v) for _, v in good]
    size = max(sorted(set(sizes)), key=sizes.count, default=0)
    first = {}
    for i, v in good:
        if len(v) == size:
            first[i] = min(v, first.get(i, v))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in first.items()]
    out = {}
    for q, x in good:
        if q % every == 0:
            scores = {i: float(v @ x) for i, v in good if i != q}
            best = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]
            if best:
                out[q] = best
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, expected):
    assert set(got) == set(expected)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in expected.items())
    return hits / sum(map(len, expected.values()))


def test_recall_of_the_query_on_all_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, expected = answers(QUERIES["op9_nn_descent_search"](spark, folder)), brute(rows, 20)
    assert recall(got, expected) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(vectors[q] @ vectors[i] - s) < 1e-12 for i, s in found)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in rng.permutation(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(answers(nn.nearest(df, 10, shard_nodes=300)), brute(rows, 10)) >= 0.95


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(40)]
    same = [1.0, 2.0, 3.0, 4.0]
    rows += [(i, same) for i in range(100, 160)] + [(100, same), (7, [9.0, 9.0, 9.0, 9.0])]
    odd = [(200, None), (None, same), (220, []), (240, [0.0] * 4), (260, [1.0, None, 2.0, 3.0]), (280, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, score double")
    got, expected = answers(nn.nearest(df, 20)), brute(rows + odd, 20)
    assert set(got) == set(expected)
    for q, best in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(nn.nearest(df, 20))
    assert got == {q: [(i, pytest.approx(s)) for i, s in best] for q, best in brute(rows, 20).items()}
