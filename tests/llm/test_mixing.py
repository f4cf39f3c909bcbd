"""Mixing against plain arithmetic."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillwise.llm import mixing

WEIGHTS = (1, 2, 3)


def words(text):
    import re

    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def plain_targets(sizes):
    """Water is poured by weight; what overflows a source is poured again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    total = sum(sizes.values())
    target, closed = {s: Fraction(0) for s in order}, set()
    while True:
        left = total - sum(target[s] for s in closed)
        open_ = [s for s in order if s not in closed]
        for s in open_:
            target[s] = Fraction(left) * weight[s] / sum(weight[x] for x in open_)
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            closed.add(s)


def check(rows, got):
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(words(text))
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, float(targets[r.source]), rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        assert 0 <= r.position <= 1
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert taken[s] == math.floor(float(targets[s])), (s, taken[s], t)


ROWS = [
    (1, "a", "x " * 100), (2, "a", "y"), (3, "b", None), (4, "b", "z z"), (None, "b", "no id"), (5, None, "q " * 9), (6, "", "\n"),
    (7, "ä", "w " * 20_000), (8, "Z", "v v"), (9, "Z", "v v"), (9, "Z", "v v"), (10, None, ""), (11, "c", "t " * 50),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5.0, "x") for r in rows], "doc_id long, source string, text string, size double, weight string")


def test_odd_rows(spark):
    df = frame(spark, ROWS)
    got = mixing.mix_sources(df).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(i), str(s), len(words(t))) for i, s, t in ROWS)
    check(ROWS, got)
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("rows", [[], [(1, "a", "one two")], [(1, "a", None), (2, "b", "")], [(k, "a", "x") for k in range(50)]])
def test_small_tables(spark, rows):
    check(rows, mixing.mix_sources(frame(spark, rows)).collect())


def test_a_hot_source(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 40}", "w " * (k % 17)) for k in range(900)]
    check(rows, mixing.mix_sources(frame(spark, rows)).collect())


def test_documents_come_as_often_as_they_are_taken(spark):
    rows = [r for r in ROWS if r[0] is None or r[0] != 9]
    df = frame(spark, rows)
    plan = {(r.doc_id, r.source): r.taken for r in mixing.mix_sources(df).collect()}
    got = defaultdict(int)
    found = mixing.mix_documents(df)
    assert found.columns == df.columns
    texts = {(i, s): t for i, s, t in rows}
    for r in found.collect():
        got[r.doc_id, r.source] += len(words(r.text))
        assert texts[r.doc_id, r.source].startswith(r.text)
    assert dict(got) == {k: n for k, n in plan.items() if n}


def test_order_inside_a_source_and_positions(spark):
    rows = [(k, "a", "w " * (k + 1)) for k in range(30)]
    got = {r.doc_id: r for r in mixing.mix_sources(frame(spark, rows)).collect()}
    order = sorted(got, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    before, total = 0, sum(r["size"] for r in got.values())
    for k in order:
        share = before / total
        # The lightest source fades: its weight falls from 1.5 to 0.5.
        t = got[k].position
        assert math.isclose(1.5 * t - 0.5 * t * t, share, abs_tol=1e-9)
        before += got[k]["size"]
    ranked = [r.doc_id for r in mixing.curriculum_order(mixing.mix_sources(frame(spark, rows))).collect()]
    assert ranked == order


KNOTS = st.lists(st.floats(0.1, 5), min_size=2, max_size=5)


@settings(max_examples=15, deadline=None)
@given(KNOTS, st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_positions_invert_any_schedule(spark, weights, shares):
    n = len(weights) - 1
    knots = [(k / n, w) for k, w in enumerate(weights)]
    df = spark.createDataFrame([(1, s) for s in shares], "weight int, share double")
    got = df.select("share", mixing.training_position(F.col("share"), F.col("weight"), {1: knots}).alias("t")).collect()

    def area(t):
        total = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            total += a * x + (b - a) * x * x / (2 * (t1 - t0))
        return total

    for r in got:
        assert math.isclose(area(r.t) / area(1.0), r.share, abs_tol=1e-7)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_documents(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
