"""Repeated passages against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from tillwise.llm import substrings


def plain(rows):
    """Per row the kept words, from the rule itself."""
    split = [(d, re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    got = substrings.cut_repeats(df.repartition(3)).collect()
    return sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got], key=str)


def corpus(seed, n_docs=40, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["ä", "ß", "The", "the"]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 40]))] for _ in range(6)]
    docs = []
    for d in rng.sample(range(1000), n_docs):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]
            if rng.random() < 0.1:
                text += ["same"] * 40
        docs.append((d, rng.choice([" ", "\n", "  \t"]).join(text)))
    return docs + docs[:3]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("batch", ["3", "2000"])
def test_equals_the_rule(spark, monkeypatch, seed, batch):
    """Small batches end inside of anchors, and split the documents that settle among themselves."""
    monkeypatch.setattr(substrings, "small_batches", lambda df: df)
    monkeypatch.setattr(substrings, "FLUSH_BYTES", 700 if seed == 1 else 8_000_000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = corpus(seed)
        assert run(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 3), st.sampled_from([1, 5, 20])), max_size=30),
    st.lists(st.integers(1, 7), max_size=10),
)
def test_meeting_is_the_same_however_rows_are_cut(stretches, cuts):
    """Repeats, and what is to be extended, against the rule for whole anchors."""
    import numpy as np

    rows = sorted((k, m, d, s, n) for s, (k, m, d, n) in enumerate(stretches))
    expected = []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        open_ = len({r[2] for r in mine}) > 1 and (len({r[1] for r in mine}) > 1 or any(r[4] > 13 for r in mine))
        for k, m, d, s, n in mine:
            least = min(r[2] for r in mine if r[1] == m)
            if d > least and n <= 13:
                expected.append((d, s, n, None))
            elif open_:
                expected.append((d, s, n, k))
    meeting, at, got = substrings._Meeting(), 0, []
    for size in [*cuts, len(rows)]:
        part = rows[at : at + size]
        at += size
        if part:
            for doc, start, n, key in meeting.meet(*(np.array(c, np.int64) for c in zip(*part))):
                keys = [None] * len(doc) if key is None else key.tolist()
                got += zip(doc.tolist(), start.tolist(), n.tolist(), keys)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_an_anchor_in_differing_surroundings_takes_no_memory():
    """Of an open anchor only the rows of one document wait, however many come."""
    import numpy as np

    meeting, n = substrings._Meeting(), 1000
    for part in range(50):
        names = np.arange(part * n, (part + 1) * n)
        meeting.meet(np.zeros(n, np.int64), names, names, names % 7, np.full(n, 9))
        assert sum(len(w[0]) for w in meeting.waiting) <= 1


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [
        (5, None), (6, ""), (7, " \n "), (8, passage), (9, passage), (9, passage), (None, passage), (None, passage),
        (3, "x " * 60_000), (4, "x " * 12), (10, "x " * 13), (1, "p0 p1"), (11, passage + " end " + passage), (-2, "y " + passage),
    ]
    assert run(spark, rows) == plain(rows)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.cut_repeats(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=6))
def test_stretches_cover_each_window_once(docs):
    """Each window is in one stretch or settled range; equal windows have equal anchors, equal names equal words."""
    import numpy as np

    texts = [" ".join(d).encode() for d in docs]
    ids = np.arange(len(docs)) * 10
    (anchor, name, doc, start, count), done = substrings.stretches(ids, [substrings._word_hashes(t) for t in texts])
    seen, of, called = [], {}, {}
    for a, m, d, s, c in zip(*(x.tolist() for x in (anchor, name, doc, start, count))):
        if c <= 13:
            words = tuple(docs[d // 10][s : s + c + 12])
            assert called.setdefault((a, m), words) == words
        for k in range(c):
            seen.append((d, s + k))
            assert of.setdefault(tuple(docs[d // 10][s + k : s + k + 13]), a) == a
    for d, s, c in zip(*(x.tolist() for x in done)):
        seen += [(d, s + k) for k in range(c)]
    assert sorted(seen) == [(i * 10, k) for i, d in enumerate(docs) for k in range(len(d) - 12)]


def test_windows_are_equal_by_all_bits_of_their_hash(spark, monkeypatch):
    """Windows of one anchor whose hashes agree in the low five bytes stay apart."""
    import numpy as np

    rolled = substrings._rolled
    monkeypatch.setattr(substrings, "_rolled", lambda h, width, f: rolled(h, width, f) << np.uint64(40 if width == substrings.SPAN else 0))
    middle = [f"m{i}" for i in range(12)]
    texts = [" ".join([f"a{d}", *middle, f"b{d}"]) for d in range(20)]
    (key, name, doc, start, n), _ = substrings.stretches(np.arange(20), [substrings._word_hashes(t.encode()) for t in texts])
    assert len(np.unique(name)) == len(name)


def around_one_run(n=300):
    """Documents that hold one very common run of five words in differing surroundings."""
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(10**6)}"
    docs = []
    for d in range(n):
        before, after = [word() for _ in range(20)], [word() for _ in range(20)]
        if d % 10 == 3:  # some windows around the run come again
            before[12:], after[:6] = docs[-1][1][12:20], docs[-1][1][25:31]
        docs.append((d, [*before, *"this is a common run".split(), *after]))
    return [(d, " ".join(w)) for d, w in docs] + [(n, "same " * 60), (n + 1, "same " * 50)]


def test_very_common_anchors_are_dealt_out_by_window(spark, monkeypatch):
    import numpy as np

    rows = around_one_run()
    monkeypatch.setattr(substrings, "HOT_ROWS", 40)
    known = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text AS binary) AS text").repartition(3)
    hot = substrings.common_anchors(known)
    seeds = [substrings._rolled(substrings._word_hashes(b"this is a common run"), 5, 0x9DDFEA08EB382D69).view(np.int64)[0]]
    assert hot.tolist() == seeds
    most = []
    for anchors in (hot, None):
        sent = known.mapInArrow(lambda b, hot=anchors: substrings._send(b, hot), substrings.SCHEMA)
        most.append(sent.where("name IS NOT NULL").groupBy("key").count().agg({"count": "max"}).head()[0])
    assert most[0] <= 40 < most[1]
    assert run(spark, rows) == plain(rows)


def test_counts_of_common_anchors_are_short_by_no_more_than_said(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    parts = [np.where(rng.random(500) < 0.2, 5, rng.integers(10, 2000, 500)) for _ in range(20)]
    monkeypatch.setattr(substrings, "COUNTED", 50)
    monkeypatch.setattr(substrings, "_cut_up", lambda batches: (((p,), ()) for p in parts))
    rows = next(substrings._count(iter([]))).to_pylist()
    assert rows[0]["key"] is None and rows[0]["n"] == 10_000 and rows[0]["missed"] <= 2 * 10_000 / 50 + 1
    true = int((np.concatenate(parts) == 5).sum())
    assert true - rows[0]["missed"] <= {r["key"]: r["n"] for r in rows}[5] <= true
