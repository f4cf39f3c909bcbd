"""The subsequence kernel machine: its arithmetic, held-out accuracy and odd texts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import toxicity as tox
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
INSULTS = ["idiot", "moron", "clown"]
WORDS = ["the", "house", "garden", "yellow", "reader", "winter", "table", "music", "stone", "river", "cloud", "paper"]


def sample(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = list(rng.choice(WORDS, 25))
        if k % 3 == 0:
            words[int(rng.integers(25))] = INSULTS[k // 3 % 3]
        rows.append((" ".join(words) + ".", int(k % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def machine():
    return tox.train_machine(sample())


def test_scores_equal_the_kernel_written_out():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=tox.CODES**3)
    machine = tox.Machine(weights.copy(), 1.0, 0.0)
    codes = tox.codes_of("Ein Haus, é und ein Garten am Fluß.")
    got = tox.piece_scores(codes, machine.by_span)
    for at in range(len(codes) - tox.PIECE + 1):
        expected = 0.0
        for i in range(at, at + tox.STARTS):
            for j, k in itertools.combinations(range(i + 1, i + tox.REACH + 1), 2):
                u = (codes[i] * tox.CODES + codes[j]) * tox.CODES + codes[k]
                expected += weights[u] * tox.DECAY ** (k - i + 1)
        assert math.isclose(got[at], expected, rel_tol=1e-3, abs_tol=1e-3)
        ids, w = tox.features(codes[at : at + tox.PIECE])
        assert math.isclose(got[at], (weights[ids] * w).sum(), rel_tol=1e-3, abs_tol=1e-3)


def test_chunks_miss_no_piece(machine):
    text = " ".join(["garden"] * 500 + ["idiot"] + ["river"] * 500)
    whole = machine.worst(text)[0]
    assert all(machine.worst(text, chunk=c)[0] == pytest.approx(whole, abs=1e-3) for c in (7, 64, 1000))


def test_gapped_and_inserted_insults(machine):
    clean = [t for t, y in sample(60, 9) if not y]
    assert all(machine.score(t) < 0.3 for t in clean)
    for word in ("idiot", "IDIOT", "i d i o t", "i.d.i.o.t", "idxiot", "mor-on", "clo wn", "m o r o n"):
        assert machine.score(f"the house {word} river stone") >= 0.3, word


def test_held_out_accuracy_of_the_query(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = QUERIES["op4_subsequence_toxicity"](spark, FOLDER)
    rows = found.join(labels, "doc_id").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.where("held_out").collect()
    toxic = [r for r in rows if r.toxic and r.lang == "en"]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_texts_and_extra_columns(spark, machine):
    rows = [(1, None), (2, ""), (3, "!?"), (4, "a"), (5, "river " * 60_000 + "idiot"), (None, "idiot"), (5, "漢字 🎉"), (6, "river " * 9)]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    got = tox.score_documents(df, machine).collect()
    assert [(r.doc_id, r.text) for r in got] == rows
    s = [r._score for r in got]
    assert s[0] == s[1] == s[2] and all(0 <= x <= 1 for x in s)
    assert s[4] >= 0.3 and s[5] >= 0.3 and s[7] < 0.3
    assert tox.score_documents(df.limit(0), machine).count() == 0


def test_training_leaves_out_the_held_out_quarter_and_odd_labels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tox, "train_machine", lambda samples: seen.extend(samples.ask(lambda text, label: (text, label))))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("toxic"))
    more = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int")
    tox.train(docs, labels.union(more).union(labels))
    import zlib

    expected = sorted((f"t{i}", i % 3) for i in range(400) if i % 3 < 2 and zlib.crc32(str(i).encode()) % 4 != 2)
    assert sorted(seen) == expected


@pytest.mark.parametrize("rows", [[], [("a b", 1)], [("a b", 0), ("", 0)], [("", 1), ("", 0)], [("x y", 1), ("x y", 0)]])
def test_training_on_next_to_nothing(rows):
    assert 0 <= tox.train_machine(rows).score("some text") <= 1


@pytest.mark.parametrize("n", [0, 1, 3, 40, 5000])
def test_an_insult_at_the_end_counts_in_full(n):
    """A last word has no less value than the same word alone, as training knows it."""
    weights = np.zeros(tox.CODES**3)
    ids, _ = tox.features(tox.codes_of("idiot"))
    weights[ids] = 1.0
    machine = tox.Machine(weights, 1.0, 0.0)
    alone = sum(tox.features(tox.codes_of("idiot"))[1])
    for end in ("", ".", "!!"):
        value, piece = machine.worst("z" * 30 + " bb" * n + " idiot" + end)
        assert value > 0.999 * alone and len(piece) == tox.PIECE


def test_whole_texts_teach(spark):
    """Insults after a hundred thousand clean characters are learnt; the sample is asked in tasks."""
    rows = []
    for k, (text, toxic) in enumerate(sample(120)):
        rows.append((k, "garden river stone " * 6_000 + text if k % 3 == 0 else text, toxic))
    df = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    machine = tox.train(df.drop("toxic"), labels)
    for word in INSULTS:
        assert machine.score(f"the house {word} river") >= 0.3
    assert machine.score("the yellow house and the river stone") < 0.3
    held = tox.train_machine([(t, y) for k, t, y in rows if __import__("zlib").crc32(str(k).encode()) % 4 != 2])
    assert held.score("a clown here") == pytest.approx(machine.score("a clown here"), abs=1e-6)


def test_the_sample_is_the_limit_whatever_the_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tox, "train_machine", lambda samples: seen.append((samples.sizes(), len(samples.ask(lambda t, y: 1)))))
    docs = spark.range(30_000).select((F.col("id") % 29_000).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(29_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("toxic"))
    tox.train(docs, labels, limit=40)
    assert seen == [({0: 80, 1: 40}, 120)]


def test_letters_of_other_scripts_and_marks():
    codes = lambda t: tox.codes_of(t).tolist()
    assert codes("идиот") != codes("окофш") and codes("ИДИОТ") == codes("идиот")
    assert len(set(codes("αβγδεζ"))) >= 6
    # Curly quotes, dashes, emoji and zero-width marks are gaps.
    assert codes("a\u2019b\u2014c\U0001F642d\u200be") == codes("a b c d e")


def test_insults_in_another_script():
    words = ["дом", "сад", "река", "камень", "музыка", "зима", "стол", "бумага"]
    rng = np.random.default_rng(3)
    rows = []
    for k in range(240):
        text = list(rng.choice(words, 20))
        if k % 3 == 0:
            text[int(rng.integers(20))] = ["дурак", "идиот"][k % 2]
        rows.append((" ".join(text), int(k % 3 == 0)))
    machine = tox.train_machine(rows)
    for word in ("дурак", "идиот", "ДУРАК", "и д и о т"):
        assert machine.score(f"дом {word} река") >= 0.3
    assert machine.score("дом сад река камень зима стол") < 0.3
