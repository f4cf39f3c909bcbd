"""Language identification: held-out accuracy and odd texts."""

import numpy as np
from pyspark.sql import functions as F

from tillwise.llm import langid
from tillwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = QUERIES["op7_byte_network_language"](spark, FOLDER)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert found.count() == docs.count()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def toy():
    net = langid.ByteNetwork(["aa", "bb"])
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.choice(list(b"abc "), (60, langid.WINDOW)), rng.choice(list(b"xyz "), (60, langid.WINDOW))])
    net.fit(x.astype(np.uint8), np.repeat([0, 1], 60))
    return net


def test_gradients_agree_with_differences():
    net = langid.ByteNetwork(["a", "b", "c"])
    for name in net.tables:
        net.tables[name] = net.tables[name].astype(np.float64)
    rng = np.random.default_rng(1)
    x = rng.integers(97, 105, (8, langid.WINDOW)).astype(np.uint8)
    y, weight = rng.integers(0, 3, 8), np.ones(8)
    net.out = net.out.astype(np.float64)

    def loss():
        return -np.log(net.probabilities(x)[np.arange(8), y]).mean()

    grads = net._gradients(x, y, weight)
    for width in net.tables:
        table = net.tables[width]
        at = np.unravel_index(np.abs(grads[width]).argmax(), table.shape)
        table[at] += 1e-5
        up = loss()
        table[at] -= 2e-5
        down = loss()
        table[at] += 1e-5
        assert np.isclose((up - down) / 2e-5, grads[width][at], rtol=1e-2, atol=1e-5)


def test_odd_texts_and_extra_columns(spark):
    rows = [(1, None), (2, ""), (3, "12 .. 3!"), (4, "abc cab " * 40_000), (5, "xyz"), (None, "abc"), (5, "xyz"), (6, "é")]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df, toy()).collect()
    assert len(got) == len(rows)
    answers = {r.doc_id: (r._lang, r._score) for r in got}
    assert [answers[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert answers[4][0] == "aa" and answers[5][0] == "bb" and answers[None][0] == "aa"
    assert answers[6][0] in ("aa", "bb")
    assert langid.identify(df.limit(0), toy()).count() == 0


def test_training_without_rows_and_with_one_language(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    net = langid.train(df)
    assert [r._lang for r in langid.identify(df, net).collect()] == ["und", "und"]
    one = langid.train(df.withColumn("lang", F.lit("aa")))
    assert {r._lang for r in langid.identify(df, one).collect()} == {"aa", "und"}


def test_every_window_counts():
    net = toy()
    mixed = b"abc" * 10_000 + b"xyz" * 100_000
    langs, scores = langid.predict(net, [mixed, b"abc" * 10_000])
    assert langs == ["bb", "aa"]
    assert scores[0] < scores[1]


def test_rejection_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("123 456")})
    kept = langid.keep_identified(docs.union(more))
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 1000000").count() == 0
    assert kept.count() >= 0.99 * docs.count()


def test_a_rare_language_is_learnt_with_the_others(spark):
    """One document in a hundred is in a language of its own; the sample is a small part of all."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    common = ["the", "garden", "house", "water", "under", "light", "stone", "winter", "morning", "window"]
    rare = ["zdrowie", "przyjaciel", "szczescie", "wszystko", "chrzan", "zrodlo", "krzyz", "mysz", "grzyb", "trzy"]
    rows = []
    for k in range(6_000):
        lang = "rr" if k % 100 == 7 else "cc"
        rows.append((k, " ".join(rng.choice(rare if lang == "rr" else common) for _ in range(60)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled_windows(df, 120).groupBy("lang").count().collect()
    counts = {r.lang: r["count"] for r in sample}
    assert counts["cc"] == 60 and counts["rr"] >= 40
    found = langid.identify(df, langid.train(df, 120))
    assert found.where("_lang = lang").count() > 5_950
    assert found.where((F.col("lang") == "rr") & (F.col("_lang") == "rr")).count() >= 58


def test_forward_pass_written_out(spark):
    """The probability of each class, from the definition of filters, pooling and softmax."""
    net = langid.ByteNetwork(["a", "b", "c"], seed=5)
    rng = np.random.default_rng(1)
    net.bias[:] = rng.normal(0, 0.2, len(net.bias))
    net.out_bias[:] = rng.normal(0, 0.2, 3)
    x = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    expected = []
    for row in x.tolist():
        pooled, k = [], 0
        for width in langid.WIDTHS:
            for f in range(langid.FILTERS):
                best = max(sum(net.tables[width][j][row[i + j], f] for j in range(width)) for i in range(len(row) - width + 1))
                pooled.append(max(0.0, best + net.bias[k]))
                k += 1
        z = [sum(p * net.out[i, c] for i, p in enumerate(pooled)) + net.out_bias[c] for c in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        expected.append([v / sum(e) for v in e])
    assert np.allclose(net.probabilities(x), expected, atol=1e-4)


def test_columns_may_have_any_names(spark):
    rows = [(k, ("the house and the garden " if k % 2 else "das haus und der garten ") * 5, "en" if k % 2 else "de", "x") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = df.selectExpr("*", "'l' AS _lang", "2 AS _score", "3 AS `a.b`", "4 AS _aside1")
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, odd.collect()))
    assert langid.identify(odd, langid.train(odd)).columns.count("_lang") == 1
