"""The pipeline, stage by stage, against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tillwise.llm import mixing
from tillwise.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's written result, the input first."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "x")
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_rows_of_the_filters(stages):
    for k in range(4):
        assert stages[k + 1].columns == stages[0].columns
    for k in range(3):
        before = {tuple(r) for r in stages[k].collect()}
        assert {tuple(r) for r in stages[k + 1].collect()} <= before


def test_near_copies(stages):
    from test_simhash import plain_components

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    expected = {c for _, c in plain_components(rows).values()}
    assert {r.doc_id for r in stages[2].collect()} == expected


def test_benchmark(spark, stages):
    from test_decontaminate import plain

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    expected = {d for d, *_, bad in plain(rows, items) if not bad}
    assert {r.doc_id for r in stages[3].collect()} == expected


def test_mix(stages):
    words = lambda t: len(t.split())
    plan = {r.doc_id: r for r in mixing.mix_sources(stages[3]).collect()}
    full = {r.doc_id: r.text for r in stages[3].collect()}
    got = Counter()
    targets, sums = {}, defaultdict(int)
    for r in stages[4].collect():
        got[r.doc_id] += words(r.text)
        sums[r.source] += words(r.text)
        assert full[r.doc_id].startswith(r.text)
    for d, r in plan.items():
        assert got[d] == r.taken <= 3 * r["size"]
        targets[r.source] = r.target
    assert all(abs(sums[s] - t) <= 1 for s, t in targets.items())


def test_token_ids_and_the_whole_run(spark, stages):
    tool = Tokenizer.from_file(tokenizer_path())
    texts = sorted((r.doc_id, r.text) for r in stages[4].collect())
    got = sorted(map(tuple, stages[5].collect()), key=lambda r: r[1])
    start = 0
    for (doc_id, text), row in zip(texts, got, strict=True):
        n = len(tool.encode(text, add_special_tokens=False).ids) + 1
        assert row[:3] == (doc_id, start, n)
        start += n
    again = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=lambda r: r[1])
    assert again == got


def test_stages_take_columns_of_any_names(spark):
    """Extra columns that are named like those the stages work with come out as they went in."""
    from tillwise.llm import decontaminate, mixing, simhash

    clashing = ("_n_words", "_spans", "_items", "_found_x", "_words", "_size", "_time", "_part", "_taken", "_gone", "size", "taken", "a.b", "fp")
    texts = [f"number {k} is a text of its own with words like {k * 7919} and more" for k in range(30)]
    rows = [(k, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for c in clashing:
        df = df.selectExpr("*", f"'{c}' AS `{c}`")
    bench = spark.createDataFrame([("item", "nothing of this is in any text")], "item_id string, text string")
    for stage in (simhash.drop_near_duplicates, lambda d: decontaminate.drop_contaminated(d, bench), mixing.mix_documents):
        out = stage(df)
        assert out.columns == df.columns
        values = {tuple(r)[5:] for r in out.collect()}
        assert values == {clashing}
