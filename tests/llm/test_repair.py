"""Token ids written as Re-Pair shards and read back."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tillwise.llm import repair
from tillwise.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return repair.Encoder(tokenizer_path())


def expected(plain, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_tokenizer_on_the_small_tables(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op8_repair_token_ids"](spark, SMALL).orderBy("doc_id").collect()]
    assert got == expected(plain, rows)


ODD = [
    (7, None), (1, ""), (2, " \n"), (3, "Hello, HELLO don't we'll a.b.c ... ,. x,"), (None, "no id"),
    (4, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b Word"), (5, "word, word. " * 30_000),
    (6, "ÉCOLE école İstanbul ß ſ  x y 漢字 🎉a b1c2"), (8, "id1 'S 'LL s' <| |>"),
]


def test_odd_rows(spark, plain, tmp_path):
    df = spark.createDataFrame([(i, t, "z") for i, t in ODD], "doc_id long, text string, start string")
    got = repair.encode_documents(df, str(tmp_path / "x"), tokenizer_path()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(plain, ODD)


def test_repeated_rows_and_an_empty_table(spark, plain, tmp_path):
    rows = [(1, "a b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repair.encode_documents(df, str(tmp_path / "x"), tokenizer_path()).collect()
    assert sorted(map(tuple, got)) == expected(plain, rows)
    assert repair.encode_documents(df.limit(0), str(tmp_path / "y"), tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_words_alone_give_the_ids_of_the_whole_text(plain, encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [np.frombuffer(encoder.encode(t.encode()), "<u2").tolist() for t in texts]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZÉéßÿÀ÷×,.'!_~`<|>#1ſİµªs ", max_size=12))
def test_latin_words_skip_nothing(plain, encoder, text):
    got = np.frombuffer(encoder.encode(text.encode()), "<u2").tolist()
    assert got == plain.encode(text, add_special_tokens=False).ids


def test_a_full_memory_of_words_changes_nothing(plain):
    small = repair.Encoder(tokenizer_path())
    small.KEEP = 5
    for t in ["one two three four", "five six seven one eight", "nine, one. ten"]:
        got = np.frombuffer(small.encode(t.encode()), "<u2").tolist()
        assert got == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n_symbols, n", [(2, 5000), (40, 60_000), (49_000, 3000), (1, 300)])
def test_round_trip_of_a_shard_and_of_each_document(n_symbols, n):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, n_symbols, n).astype(np.uint16)
    cuts = np.sort(rng.integers(0, n, 20))
    lengths = np.diff(np.concatenate([[0], cuts, [n]]))
    data = repair.pack(list(range(len(lengths))), lengths, ids, 49_408)
    shard = repair.Shard(data)
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    for k, ((doc_id, got), part) in enumerate(zip(shard.documents(), parts, strict=True)):
        assert doc_id == k
        assert np.array_equal(got, part)
        assert np.array_equal(shard.document(k), part)
    if n_symbols <= 2:
        assert len(shard.symbols) < 0.5 * n
        assert shard.sizes.max() > 4


def _passage_and_noise(copies, width=256):
    rng = np.random.default_rng(5)
    passage = rng.permutation(40_000)[:width]
    parts = [x for k in range(copies) for x in (passage, 40_000 + rng.integers(0, 9000, 3))]
    return np.concatenate(parts).astype(np.uint16), np.array([width + 3] * copies)


@pytest.mark.parametrize("copies", [10, 2000])
def test_pairs_are_taken_until_none_repeats_often(copies):
    ids, lengths = _passage_and_noise(copies)
    symbols, per, rules = repair.compress(ids, lengths, 49_408)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(per) - 1] = True
    pairs = (symbols[:-1].astype(np.int64) << 16 | symbols[1:])[~last[:-1]]
    assert np.unique(pairs, return_counts=True)[1].max() < repair.LEAST
    assert len(symbols) <= 5 * copies
    shard = repair.Shard(repair.pack(list(range(copies)), lengths, ids, 49_408))
    assert np.array_equal(np.concatenate([d for _, d in shard.documents()]), ids)


def test_no_rule_goes_unused():
    """Pairs that share a slot or lose all overlaps spend no symbol."""
    ids = np.random.default_rng(6).integers(0, 70, 200_000).astype(np.uint16)
    symbols, _, rules = repair.compress(ids, np.array([len(ids)]), 49_408)
    assert len(rules) > 3000
    assert set(range(49_408, 49_408 + len(rules))) <= {*symbols.tolist(), *rules.ravel().tolist()}


def test_files_of_other_rules_are_encoded_whole(tmp_path, encoder):
    """Words are taken apart only for the rules that allow it; another file gives its own ids."""
    import json

    assert encoder.by_words
    with open(tokenizer_path(), encoding="utf-8") as file:
        rules = json.load(file)
    texts = ["Hello, HELLO don't we'll a.b.c ... ÉCOLE <|endoftext|> x  y", "", " \n", "word " * 500]
    changes = (
        {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
        {"normalizer": None},
    )
    for k, change in enumerate(changes):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps({**rules, **change}), encoding="utf-8")
        other, plain = repair.Encoder(str(path)), Tokenizer.from_file(str(path))
        assert not other.by_words
        for text in texts:
            assert np.frombuffer(other.encode(text.encode()), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
