"""Byte-pair encoding by prefixes against the tokenizers library."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tillwise.llm import bpe
from tillwise.llm.queries import QUERIES, byte_tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(byte_tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(byte_tokenizer_path())


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<i4").tolist()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library_on_the_small_tables(spark, plain):
    expected = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(back)))
    got = [tuple(r) for r in QUERIES["op11_prefix_bpe"](spark, SMALL).collect()]
    assert sorted(got) == sorted(expected)


PARTS = ["a", "b", "e", "th", "  ", " ", "\n", "é", "Ж", "中", "​", "<|endoftext|>", "<|", "'s", "'LL", "1", "ing", "ÃÂ", "--", "=", "՘", "꟒", "🙂"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_any_text_is_encoded_and_decoded_as_by_the_library(plain, codec, text):
    expected = plain.encode(text, add_special_tokens=False).ids
    assert ids_of(codec, text) == expected
    assert codec.decode(expected) == plain.decode(expected, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_any_ids_are_decoded_as_by_the_library(plain, codec, ids):
    assert codec.decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_settled_code_points_are_cut_alike(plain, codec):
    """The pattern and the library class all code points that the pattern is used for alike."""
    for c in range(0x10000):
        if codec.settled.fullmatch(chr(c)):
            for text in (f"x{chr(c)}1", f" {chr(c)}{chr(c)} !"):
                cut = [text[a:b] for _, (a, b) in plain.pre_tokenizer.pre_tokenize_str(text)]
                assert codec.pieces.findall(text) == cut, hex(c)


def merged(codec, piece):
    """The plain way: the merge of the smallest rank first, the leftmost of equal ones."""
    single = {t: i for i, t in enumerate(codec.tokens) if len(t) == 1}
    whole = {codec.merges[codec.left[i], codec.right[i]]: i for i in range(len(codec.tokens)) if codec.rank[i] >= 0}
    ids = [single[piece[k : k + 1]] for k in range(len(piece))]
    while True:
        ranks = [(codec.merges.get(p, 1 << 40), k) for k, p in enumerate(zip(ids, ids[1:]))]
        rank, k = min(ranks, default=(1 << 40, 0))
        if rank == 1 << 40:
            return ids
        ids[k : k + 2] = [whole[rank]]


def test_every_prefix_keeps_the_last_token_of_its_own_encoding(codec):
    for piece in (b" international", b"aaaaaaaaaaaaa", b"            ", b" nonsensewordings", bytes(range(128, 160))):
        last = codec.last_tokens(piece)
        assert last[0] == -1
        for n in range(1, len(piece) + 1):
            assert last[n] == merged(codec, piece[:n])[-1]


def test_a_piece_of_a_million_bytes(plain, codec):
    for text in ("a" * 1_000_000, " " * 1_000_000, "ab" * 500_000):
        assert ids_of(codec, text) == plain.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, plain):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (None, "no id", "x"), (4, "twice", "x"), (4, "twice", "x"), (5, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(df, byte_tokenizer_path())
    got = bpe.decode_documents(encoded, byte_tokenizer_path()).collect()
    expected = [(i, plain.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    named = spark.createDataFrame([("k", "hello")], "doc_id string, text string")
    assert bpe.encode_documents(named, byte_tokenizer_path()).first().doc_id == "k"
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(nothing, byte_tokenizer_path()).count() == 0
    unknown = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode_documents(unknown, byte_tokenizer_path()).first().text == ""


def test_files_with_other_rules_are_refused(tmp_path):
    with open(byte_tokenizer_path(), encoding="utf-8") as file:
        data = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**data["model"], "ignore_merges": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**data, **change}))
        with pytest.raises(ValueError):
            bpe.Codec(str(path))
