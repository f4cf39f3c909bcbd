"""Manifests and octopus proofs against trees built the plain way."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillwise.llm import merkle

KINDS = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def path(levels, place):
    steps = []
    for level in levels[:-1]:
        other = place ^ 1
        steps.append((place % 2 == 1, level[other] if other < len(level) else None))
        place >>= 1
    return steps


def fold(digest, steps):
    for left, other in steps:
        digest = h(digest) if other is None else h(other, digest) if left else h(digest, other)
    return digest


def plain(rows):
    """{(doc_id, leaf, subroot, root, steps)} as a sorted list, one entry per row."""
    by_lang = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        by_lang.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf, doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels_of([leaf for _, leaf, _ in sorted(by_lang[lang], key=lambda r: r[:2])]) for lang in langs}
    upper = levels_of([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, (_, leaf, doc_id) in enumerate(sorted(by_lang[lang], key=lambda r: r[:2])):
            out.append((doc_id, leaf, trees[lang][-1][0], upper[-1][0], path(trees[lang], place) + path(upper, k)))
    return sorted(out, key=repr)


def proofs(made, leaves=None):
    return sorted(
        ((r.payload.doc_id, r.digest, r.top, made.root, [(s.left, s.digest) for s in r.steps]) for r in made.prove(leaves).collect()),
        key=repr,
    )


def check(spark, rows, kinds=KINDS):
    made = merkle.manifest(spark.createDataFrame(rows, kinds))
    got, expected = proofs(made), plain(rows)
    assert got == expected
    assert all(fold(leaf, steps) == root for _, leaf, _, root, steps in got)


ODD = [
    (1, "a", "en", 3, "abc"), (2, None, "en", None, None), (3, "a", None, 0, ""), (None, "a", None, 1, "é"),
    (None, None, None, None, None), (None, None, None, None, None), (5, "b", "", 2, "x" * 200_000), (5, "b", "", 2, "other"),
    (5, "b", "", 2, "other"), (-7, "b", "é", 2, "ünï"), (8, "b", "zz", 2, "1:2"), (9, "1:b", "zz", 2, "-"),
]


def test_nulls_ties_repeats_and_many_languages(spark):
    check(spark, ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 511, 512, 513, 1025])
def test_trees_of_all_shapes(spark, n):
    check(spark, [(k, "s", "de" if k % 5 else "fr", k, f"text {k}") for k in range(n)])


def test_an_empty_table(spark):
    made = merkle.manifest(spark.createDataFrame([], KINDS))
    assert made.root is None and made.prove().count() == 0


def test_clashing_columns_do_not_matter(spark):
    names = ("tree", "pos", "n", "digest", "payload", "row", "part", "block", "steps")
    df = spark.createDataFrame(ODD, KINDS).select("*", *[F.lit("x").alias(c) for c in names])
    assert proofs(merkle.manifest(df)) == plain(ODD)


def test_one_language_with_equal_rows_is_dealt_out(spark):
    check(spark, [(7, "s", "de", 1, "same")] * 1500 + [(None, "s", "de", 1, "same")] * 700)


def test_proofs_of_some_leaves_only(spark):
    rows = [(k, "s", "de" if k % 3 else None, k, f"text {k}") for k in range(3000)]
    made = merkle.manifest(spark.createDataFrame(rows, KINDS))
    some = made.leaves.where(F.crc32(F.col("payload.doc_id").cast("string").cast("binary")) % 50 == 0)
    expected = [r for r in plain(rows) if zlib.crc32(str(r[0]).encode()) % 50 == 0]
    assert len(expected) > 20 and proofs(made, some) == expected


def test_columns_fold_like_plain_code_and_show_tampering(spark):
    made = merkle.manifest(spark.createDataFrame(ODD, KINDS))
    found = made.prove().select("digest", "steps", merkle.folded(F.col("digest"), "steps").alias("root"),
                                merkle.folded(F.lit("0" * 64), "steps").alias("wrong"), merkle.proof_digest("steps").alias("proof"))
    for r in found.collect():
        steps = [(s.left, s.digest) for s in r.steps]
        assert r.root == fold(r.digest, steps) == made.root
        assert r.wrong == fold("0" * 64, steps) != made.root
        assert r.proof == h(*[d for _, d in steps if d])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1), min_size=1))))
def test_what_is_fetched_is_enough_and_no_more(case):
    n, chosen = case
    levels = levels_of([h(str(k)) for k in range(n)])
    places = np.array(sorted(chosen))
    lacking = [(k, p) for k, (_, m) in enumerate(merkle.known_and_missing(places, n)) for p in m.tolist()]
    needed = {(k, (p >> k) ^ 1) for p in chosen for k in range(len(levels) - 1) if (p >> k) ^ 1 < len(levels[k])}
    given_ = {(k, p >> k) for p in chosen for k in range(len(levels))}
    assert sorted(lacking) == sorted(needed - given_)
    fetched = {(k, p): levels[k][p] for k, p in lacking}
    found = merkle.derived(places, [levels[0][p] for p in places], n, fetched)
    for p in chosen:
        assert [(s["left"], s["digest"]) for s in merkle.steps_of(p, found)] == path(levels, p)
