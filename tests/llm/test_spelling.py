"""Spelling variants against plain code."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillwise.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, one_in=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def got_variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, spelling.variants(df).collect()))


def many_words(seed, n, letters="abcdeé"):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list(letters), rng.integers(5, 9))): int(rng.integers(3, 60)) for _ in range(n)}
    return words


def test_words_are_counted_and_misspelt_as_stated(spark):
    rng = np.random.default_rng(1)
    pool = ["Garden", "GARDEN", "garten", "Äpfel", "äpfel", "word", "elephant", "naïve", "x×y÷z", "straße"]
    rows = [(int(k) if k % 9 else None, " ".join(rng.choice(pool, 60)) + ". 1a2b") for k in range(200)] + [(5, None), (6, ""), (7, "-!?")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, run string")
    got = {r.word: r.n for r in spelling.counted_words(df).collect()}
    assert got == plain_words(rows)
    assert set(got) - {w.translate(LOW) for w in pool}  # some are misspelt
    assert spelling.counted_words(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_plain_code(spark, seed):
    words = many_words(seed, 400)
    assert got_variants(spark, words) == plain_variants(words)


def test_tiles_of_a_large_block_meet_once(spark, monkeypatch):
    """The same words, with blocks cut into many tiles and visitors into many parts."""
    monkeypatch.setattr(spelling, "TILE", 4)
    words = many_words(7, 500, "abf")  # a and f are of one class
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    dealt = spelling._dealt(df).collect()
    homes = Counter((r.block, r.tile) for r in dealt if not r.visits)
    assert len(dealt) > 3000 and len([h for h in homes if h[1] > 3]) > 5
    assert got_variants(spark, words) == plain_variants(words)


def test_every_near_pair_meets_exactly_once(spark):
    words = many_words(11, 300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    groups = {}
    for r in spelling._dealt(df).collect():
        groups.setdefault((r.block, r.tile), ([], []))[r.visits].append(r.word)
    met = Counter()
    for homes, visitors in groups.values():
        met.update(frozenset(p) for p in combinations(homes, 2))
        met.update(frozenset((a, b)) for a in homes for b in visitors)
    near = [frozenset(p) for p in combinations(words, 2) if one_edit(*p)]
    assert near and all(met[p] == 1 for p in near) and max(met.values()) == 1


def test_ties_chains_and_words_alone(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 5, "yyyyy": 4, "yyyyx": 8, "yyyyw": 8, "qqqqq": 10, "qqqqqq": 19}
    got = got_variants(spark, words)
    assert got == plain_variants(words)
    by = {r[0]: r for r in got}
    assert by["aaaaa"][1:3] == ("aaaab", "aabbb") and by["zzzzz"][1:] == (None, "zzzzz", 5, 0, None)
    assert by["yyyyy"][1] == "yyyyw" and by["qqqqq"][1] is None
    assert got_variants(spark, {}) == []


def test_words_of_a_hundred_thousand_letters(spark):
    long = "abcde" * 20_000
    words = {long: 9, long[:500] + "x" + long[500:]: 3, long[:-1] + "z": 4, "abcde": 3}
    assert got_variants(spark, words) == plain_variants(words)


def test_class_counts_add_up_to_the_length(spark):
    row = spark.createDataFrame([("abcdeéüÿÀ",)], "word string").select(spelling.class_counts(F.col("word"))).first()[0]
    assert row == [sum(ord(c) % 5 == k for c in "abcdeéüÿÀ") for k in range(5)]


WORDS = st.text("abé", min_size=5, max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.sets(WORDS, min_size=1, max_size=20), st.sets(WORDS, min_size=1, max_size=20))
def test_tiles_find_what_is_one_edit_apart(homes, visitors):
    for length in range(5, 8):
        mine = sorted(w for w in homes if len(w) == length)
        if not mine:
            continue
        tile = spelling.Tile(mine, [3] * len(mine))
        for other in (length, length + 1):
            theirs = sorted(w for w in visitors if len(w) == other)
            if theirs:
                i, j = tile.near(theirs)
                assert {(mine[a], theirs[b]) for a, b in zip(i, j)} == {(a, b) for a in mine for b in theirs if one_edit(a, b)}
