"""SimHash fingerprints and components against plain Python."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillwise.llm import simhash
from tillwise.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    """doc_id -> smallest reachable id, by flooding."""
    fps = {d: plain_fingerprint(t) for d, t in rows}
    ids, seen = sorted(fps), {}
    for d in ids:
        if d in seen:
            continue
        front = [d]
        seen[d] = d
        while front:
            x = front.pop()
            for y in ids:
                if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 4:
                    seen[y] = d
                    front.append(y)
    return {d: (f"{fps[d]:016x}", seen[d]) for d in ids}


def answer(spark, df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_query_equals_plain_python_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert answer(spark, QUERIES["op1_simhash_components"](spark, SMALL)) == expected


def shaped(found):
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c"), (7, "x " * 50_000), (8, "ÄÖ é ß ñ"), (9, "a b c")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    assert answer(spark, shaped(simhash.near_duplicates(df))) == plain_components(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "q")], "doc_id long, text string")
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(map(str, found)) == ["(1, 1)", "(1, 1)", "(None, 1)", "(None, None)"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 4


def planted(n, seed=5):
    """Fingerprints in chains and clouds within the radius, and strangers."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, n // 4, dtype=np.int64)
    out = list(base)
    for b in base:
        x = int(b)
        for _ in range(3):
            for bit in rng.choice(64, 4, replace=False):
                x ^= 1 << int(bit)
            x = x - 2**64 if x >= 2**63 else x
            x = x + 2**64 if x < -(2**63) else x
            out.append(np.int64(np.uint64(x % 2**64).astype(np.int64)))
    return np.unique(np.array(out, np.int64))


@pytest.mark.parametrize("tile", [4, 10**6])
def test_links_connect_exactly_what_is_within_the_radius(spark, tile):
    fps = planted(160)
    cloud = np.array([(7 << 40) | (1 << i) | (1 << j) for i in range(12) for j in range(i, 12)], np.int64)
    fps = np.unique(np.concatenate([fps, cloud]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    found = simhash.components(simhash.fingerprint_links(df, tile=tile))
    got = {r.node: r.root for r in found.collect()}
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    expected = {}
    for k in range(len(fps)):
        group = fps[label == label[k]]
        if len(group) > 1:
            expected[int(fps[k])] = int(group.min())
    assert got == expected


def test_a_forest_is_given_not_all_pairs():
    fps = np.unique(np.array([1 << i for i in range(64)], np.uint64))
    links = simhash.tile_links(fps, 4)
    assert len(links) == len(fps) - 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(900, 960)]
    loop = [(5, 5)]
    df = spark.createDataFrame(chain + star + loop, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 900 for i in [*range(900, 960), 1000]}}
