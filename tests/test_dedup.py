import random
from itertools import combinations

import numpy as np
import pytest
from fernglass import queries
from fernglass.model import ITEM
from fernglass.operators import dedup
from fernglass.operators.components import connected_components
from pyspark.sql import functions as F


def items(spark, rows):
    return spark.createDataFrame([(p, n, 1, None, h, s) for p, n, h, s in rows], ITEM)


def outcome(spark, rows, **more):
    found = dedup.deduplicate(items(spark, rows), **more).collect()
    return {r.path for r in found if not r.is_duplicate}, {r.path: r.keeper_path for r in found}


@pytest.mark.parametrize(
    ("rows", "keepers"),
    [
        ([("a.jpg", 100, 0x11, 0xABCD), ("bb.jpg", 100, 0x22, 0xABCD)], {"a.jpg"}),
        ([("a.jpg", 500, 0x20, 1), ("b.jpg", 100, 0x3F, 2)], {"a.jpg"}),
        ([("a.jpg", 100, 0x0001, 1), ("b.jpg", 100, 0xFFFF, 2)], {"a.jpg", "b.jpg"}),
        ([("a.jpg", 500, 0x400, 1), ("b.jpg", 300, 0x41F, 2), ("c.jpg", 100, 0x7E0, 3)], {"a.jpg"}),
        ([("v1.mp4", 100, 0, 0), ("v2.mp4", 100, None, None)], {"v1.mp4", "v2.mp4"}),
        ([("x1.jpg", 400, 1, 0x99), ("x2.jpg", 400, 1, 0x99), ("n.jpg", 100, 3, 7), ("lone.jpg", 100, 0xFFFF, 8)], {"x1.jpg", "lone.jpg"}),
        ([("a.jpg", 1, 0x3F, 1), ("b.jpg", 1, 0, 2)], {"a.jpg", "b.jpg"}),
        ([("a.jpg", 9, -1, 1), ("b.jpg", 1, -32, 2)], {"a.jpg"}),
        ([("h1.jpg", 5, 0, 3), ("h2.jpg", 5, 0, 3)], {"h1.jpg"}),
        ([], set()),
    ],
)
def test_keepers(spark, rows, keepers):
    assert outcome(spark, rows)[0] == keepers


def test_keeper_follows_both_tiers(spark):
    rows = [("big.jpg", 900, 0xF0, 1), ("c1.jpg", 100, 0xF1, 2), ("c22.jpg", 100, 0xF1, 2)]
    assert outcome(spark, rows)[1] == {"big.jpg": "big.jpg", "c1.jpg": "big.jpg", "c22.jpg": "big.jpg"}


@pytest.mark.parametrize("scheme", ["slices", "triples"])
def test_pairs_against_brute_force(spark, scheme):
    draw = random.Random(5)
    hashes = [draw.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        for _ in range(draw.randint(1, 7)):
            h ^= 1 << draw.randrange(64)
        hashes.append(h)
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    found = dedup.near_pairs(spark.createDataFrame([(h,) for h in hashes + hashes[:5]], "h long"), scheme=scheme).collect()
    distinct = sorted(set(hashes))
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 5}
    assert want and sorted((r.a, r.b) for r in found) == sorted(want)


@pytest.mark.parametrize("scheme", ["slices", "triples"])
def test_pairs_of_crowded_keys(spark, monkeypatch, scheme):
    """Keys that many hashes share are blocked again, and keys go on over the rows that a task holds at once."""
    monkeypatch.setattr(dedup, "CROWD", 3)
    monkeypatch.setattr(dedup, "ROWS", 50)
    draw = random.Random(8)
    hashes = [draw.getrandbits(30) << draw.choice([0, 20, 34]) for _ in range(150)] + list(range(70))
    hashes += [h ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for h in hashes]
    distinct = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    found = dedup.near_pairs(spark.createDataFrame([(h,) for h in distinct], "h long"), scheme=scheme).collect()
    want = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 5]
    assert len(want) > 2000 and sorted((r.a, r.b) for r in found) == sorted(want)


def test_dense_keys_are_not_compared_over_and_over(monkeypatch):
    """Hashes of few bits share most of their slices: blocking them again would look at the same pairs in each of those."""
    h = np.array([sum(1 << b for b in on) for n in range(4) for on in combinations(range(24), n)], np.uint64)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    found = [p for a, b in dedup._close_pairs(h, np.zeros_like(h), (1 << 64) - (1 << 24), 5) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(a, b) for a, b in combinations(h.tolist(), 2) if (a ^ b).bit_count() <= 5]
    assert sorted((min(p), max(p)) for p in found) == sorted((min(p), max(p)) for p in want)
    assert sum(compared) <= len(h) ** 2


def test_no_hash_travels_with_its_keys(spark):
    """What is dealt is a key and a hash: 20 bytes, and a plan without a join of lists of keys."""
    plan = dedup.near_pairs(spark.range(9).select(F.col("id").alias("h")), scheme="triples")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array" not in plan and "Generate" not in plan


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_components_reads_documents_once(spark):
    """Both sides of the exact tier's join go by a written table of items, not by two computations of it."""
    files = queries._stand_ins(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("documents.parquet" in f for f in files)


@pytest.mark.parametrize("name", ["dedup_full", "dedup_summary"])
def test_deduplication_takes_written_items(spark, monkeypatch, name):
    given = []
    whole = dedup.deduplicate
    monkeypatch.setattr(dedup, "deduplicate", lambda items: given.append(items.inputFiles()) or whole(items))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() in (1, 200)
    assert given[0] and not any("documents.parquet" in f for f in given[0])
