"""SimHash groups against comparing all fingerprints, with buckets of every size, and on odd rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from veilspark.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lowered = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius):
    """The least member of each fingerprint's component."""
    prints = np.unique(np.array(sorted(prints), np.uint64))
    root = np.arange(len(prints))
    for i, x in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= radius):
            a, b = sorted((root[i], root[j]))
            root[root == b] = a
    return {int(x): int(prints[r]) for x, r in zip(prints, root)}


def brute_report(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_roots({p for _, p in prints}, 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for i, p in prints), key=str)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, simhash.report(docs).collect()), key=str) == brute_report(docs.collect())


@pytest.fixture(scope="module")
def clouds():
    """Dense clouds of fingerprints around a few centres, chains of small steps, and lone ones."""
    draw = np.random.default_rng(5)
    made = set(draw.integers(0, 2**64, 300, dtype=np.uint64).tolist())
    for centre in draw.integers(0, 2**64, 4, dtype=np.uint64).tolist():
        for _ in range(250):
            flips = draw.choice(64, draw.integers(0, 7), replace=False)
            made.add(centre ^ sum(1 << int(p) for p in flips))
        for _ in range(60):
            centre ^= sum(1 << int(p) for p in draw.choice(64, 3, replace=False))
            made.add(centre)
    return made


@pytest.mark.parametrize("radius,limit", [(3, 16_384), (3, 100), (3, 40), (1, 16), (0, 8)])
def test_groups_of_clouds(spark, clouds, radius, limit):
    """Splitting buckets further changes nothing."""
    prints = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in clouds], "print long")
    found = simhash.components(simhash.links(prints, radius, limit)).collect()
    want = brute_roots(clouds, radius)
    parts, got = {}, {}
    for p, r in want.items():
        parts.setdefault(r, set()).add(p)
    for r in found:
        got.setdefault(r["root"], set()).add(r["node"] & 2**64 - 1)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in parts.values() if len(x) > 1)


def test_links_stay_few(spark, clouds):
    prints = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in clouds], "print long")
    assert simhash.links(prints).count() < 4 * len(clouds)


def test_planes():
    draw = np.random.default_rng(1).integers(0, 2**64, 130, dtype=np.uint64)
    vertical = simhash.planes(draw)
    for i, x in enumerate(draw.tolist()):
        assert sum((int(vertical[p][i // 64]) >> i % 64 & 1) << p for p in range(64)) == x


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len(rows) == len(ODD)
    crowded = odd
    for name in ("id", "print", "root", "least", "mask", "value", "count", "component_id"):
        crowded = crowded.withColumn(name, F.lit("mine"))
    got = sorted(map(tuple, simhash.report(crowded).collect()), key=str)
    assert got == brute_report(rows)
    assert {r[2] for r in got if r[1] == "0" * 16} == {1}
    assert simhash.report(empty).count() == 0


def test_giant_texts(documents):
    endless, many = "x" * 4_000_000, "ab cd ef " * 400_000
    got = {r["doc_id"]: r for r in simhash.report(documents([(1, endless, None, None, 0), (2, many, None, None, 0), (3, many + "gh", None, None, 0)])).collect()}
    assert got[1]["fingerprint"] == f"{xxhash.xxh64_intdigest(endless.encode(), seed=42):016x}"
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[3]["component_id"] == 2
