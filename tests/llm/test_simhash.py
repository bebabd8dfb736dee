"""Fingerprints and their links against brute force, with either number of pieces."""

import random

import pytest

from prosewright.llm import simhash
from tests.llm.test_near_copies import edited


def plain_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, links):
    of = {i: i for i in ids}
    for a, b in links:
        if of[a] != of[b]:
            old, new = max(of[a], of[b]), min(of[a], of[b])
            of = {i: new if c == old else c for i, c in of.items()}
    return of


@pytest.mark.parametrize("pieces", [2, 3])
def test_links_equal_brute_force(spark, pieces):
    rng, values = random.Random(pieces), [0, 1, 2**63, 2**64 - 1]
    for _ in range(120):
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            values.append(y)
    signed = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, pieces).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_query_equals_brute_force(spark):
    rng, texts = random.Random(1), [None, "", "one", "One", "a b c d", "A b\tc\nd", "é É x y z"]
    for _ in range(25):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randint(3, 300))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, 0.01)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    of = components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert got == {i: (p, of[i]) for i, p in enumerate(prints)}


def test_more_fingerprints_ask_for_larger_pieces():
    assert simhash.pieces_for(1000) == 3 and simhash.pieces_for(10**9) == 2


@pytest.mark.parametrize("pieces", [2, 3])
def test_replicas_are_not_broadcast(spark, tmp_path, pieces):
    spark.range(1000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fps")
    plan = simhash.near_pairs(spark.read.parquet(f"{tmp_path}/fps"), 4, pieces)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
