"""The shuffle's law: sizes, slots, uniform places, many shards, clashing names."""

from collections import Counter
from zlib import crc32

from prosewright.llm import sharding
from prosewright.llm._common import Scratch


def test_digest_and_law(spark):
    rows = [(i, "é" * (i % 5) if i % 7 else None, i) for i in range(1000)] + [(None, "x", 1), (3, "same", 1), (3, "same", 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, slot int"), 24).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t, _ in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_places_are_uniform(spark):
    """Over seeds, each row is equally often in each shard and in each half of it; neighbours are not kept together."""
    docs = spark.range(60).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "CAST(doc_id AS STRING) AS text").cache()
    shards, halves, together = Counter(), Counter(), 0
    seeds = 30
    for seed in range(seeds):
        got = {r["doc_id"]: r for r in sharding.shard_documents(docs, 3, seed=seed).collect()}
        shards.update(r["shard"] for i, r in got.items() if i < 20)
        halves.update(r["slot"] < 10 for i, r in got.items() if i < 20)
        together += sum(got[i]["shard"] == got[i + 1]["shard"] for i in range(0, 60, 2))
    n = 20 * seeds
    # within four standard deviations
    assert all(abs(shards[s] - n / 3) < 4 * (n * 2 / 9) ** 0.5 for s in range(3)) and abs(halves[True] - n / 2) < 4 * (n / 4) ** 0.5
    assert abs(together - 30 * seeds * 19 / 59) < 4 * (30 * seeds * 0.32 * 0.68) ** 0.5


def test_more_shards_than_the_matrix_holds_at_full_size(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_CELLS", 5000)
    rows = spark.range(3000).selectExpr("id", "id AS shard", "id AS __n", "id AS c0", "id AS __block")
    got = sharding.deal(rows, Scratch(spark), 1000).collect()
    assert Counter(Counter(r["shard"] for r in got).values()) == {3: 1000} and got[0].asDict().keys() == {"id", "__n", "c0", "__block", "shard", "slot"}
    assert sorted(r["c0"] for r in got) == list(range(3000))
