"""Crowded lines against brute force; nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from prosewright.llm import decontamination, licences, line_dedup, packing, pii, sharding, simhash
from prosewright.llm._common import Scratch

SCHEMA = "doc_id long, text string, fp long, key string, id long, norm string, line_no int, anchor long, h1 long, component_id long"
TEXTS = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "ONE two three four five six"), (5, "wörd " * 20_000), (None, "no id here at all"), (6, " \n\t")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "k", 7, "n", 7, 7, 7, 7) for i, t in TEXTS], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_links_of_crowded_lines_equal_brute_force(spark):
    rng = random.Random(5)
    base = "the common passage that a great many of the documents share, word for word"
    lines = {base}
    while len(lines) < 120:
        s = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é", "ж", "7"])
        lines.add("".join(s))
    rows = [(k, t, len(t)) for k, t in enumerate(sorted(lines))]
    scratch = Scratch(spark)
    frame = scratch.cut(spark.createDataFrame(rows, "id long, norm string, len int"))
    got = {(min(r), max(r)) for r in map(tuple, line_dedup.edit_links(scratch, frame, 2).collect())}
    assert got == {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and distance(x, y) <= 2}


def test_lines(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)


def test_simhash(docs):
    groups = simhash.simhash_groups(docs).collect()
    assert len(groups) == len(TEXTS)
    of = {r["doc_id"]: r["component_id"] for r in groups}
    assert of[1] == of[2] == of[6] == 1 and of[3] == of[4] == 3 and of[5] == 5
    assert [r["fp"] for r in groups if r["doc_id"] in (1, 2, 6)] == [0, 0, 0]
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 3, 5]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_sharding(docs):
    rows = sharding.shard_documents(docs, 3).collect()
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(3)}
    assert sorted(map(len, slots.values())) == [2, 3, 3] and all(v == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0


def test_decontamination(spark, docs):
    passage = " ".join(f"benchmark question number {k} about rivers" for k in range(12))
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string")
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit("before. " + passage + " after")))
    left = decontamination.without_leaks(more, bench)
    assert left.columns == docs.columns and left.count() == len(TEXTS) and left.filter("doc_id = 9").count() == 0
    assert decontamination.without_leaks(more, bench.limit(0)).count() == len(TEXTS) + 1
    assert decontamination.without_leaks(more.limit(0), bench).count() == 0


def test_licences(docs):
    licences.scan(docs).collect()
    assert licences.scan(docs.limit(0)).count() == 0


def test_pii(docs):
    assert pii.find(docs).count() == len(TEXTS)
    assert pii.find(docs.limit(0)).count() == 0


def test_packing(docs):
    pieces = packing.pack_documents(docs, packing.vocabulary_path()).collect()
    whole = {}
    for r in pieces:
        if r["doc_id"] in (1, 2, 5, 6):
            whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert whole[1] == whole[2] == [(0, 1, 1)]
    for parts in whole.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    used = {}
    for r in pieces:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024
    assert packing.pack_documents(docs.limit(0), packing.vocabulary_path()).count() == 0
