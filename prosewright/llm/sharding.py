"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows go from each block of the input to each shard of a uniformly
shuffled table follows a multivariate hypergeometric law: the row sums are the
block sizes, the column sums the shard sizes. That matrix is drawn first, from
the block sizes alone. Then each block is permuted locally and dealt out by its
row of the matrix, and each shard is permuted again by its own random order.
Shards get their exact sizes, at most one row apart (the law ``rows``).

Blocks are the input's own partitions: each task sorts its rows by a random
number and writes them with their places, so the local permutation moves
nothing between tasks, and what was written stays when tasks are repeated. The
one exchange of rows is that into shards. The slot inside a shard is
the number of rows in the shard's lower buckets plus the rank in the own
bucket, so that no task holds a whole shard.

Only DataFrame functions touch rows; the driver draws the matrix from one
count per block (at most ``MAX_BLOCKS`` of them).

Defined results: a null text has no bytes and the checksum of no bytes; null
ids are kept; repeated rows are dealt one by one; an empty table gives an empty
result; other columns are not read. The same seed deals the same digest alike.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosewright.llm._common import Scratch

MAX_BLOCKS = 65_536
#: Numbers of the matrix; beyond this there are fewer blocks.
MAX_CELLS = 64_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement from ``good + bad``, are good.

    By inversion from the mode: probabilities of neighbouring counts are ratios
    of small products, so it works at any population size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = 12 * (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5 + 30
    low, high = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(low, high, dtype=float)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, high - low))


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """A draw of the matrix with row sums ``blocks`` and column sums ``shards``."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in blocks:
        row, rest, population = [], size, sum(left)
        for s, room in enumerate(left):
            n = hypergeometric(rng, room, population - room, rest) if rest else 0
            row.append(n)
            population -= room
            rest -= n
            left[s] -= n
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _coin(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *cols)


def deal(rows: DataFrame, scratch: Scratch, n_shards: int, seed: int = 1) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` added; columns of these names give way to them.

    ``rows`` is written once, so that a row keeps its place when tasks are repeated.
    """
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    inner = [f"c{k}" for k in range(len(names))]
    dealt = _dealt(rows.select(*names).toDF(*inner), scratch, n_shards, seed)
    return dealt.select(*[F.col(c).alias(n) for c, n in zip(inner, names, strict=True)], "shard", "slot")


def _dealt(rows: DataFrame, scratch: Scratch, n_shards: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    # with very many shards blocks are fewer and larger
    most = max(1, min(MAX_BLOCKS, MAX_CELLS // n_shards))
    if rows.rdd.getNumPartitions() > most:
        rows = rows.coalesce(most)
    # equal rows draw equal numbers: which of them comes first makes no difference
    permuted = rows.withColumn("__coin", _coin(seed, *rows.columns)).sortWithinPartitions("__coin").drop("__coin")
    kept = scratch.cut(permuted.withColumn("__n", F.monotonically_increasing_id()))
    placed = kept.withColumns({"__block": F.shiftright("__n", 33).cast("int"), "__rank": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    counted = {r["__block"]: r["count"] for r in placed.groupBy("__block").count().collect()}
    blocks = sorted(counted)
    sizes = shard_sizes(sum(counted.values()), n_shards)
    bounds = [
        (b, np.cumsum(row).tolist())
        for b, row in zip(blocks, communication_matrix([counted[b] for b in blocks], sizes, seed), strict=True)
    ]
    matrix = spark.createDataFrame(bounds, "__block int, __bounds array<long>")
    n_buckets = max(1, max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) // n_shards) * 2
    dealt = scratch.cut(
        placed.join(matrix, "__block")
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b < F.col("__rank"))))
        .withColumn("__coin", _coin(seed + 2, "__n"))
        .withColumn("__bucket", F.shiftrightunsigned("__coin", 33) * F.lit(n_buckets) / F.lit(1 << 31))
        .withColumn("__bucket", F.floor("__bucket").cast("int"))
        .drop("__block", "__bounds", "__rank")
    )
    cells = dealt.groupBy("shard", "__bucket").count().collect()  # n_shards * n_buckets at most
    before, starts = {}, []
    for s, q, n in sorted(tuple(c) for c in cells):
        starts.append((s, q, before.get(s, 0)))
        before[s] = before.get(s, 0) + n
    offsets = spark.createDataFrame(starts, "shard int, __bucket int, __before long")
    scratch.only(dealt)
    again = Window.partitionBy("shard", "__bucket").orderBy("__coin", "__n")
    return (
        dealt.withColumn("__in", F.row_number().over(again).cast("long") - 1)
        .join(F.broadcast(offsets), ["shard", "__bucket"])
        .withColumn("slot", F.col("__before") + F.col("__in"))
        .drop("__bucket", "__before", "__in", "__coin", "__n")
    )


def text_bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of every document with its shard and slot: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    digest = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text_bytes(F.col(text_col))) + 8).cast("long").alias("size"),
        F.crc32(text_bytes(F.col(text_col))).alias("text_crc32"),
    )
    return deal(digest, Scratch(docs.sparkSession), n_shards, seed)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all documents into 24 shards under the law ``rows``."""
    dealt = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
