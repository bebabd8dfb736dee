"""Shared pieces of the training-data operators: durable cuts of lineage and
distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions.text import fresh  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates.

    The session's ``spark.checkpoint.dir`` is used when it is set (Spark then
    has a checkpoint directory from the start). Where it is unset, a local
    session gets a temporary folder; a cluster session is told to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="prosewright-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


class Scratch:
    """Tables written below the shared folder so that lineage ends there.

    ``cut`` writes a frame as Parquet and reads it back: a lost executor loses
    nothing of it. ``drop`` removes tables that are no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        self._n = 0
        self._made: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._prosewright_path = path
        self._made.append(out)
        return out

    def only(self, *frames: DataFrame) -> None:
        """Removes all tables but those of ``frames``: what a lazy result still reads."""
        kept = {f._prosewright_path for f in frames}
        self.drop(*[f for f in self._made if f._prosewright_path not in kept])
        self._made = [f for f in self._made if f._prosewright_path in kept]

    def again(self, df: DataFrame) -> DataFrame:
        """The same table as a frame of its own, for the other side of a join."""
        return self.spark.read.schema(df.schema).parquet(df._prosewright_path)

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_prosewright_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, by alternating stars.

    ``edges`` has long columns ``a`` and ``b``. Returns one row per vertex of
    ``edges``: ``id`` and ``component`` (the smallest vertex of its component).
    Self loops, repeated edges and empty input are fine.

    Each round replaces edges by edges to smaller vertices: for every vertex,
    larger neighbours are hung on its smallest neighbour ("large star"), then
    smaller ones likewise ("small star"). Minima are partial aggregates, and
    they are written before they are joined, so a vertex with very many
    neighbours never meets in one task: Spark can split that join. The number
    of rounds grows with the logarithm of the longest chain, and is not bounded.
    """
    u, v = F.col("u"), F.col("v")
    edge = scratch.cut(
        edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .filter(u > v)
        .distinct()
    )

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(edge)
    while before[0]:
        both = edge.select(u.alias("x"), v.alias("y")).union(edge.select(v.alias("x"), u.alias("y")))
        low = scratch.cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = scratch.cut(
            both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        new = scratch.cut(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edge, low, large, least)
        edge, after = new, mark(new)
        if after == before:
            break
        before = after
    return edge.select(u.alias("id"), v.alias("component")).union(
        edge.select(v.alias("id"), v.alias("component")).distinct()
    )
