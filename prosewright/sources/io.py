"""JSON-lines sources and sinks with explicit schemas and an explicit row order."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosewright.functions import patterns as P

S = T.StringType()
SAMPLE = T.StructType([T.StructField(n, S) for n in ("id", "label", "source", "text")])
TRANSFORM = T.StructType([T.StructField(n, S) for n in ("instruction", "response", "system")])
BENCHMARK = T.StructType(
    [T.StructField(n, S) for n in ("id", "label", "domain", "instruction", "text", "text_preview", "source", "generator")]
    + [T.StructField("text_is_preview", T.BooleanType()), T.StructField("overall_score", T.DoubleType()), T.StructField("per_dim", T.MapType(S, T.DoubleType()))]
)
SEED = T.StructType([T.StructField(n, S) for n in ("id", "instruction", "response", "domain", "source", "discourse_role", "source_dataset", "length_band")] + [T.StructField("word_count", T.LongType()), T.StructField("anchors_count", T.LongType())])


#: A table with less than this for each core is dealt out anew before costly work.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out evenly over the cores: its few row groups would leave most of them idle. A large one is as it was."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(4 * cores) if size < cores * SPREAD_BYTES else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """Blank lines are skipped, a broken line raises; a missing path is empty with ``missing_ok``."""
    if missing_ok:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of text files: ``row_idx``, a line's number from 0 with blank lines counted, and ``raw``.

    Lines are counted in each split of a file and numbered from the counts of
    the splits before it: one row a split meets in one place, never the lines.
    """
    split = ["__file", "__block"]
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    counts = lines.groupBy(*split).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return lines.join(starts, split).select((F.col("__before") + F.col("__at") - F.col("__first")).alias("row_idx"), "raw")


def read_ordered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_jsonl`` with ``row_idx``, the number of a row's line from 0 (blank lines count, and are skipped) and ``raw``, the line itself."""
    rows = numbered_lines(spark, path).filter("trim(raw) <> ''")
    return rows.select("row_idx", "raw", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("r")).select("row_idx", "raw", "r.*")


def candidates(spark: SparkSession, path: str, prefix: str = "pair") -> DataFrame:
    """Usable rows of a transform's output with ``original``, the key by which candidates belong together."""
    return transform_rows(read_ordered(spark, path, TRANSFORM), prefix)


def original_text(system: Column) -> Column:
    """The text a transform started from, kept as JSON in ``system``; empty if it can't be read."""
    return F.coalesce(F.get_json_object(system, "$.transform_original.text"), F.lit(""))


def transform_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Usable rows of a transform's output (``row_idx``, instruction, response, system): the id keeps the number of the line, unusable rows leave gaps."""
    return (
        rows.withColumn("original", original_text(F.col("system")))
        .filter((F.col("original") != "") & (F.coalesce("response", F.lit("")) != ""))
        .withColumn("id", F.format_string(f"{prefix}_%03d", "row_idx"))
    )


def infer_domain(domain: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(domain, F.lit("")), F.when(source.isin(P.DOMAINS), source), F.lit("unknown"))


def normalized(rows: DataFrame) -> DataFrame:
    """Benchmark rows with their defaults filled in."""
    text = F.nullif("text", F.lit(""))
    source = F.coalesce("source", F.lit("unknown"))
    return rows.select(
        "id",
        "label",
        F.coalesce(text, F.col("text_preview"), F.lit("")).alias("text"),
        source.alias("source"),
        infer_domain(F.col("domain"), source).alias("domain"),
        F.coalesce("generator", F.lit("unknown")).alias("generator"),
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.coalesce("text_is_preview", text.isNull()).alias("text_is_preview"),
        "overall_score",
        "per_dim",
    )


def domain_by_text(seeds: DataFrame) -> DataFrame:
    """Stripped seed text to its domain; of equal texts the last row counts."""
    from prosewright.functions.text import strip

    return seeds.groupBy(strip(F.col("response")).alias("original")).agg(F.max_by("domain", "row_idx").alias("domain"))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, one_file: bool = False) -> None:
    """JSON lines; null fields are left out. With ``order`` the part files follow each other in it; ``one_file`` is for small tables."""
    out = df.orderBy(order) if order else df
    out = out.coalesce(1).sortWithinPartitions(order) if one_file and order else out.coalesce(1) if one_file else out
    (out.drop(order) if order else out).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_raw(df: DataFrame, path: str) -> None:
    """The lines as they were read, in their order over the part files."""
    df.orderBy("row_idx").select("raw").write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one piece."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def with_position(rows: DataFrame, order: str = "row_idx", block: int = 1 << 16) -> DataFrame:
    """``pos`` from 0 over a whole-numbered order. Rows are numbered within blocks of ``block`` numbers and from the counts of the blocks before: no task holds all rows."""
    own = rows.withColumn("__block", F.floor(F.col(order) / block))
    counts = own.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__block", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    return own.join(starts, "__block").withColumn("pos", (F.col("__before") + rank).cast("long")).drop("__block", "__before")


def numeric_dims(record: Column) -> Column:
    """The ``per_dim`` object of a JSON record as a map, without members that are no numbers; true and false are 1 and 0."""
    whole = F.from_json(F.get_json_object(record, "$.per_dim"), "map<string,string>")
    number = lambda v: F.coalesce(v.rlike(r"^(?:-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false)$"), F.lit(False))
    return F.transform_values(F.map_filter(whole, lambda k, v: number(v)), lambda k, v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double")))


def single_text(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """One text given or read whole from a file."""
    if path:
        text = "".join(r[0] for r in spark.read.text(os.fspath(path), wholetext=True).take(1))
    if not (text or "").strip():
        raise ValueError("no text")
    return spark.createDataFrame([(text,)], "text string")


def rubric(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
