"""Pairs and triples of original, machine-styled and rewritten texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions import score as S
from prosewright.functions.text import strip
from prosewright.sources.io import domain_by_text, with_position


def join_by_position(aiified: DataFrame, humanized: DataFrame) -> DataFrame:
    """Triples by place among the usable rows of both sides, ids numbered anew; the shorter side ends it."""
    a = with_position(aiified).select("pos", "instruction", "original", F.col("response").alias("aiified"))
    h = with_position(humanized).select("pos", F.col("response").alias("humanized"))
    return a.join(h, "pos").withColumn("id", F.format_string("triple_%03d", "pos")).drop("pos")


def join_by_text(aiified: DataFrame, humanized: DataFrame) -> DataFrame:
    """Triples by the machine-styled text that the rewrite started from: safe against skipped rows, and an equi-join."""
    a = aiified.select("id", "instruction", "original", F.col("response").alias("aiified"))
    h = humanized.select(F.col("original").alias("aiified"), F.col("response").alias("humanized"))
    return a.join(h, "aiified")


def with_domain(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Triples with the domain of the seed whose text, without white space at its ends, is theirs; ``unknown`` without one."""
    domains = domain_by_text(seeds).withColumnsRenamed({"original": "__original", "domain": "__domain"})
    out = triples.join(domains, strip(F.col("original")) == F.col("__original"), "left")
    return out.withColumn("domain", F.coalesce("__domain", F.lit("unknown"))).drop("__original", "__domain")


def recovery(human: Column, aiify: Column) -> Column:
    """0 where the first delta is 0; negative values are kept."""
    return F.when(aiify == 0, F.lit(0.0)).otherwise(human / F.when(aiify != 0, aiify))


def recovery_positive(human: Column, aiify: Column) -> Column:
    """The gate's variant: 0 unless the first delta is above 0."""
    return F.when(aiify > 0, human / F.when(aiify > 0, aiify)).otherwise(F.lit(0.0))


def score_pairs(pairs: DataFrame) -> DataFrame:
    return S.with_scores(pairs, ["original", "aiified"]).withColumn("delta", F.col("original_score") - F.col("aiified_score"))


def score_triples(triples: DataFrame) -> DataFrame:
    return with_deltas(S.with_scores(triples, ["original", "aiified", "humanized"]))


def with_deltas(scored: DataFrame) -> DataFrame:
    out = scored.withColumns(
        {"aiify_delta": F.col("original_score") - F.col("aiified_score"), "humanize_delta": F.col("humanized_score") - F.col("aiified_score")}
    )
    return out.withColumn("recovery_ratio", recovery(F.col("humanize_delta"), F.col("aiify_delta")))


CLASSES = {"human": "original", "ai": "aiified", "humanized": "humanized"}


def labelled_texts(triples: DataFrame, keep: list[str], labels: tuple[str, ...] = tuple(CLASSES)) -> DataFrame:
    """One row for each text of a triple that has one of ``labels``."""
    parts = ", ".join(f"'{label}', {CLASSES[label]}" for label in labels)
    return triples.selectExpr(*keep, f"stack({len(labels)}, {parts}) AS (label, text)")


def three_classes(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Three labelled rows a triple, by one ``stack``."""
    parts = ", ".join(f"'{label}', {c}, {c}_score, {c}_dims" for label, c in CLASSES.items())
    return scored.selectExpr(*keep, f"stack(3, {parts}) AS (label, text, overall_score, per_dim)")


def sft_pairs(scored: DataFrame, min_delta: float = 0.15) -> DataFrame:
    """Training pairs: rewrites that gained at least ``min_delta``."""
    meta = F.struct(
        "id",
        F.col("instruction").alias("original_instruction"),
        F.round("aiified_score", 4).alias("aiified_score"),
        F.round("humanized_score", 4).alias("humanized_score"),
        F.round("humanize_delta", 4).alias("delta"),
        F.round("recovery_ratio", 4).alias("recovery_ratio"),
    )
    return scored.filter(F.col("humanize_delta") >= min_delta).select(
        F.lit("Rewrite the following text to sound naturally human-written.").alias("instruction"), F.col("aiified").alias("input"), F.col("humanized").alias("output"), meta.alias("metadata")
    )


def fan_out(rows: DataFrame, copies: int = 2, id_col: str = "id") -> DataFrame:
    """Each row ``copies`` times, the id marked with the number of the copy."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit("__c"), "copy"))
