"""Benchmark datasets and their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions import score as S
from prosewright.sources.io import infer_domain


def parse_triple_id(row_id: Column) -> tuple[Column, Column]:
    """Number and label of ``triple_<n>_<label>``; another form raises."""
    form = r"^triple_(\d+)_([a-z]+)$"
    ok = F.when(row_id.rlike(form), row_id).otherwise(F.raise_error(F.concat(F.lit("unrecognised id: "), row_id)).cast("string"))
    return F.regexp_extract(ok, form, 1).cast("long"), F.regexp_extract(ok, form, 2)


def triple_id(row_id: Column) -> Column:
    return F.regexp_replace(row_id, "_[^_]*$", "")


def first_per_label(rows: DataFrame, n: int, label: str = "label", order: str = "row_idx") -> DataFrame:
    w = Window.partitionBy(label).orderBy(order)
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def build_from_artifacts(scored: DataFrame, seeds: DataFrame, aiified: DataFrame, humanized: DataFrame, max_per_label: int | None = None) -> DataFrame:
    """Normalized benchmark rows: full texts where there are any, previews elsewhere.

    ``seeds``, ``aiified`` and ``humanized`` carry ``pos``, their place among usable rows.
    """
    index, label = parse_triple_id(F.col("id"))
    rows = scored.withColumns({"pos": index, "label": label})
    if max_per_label is not None:
        rows = first_per_label(rows, max_per_label)
    side = lambda df, col: df.select("pos", F.lit(True).alias(f"has_{col}"), F.col("response").alias(col))
    seed = seeds.select("pos", "domain", "instruction", F.col("source").alias("seed_source"), F.col("response").alias("seed_text"))
    joined = rows.join(seed, "pos", "left").join(side(aiified, "ai_text"), "pos", "left").join(side(humanized, "human_text"), "pos", "left")
    is_ = lambda x: F.col("label") == x
    preview = F.coalesce("text_preview", F.lit(""))
    return joined.select(
        "id",
        "label",
        F.coalesce("domain", F.lit("unknown")).alias("domain"),
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.when(is_("human"), F.coalesce("seed_text", preview)).when(is_("ai"), F.coalesce("ai_text", preview)).when(is_("humanized"), F.coalesce("human_text", preview)).otherwise(preview).alias("text"),
        F.when(is_("human"), False).when(is_("ai"), F.col("has_ai_text").isNull()).when(is_("humanized"), F.col("has_human_text").isNull()).otherwise(True).alias("text_is_preview"),
        F.when(is_("human"), F.coalesce("seed_source", F.lit("curated"))).when(is_("ai"), "aiify-v01").when(is_("humanized"), "humanize-v04").otherwise("unknown").alias("source"),
        "overall_score",
    )


def extend_with_new_texts(base: DataFrame, more: DataFrame, scores: DataFrame) -> DataFrame:
    """``base`` and, of ``more``, the first row of each non-empty text that base lacks, with scores by id; domains are inferred at the end."""
    fresh = more.filter(F.coalesce("text", F.lit("")) != "").join(base.select("text").distinct(), "text", "left_anti")
    w = Window.partitionBy("text").orderBy("row_idx")
    first = fresh.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    scored = first.join(last_score(scores), "id", "left")
    source = F.coalesce("source", F.lit("unknown"))
    rows = scored.select("id", "label", F.lit(None).cast("string").alias("domain"), "text", source.alias("source"), F.when(F.col("label") == "human", "human").otherwise(source).alias("generator"), "overall_score")
    return base.unionByName(rows, allowMissingColumns=True).withColumn("domain", infer_domain(F.col("domain"), F.coalesce("source", F.lit("unknown"))))


def last_score(scores: DataFrame) -> DataFrame:
    """One score an id: of repeated ids the last one by ``row_idx`` where there is one, the largest otherwise."""
    by = F.max_by("overall_score", "row_idx") if "row_idx" in scores.columns else F.max("overall_score")
    return scores.groupBy("id").agg(by.alias("overall_score"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of a normalized dataset: ``what`` (samples, label, domain, preview_only), ``value`` and ``n``."""
    keyed = F.explode(F.array(*[F.struct(F.lit(what).alias("what"), value.cast("string").alias("value"), one.cast("long").alias("one")) for what, value, one in (
        ("samples", F.lit(""), F.lit(1)), ("label", F.col("label"), F.lit(1)), ("domain", F.col("domain"), F.lit(1)), ("preview_only", F.lit(""), F.coalesce("text_is_preview", F.lit(False)).cast("int")),
    )]))
    return rows.select(keyed.alias("k")).groupBy("k.what", "k.value").agg(F.sum("k.one").alias("n"))


def split_core(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("core").alias("split"), "id", "label", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("text", F.lit("")).alias("text"), "overall_score")


def rescored(rows: DataFrame) -> DataFrame:
    """Rows without ``overall_score`` get layer 1's of their text; without a text they stay as they are."""
    out = S.with_scores(rows, ["text"]).withColumn("overall_score", F.coalesce("overall_score", F.when(F.coalesce("text", F.lit("")) != "", F.col("text_score"))))
    return out.select(*rows.columns)


def split_ood(rows: DataFrame) -> DataFrame:
    return rows.filter("label = 'ai'").select(F.lit("ood").alias("split"), "id", "label", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("text", F.lit("")).alias("text"), "overall_score")


def split_diagnostics(rows: DataFrame, accepted: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` rows of triples that were not accepted."""
    out = rows.withColumn("triple_id", triple_id(F.col("id"))).join(accepted.select("triple_id").distinct(), "triple_id", "left_anti")
    return out.orderBy("row_idx").limit(most)
