"""Best of several candidates, one window a choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions.extract import length_ratio

MIDPOINT, LENGTH_CAP, OVERSHOOT, MIN_DELTA = 0.30, 1.25, 0.05, 0.30


def _best(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def aiify_best(candidates: DataFrame, text: Column | None = None) -> DataFrame:
    """Per ``original`` the ``response`` within the length cap whose ``score`` is nearest the middle of the band; first row on ties.

    ``text`` is the original's words where ``original`` is another key."""
    tier = (length_ratio(F.col("response"), F.col("original") if text is None else text) > LENGTH_CAP).cast("int")
    return _best(candidates.withColumns({"tier": tier, "distance": F.abs(F.col("score") - MIDPOINT)}), "original", F.col("tier"), F.col("distance"), F.col("row_idx"))


def humanize_best(candidates: DataFrame) -> DataFrame:
    """Per ``aiified`` the response with the largest gain, those that do not overshoot the original first; an unknown ``original_score`` is 1."""
    original = F.coalesce("original_score", F.lit(1.0))
    delta = F.col("score") - F.col("aiified_score")
    tier = F.when((delta >= MIN_DELTA) & (F.col("score") <= original + OVERSHOOT), 0).when(delta >= MIN_DELTA, 1).otherwise(2)
    ranked = candidates.withColumns({"tier": tier, "delta": delta, "distance": F.abs(F.col("score") - original)})
    return _best(ranked, "aiified", F.col("tier"), -F.col("delta"), F.col("distance"), F.col("row_idx"))


def selection_report(candidates: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """Per group: number of candidates, their scores in row order, and the one chosen."""
    each = candidates.groupBy(group).agg(
        F.count("*").alias("n_candidates"), F.array_sort(F.collect_list(F.struct("row_idx", F.round("score", 4).alias("score"), "words"))).alias("candidates")
    )
    return each.join(chosen.select(group, F.round("score", 4).alias("chosen_score"), F.col("words").alias("chosen_words")), group)


def original_scores(selected: DataFrame, originals: DataFrame) -> DataFrame:
    """Machine-styled text to its human original's score, over two hops; unmatched texts are absent."""
    return selected.join(originals.select("original", F.col("score").alias("original_score")), "original").select(F.col("response").alias("aiified"), "original_score").dropDuplicates(["aiified"])
