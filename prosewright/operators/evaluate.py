"""Evaluations and reports as small tables, each from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosewright.functions import score as S
from prosewright.functions import text as T
from prosewright.operators import metrics as M

#: Pairs of classes: the first counts as positive.
PAIRS = [("human", "ai"), ("humanized", "ai"), ("human", "humanized")]


def evaluate(samples: DataFrame) -> dict[str, DataFrame]:
    """Everything about labelled texts (``label``, ``text`` and perhaps ``source``, ``domain``): layer 1 is worked out once.

    ``samples`` are the scored rows; ``overall`` has one row with AUROC, the
    best threshold, its accuracy, the confusion there and the class sizes;
    ``per_dim`` is sorted by AUROC, the names deciding ties. Without rows an
    IndexError is raised.
    """
    from prosewright.plans.report import dim_rows

    scored = S.with_scores(samples, ["text"]).withColumnsRenamed({"text_score": "score", "text_dims": "dims"}).withColumn("positive", F.coalesce(F.col("label") == "human", F.lit(False)))
    if not samples.head(1):
        raise IndexError("no samples")
    best = M.best_threshold(scored)
    at = F.col("score") >= F.col("threshold")
    one = lambda df: df.withColumn("__one", F.lit(1))
    counts = one(scored.select("positive", "score")).join(F.broadcast(one(best)), "__one").groupBy("threshold", "accuracy").agg(  # one row
        F.count_if(F.col("positive") & at).alias("tp"), F.count_if(~F.col("positive") & at).alias("fp"), F.count_if(~F.col("positive") & ~at).alias("tn"), F.count_if(F.col("positive") & ~at).alias("fn"),
        F.count_if("positive").alias("n_human"), F.count_if(~F.col("positive")).alias("n_ai"),
    )
    out = {
        "samples": scored,
        "overall": one(counts).join(F.broadcast(one(M.auroc(scored))), "__one").drop("__one"),
        "per_dim": M.auroc(dim_rows(scored).select("dim", F.col("dim_score").alias("score"), "positive"), by=["dim"]).orderBy(F.desc("auroc"), "dim"),
    }
    for name in ("label", "source", "domain"):
        if name in scored.columns:
            out[f"by_{name}"] = M.group_means(scored.withColumn(name, F.coalesce(name, F.lit("unknown"))), [name])
    return out


def pair_report(scored: DataFrame) -> DataFrame:
    """One row of means and deltas of scored pairs."""
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 6).alias(name)
    return scored.agg(mean("original_score", "mean_original"), mean("aiified_score", "mean_aiified"), F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.max("delta"), 6).alias("max_delta"), F.count_if(F.col("delta") > 0.1).alias("effective"))


def triple_report(scored: DataFrame, ready: float = 0.15) -> DataFrame:
    """One row of scored triples: class means, mean recovery and how many are worth training on."""
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 6).alias(name)
    return scored.agg(
        F.count("*").alias("n"), mean("original_score", "mean_original"), mean("aiified_score", "mean_aiified"), mean("humanized_score", "mean_humanized"),
        mean("recovery_ratio", "mean_recovery"), F.count_if(F.col("humanize_delta") > ready).alias("ready"),
    )


def domain_rollup(scored: DataFrame, domain: str = "domain", ready: float = 0.15) -> DataFrame:
    """Means of scored triples for each domain and for ``all`` of them, in one pass; with ``accepted`` if the rows went through the gate."""
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 6).alias(name)
    counts = [F.count("*").alias("n"), F.count_if(F.col("humanize_delta") > ready).alias("ready")]
    if "accepted" in scored.columns:
        counts.append(F.count_if("accepted").alias("accepted"))
    rows = scored.rollup(domain).agg(
        *counts, mean("original_score", "mean_original"), mean("aiified_score", "mean_aiified"), mean("humanized_score", "mean_humanized"), mean("aiify_delta", "mean_aiify_delta"), mean("humanize_delta", "mean_humanize_delta"),
    )
    return rows.select(F.coalesce(domain, F.lit("all")).alias("domain"), *[c for c in rows.columns if c != domain])


def gate_savings(scores: DataFrame, score: str = "score", context: str = "source_scoring") -> DataFrame:
    """How many texts the costly judge is spared."""
    skipped = F.count_if(~S.needs_layer2(F.col(score), context))
    return scores.agg(F.count("*").alias("n"), skipped.alias("skipped"), F.round(F.try_divide(100.0 * skipped, F.count("*")), 6).alias("percent"))


def seed_stats(seeds: DataFrame) -> DataFrame:
    """Least, upper median and most words and anchors of seeds by domain; from a histogram, so no group is gathered."""
    counts = seeds.groupBy("domain", "word_count").agg(F.count("*").alias("n"), F.min("anchors_count").alias("lo"), F.max("anchors_count").alias("hi"))
    w = Window.partitionBy("domain")
    placed = counts.withColumns({"upto": F.sum("n").over(w.orderBy("word_count")), "all": F.sum("n").over(w)})
    median = F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("word_count"))).alias("median_words")
    return placed.groupBy("domain").agg(F.sum("n").alias("n"), F.min("word_count").alias("min_words"), median, F.max("word_count").alias("max_words"), F.min("lo").alias("min_anchors"), F.max("hi").alias("max_anchors"))


def layer_means(rows: DataFrame) -> DataFrame:
    """Per label the means of layer 1 (``score``), of layer 2 where it was asked, and of the final score."""
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 6).alias(name)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count("l2_overall").alias("n_l2"), mean("score", "mean_l1"), mean("l2_overall", "mean_l2"), mean("final", "mean_final"))


def pairs_of(rows: DataFrame) -> DataFrame:
    """Rows with a label, once for each pair of classes that it belongs to: ``pair`` and ``positive``."""
    side = lambda p, n, positive: F.struct(F.lit(f"{p}_vs_{n}").alias("pair"), F.lit(positive).alias("positive"))
    names = F.array(*[F.when(F.col("label") == p, side(p, n, True)).when(F.col("label") == n, side(p, n, False)) for p, n in PAIRS])
    return rows.withColumn("__p", F.explode(F.array_compact(names))).select("*", "__p.*").drop("__p")


def layer_aurocs(rows: DataFrame) -> DataFrame:
    """AUROC of layer 1 and of the final score for each pair of classes."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), F.col(c).alias("value")) for name, c in (("l1", "score"), ("combined", "final"))]))
    each = pairs_of(rows).select("pair", "positive", values.alias("v")).select("pair", "positive", "v.layer", F.col("v.value").alias("score"))
    return M.auroc(each, by=["layer", "pair"])


def rounded_dims(dims: Column) -> Column:
    """A map of dimensions to four digits."""
    return F.transform_values(dims, lambda k, v: S.rounded(v, 4))


def combined_records(rows: DataFrame) -> DataFrame:
    """Records of both layers; what layer 2 did not say is null, and left out of the file."""
    l1 = F.map_from_arrays(F.array(*map(F.lit, S.DIMENSIONS)), F.array(*[F.col(f"dims.{d}") / 10.0 for d in S.DIMENSIONS]))
    spoken = F.col("l2_overall").isNotNull()
    return rows.select(
        "label", S.rounded(F.col("score"), 4).alias("l1_overall"), l1.alias("l1_per_dim"), S.rounded(F.col("l2_overall"), 4).alias("l2_overall"), F.when(spoken, rounded_dims(F.col("l2_per_dim"))).alias("l2_per_dim"),
        F.when(spoken, F.col("raw")).alias("l2_raw"), F.when(spoken, F.col("reasoning")).alias("l2_reasoning"), S.rounded(F.col("final"), 4).alias("combined_overall"), T.preview(T.text_of(F.col("text")), 150).alias("text_preview"),
    )


def scored_records(rows: DataFrame) -> DataFrame:
    """Scored samples as they are exported: four digits, a preview of 100 characters."""
    dims = F.map_from_arrays(F.array(*map(F.lit, S.DIMENSIONS)), F.array(*[F.col(f"dims.{d}") / 10.0 for d in S.DIMENSIONS]))
    return rows.select("id", "label", F.coalesce("source", F.lit("unknown")).alias("source"), S.rounded(F.col("score"), 4).alias("overall_score"), dims.alias("per_dim"), T.preview(T.text_of(F.col("text")), 100, "...").alias("text_preview"))


def accepted_pairs(gated: DataFrame) -> DataFrame:
    """Training pairs of the triples that the gate accepted."""
    return gated.filter("accepted").select("id", "domain", F.col("aiified").alias("input"), F.col("humanized").alias("output"), S.rounded(F.col("humanize_delta"), 4).alias("humanize_delta"), S.rounded(F.col("aiify_delta"), 4).alias("aiify_delta"), "suspicion_flags")


def review_queue(diagnostics: DataFrame, most: int = 10, order: str = "row_idx") -> DataFrame:
    """The first diagnostics, for people to look at."""
    return diagnostics.orderBy(order).limit(most).select("id", "triple_id", "label", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.col("overall_score").alias("score"))
