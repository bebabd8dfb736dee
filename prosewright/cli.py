"""Command line: score one text, evaluate samples, score a transform's triples.

    python -m prosewright.cli score [TEXT | --file PATH | < text]
    python -m prosewright.cli bench HUMAN.jsonl AI.jsonl [--out FOLDER]
    python -m prosewright.cli pipeline AIIFIED.jsonl [HUMANIZED.jsonl] [--out FOLDER] [--min-delta X]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions import score as S
from prosewright.operators import evaluate as E
from prosewright.operators import triples as R
from prosewright.plans import report
from prosewright.sources import io


def score(spark: SparkSession, args: argparse.Namespace) -> str:
    text = args.text if args.text or args.file else sys.stdin.read()
    row = S.with_scores(io.single_text(spark, text, args.file), ["text"]).first()
    return report.score_card(row["text_score"], {k: v / 10 for k, v in row["text_dims"].asDict().items()})


def bench(spark: SparkSession, args: argparse.Namespace) -> str:
    samples = io.read_jsonl(spark, args.human, io.SAMPLE).unionByName(io.read_jsonl(spark, args.ai, io.SAMPLE))
    found = E.evaluate(samples)
    if args.out:
        io.write_jsonl(E.scored_records(found["samples"]), f"{args.out}/scored")
    return "\n".join(report.table_text(found[k], k) for k in found if k != "samples")


def triples_of(spark: SparkSession, aiified: str, humanized: str) -> DataFrame:
    a = io.candidates(spark, aiified, "pair").select("row_idx", "instruction", "original", "response")
    h = io.candidates(spark, humanized, "triple").select("row_idx", "original", "response")
    return R.score_triples(R.join_by_position(a, h))


def pipeline(spark: SparkSession, args: argparse.Namespace) -> str:
    if not args.humanized:
        pairs = R.score_pairs(io.candidates(spark, args.aiified).select("id", "instruction", "original", F.col("response").alias("aiified")))
        return report.table_text(E.pair_report(pairs), "pairs")
    scored = triples_of(spark, args.aiified, args.humanized)
    classes = R.three_classes(scored, ["id"]).withColumnsRenamed({"overall_score": "score", "per_dim": "dims"})
    out = [report.table_text(E.triple_report(scored), "triples"), report.table_text(report.auroc_pairs(classes).orderBy("pair"), "auroc")]
    if args.out:
        io.write_jsonl(R.three_classes(scored, ["id"]), f"{args.out}/benchmark")
        pairs = R.sft_pairs(scored, args.min_delta)
        io.write_jsonl(pairs, f"{args.out}/sft")
        out.append(f"{pairs.count()} training pairs")
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prosewright")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("score")
    one.add_argument("text", nargs="?")
    one.add_argument("--file")
    two = commands.add_parser("bench")
    two.add_argument("human")
    two.add_argument("ai")
    two.add_argument("--out")
    three = commands.add_parser("pipeline")
    three.add_argument("aiified")
    three.add_argument("humanized", nargs="?")
    three.add_argument("--out")
    three.add_argument("--min-delta", type=float, default=0.15)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("prosewright").getOrCreate()
    try:
        print({"score": score, "bench": bench, "pipeline": pipeline}[args.command](spark, args))
    except (ValueError, IndexError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
