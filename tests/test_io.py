"""Sources, sinks, reports, the command line and streams, by round trips through files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from prosewright import cli
from prosewright.functions import score as S
from prosewright.operators import datasets as D
from prosewright.operators import evaluate as E
from prosewright.operators import gate as G
from prosewright.operators import judge as J
from prosewright.operators import select as C
from prosewright.operators import triples as R
from prosewright.plans import report
from prosewright.sources import io
from prosewright.streaming.scoring import score_stream

HUMAN = "I've seen this at 11:30 today. We can't say why. They're fine, mostly, and nobody complained about it at all.\nIt wasn't great -- but it's ok."
AI = "Certainly! It is worth noting that it is important to note this. Furthermore, in general, one might argue. Moreover, it is crucial to understand.\n\nI hope this helps!"


def system(text):
    return json.dumps({"transform_original": {"field": "response", "text": text}})


@pytest.fixture()
def transform(tmp_path):
    path = tmp_path / "out.jsonl"
    rows = [
        {"instruction": "a", "response": "first", "system": system("o1")}, None, {"instruction": "b", "response": "", "system": system("o2")},
        {"instruction": "c", "response": "third", "system": "{broken"}, {"instruction": "d", "response": "fourth", "system": system("o4"), "extra": 1}, None, {"response": "sixth", "system": system("o1")},
    ]
    path.write_text("\n".join("" if r is None else json.dumps(r) for r in rows) + "\n")
    return str(path)


def lines_of(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f, encoding="utf-8").read().splitlines()]


def test_ids_keep_the_number_of_the_raw_line(spark, transform):
    got = io.candidates(spark, transform).orderBy("row_idx").collect()
    assert [(r["id"], r["original"], r["response"]) for r in got] == [("pair_000", "o1", "first"), ("pair_004", "o4", "fourth"), ("pair_006", "o1", "sixth")]


def test_line_numbers_over_splits_and_files(spark, tmp_path):
    want = []
    for name, n in (("a", 5000), ("b", 3), ("c", 2000)):
        lines = [f"{name} {k}" if k % 7 else "" for k in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = io.numbered_lines(spark, str(tmp_path)).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["row_idx"] for r in got] == list(range(len(want))) and [r["raw"] for r in got] == want


def test_raw_lines_are_written_as_read_and_in_order(spark, transform, tmp_path):
    rows = io.candidates(spark, transform)
    chosen = C.aiify_best(rows.withColumn("score", F.col("row_idx") / 10.0))
    io.write_raw(chosen, str(tmp_path / "chosen"))
    source = open(transform).read().splitlines()
    assert lines_of(tmp_path / "chosen") == [source[4], source[6]] or lines_of(tmp_path / "chosen") == [source[0], source[4]]


def test_broken_lines_raise_and_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{broken\n')
    with pytest.raises(Exception):
        io.read_ordered(spark, str(tmp_path / "x.jsonl"), io.SAMPLE).collect()
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), io.SAMPLE, missing_ok=True).count() == 0
    (tmp_path / "y.jsonl").write_text('{"id": "1", "text": "t", "more": 2}\n\n{"id": "2"}\n')
    assert [tuple(r) for r in io.read_jsonl(spark, str(tmp_path / "y.jsonl"), io.SAMPLE).orderBy("id").collect()] == [("1", None, None, "t"), ("2", None, None, None)]


def test_json_lines_keep_their_order_and_leave_nulls_out(spark, tmp_path):
    rows = [(k, f"v{k}" if k % 3 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "at int, v string").repartition(5).withColumn("k", F.col("at"))
    for one in (False, True):
        io.write_jsonl(df, str(tmp_path / f"o{one}"), "at", one_file=one)
        assert [json.loads(x) for x in lines_of(tmp_path / f"o{one}")] == [{"k": k} | ({"v": v} if v else {}) for k, v in rows]


def test_positions(spark):
    at = [-70_000, 5, 6, 65_536, 65_537, 10**9]
    got = io.with_position(spark.createDataFrame([(x, 1) for x in at], "row_idx long, pos0 int")).orderBy("row_idx").collect()
    assert [r["pos"] for r in got] == list(range(6))


def test_numeric_dims(spark):
    record = json.dumps({"per_dim": {"a": 0.5, "b": 1, "c": "x", "d": True, "e": None, "f": [1], "g": -2e-1}})
    got = spark.createDataFrame([(record,), ("{}",), ("{bad",)], "r string").select(io.numeric_dims(F.col("r"))).collect()
    assert got[0][0] == {"a": 0.5, "b": 1.0, "d": 1.0, "g": -0.2} and not got[1][0] and not got[2][0]


def test_normalized_and_domains(spark):
    rows = spark.createDataFrame([("1", "human", "", "", "", "pre", "blog", None, None, None, None), ("2", "ai", "email", "i", "t", None, None, "g", False, 0.5, {"a": 1.0})], io.BENCHMARK)
    got = {r["id"]: r for r in io.normalized(rows).collect()}
    assert (got["1"]["text"], got["1"]["domain"], got["1"]["source"], got["1"]["generator"], got["1"]["text_is_preview"]) == ("pre", "blog", "blog", "unknown", True)
    assert (got["2"]["text"], got["2"]["domain"], got["2"]["source"], got["2"]["text_is_preview"]) == ("t", "email", "unknown", False)
    seeds = spark.createDataFrame([(0, " a ", "x"), (1, "a", "y"), (2, "b", "z")], "row_idx int, response string, domain string")
    assert {tuple(r) for r in io.domain_by_text(seeds).collect()} == {("a", "y"), ("b", "z")}


def test_last_of_repeated_scores_counts(spark):
    base = spark.createDataFrame([("0", "ai", "", "known", "s", "g", 0.1)], "id string, label string, domain string, text string, source string, generator string, overall_score double")
    more = spark.createDataFrame([(0, "1", "human", "new", "blog"), (1, "2", "ai", "known", "x"), (2, "3", "ai", "new", "x"), (3, "4", "ai", "", "x")], "row_idx int, id string, label string, text string, source string")
    scores = spark.createDataFrame([(0, "1", 0.3), (1, "1", 0.2), (2, "9", 0.9)], "row_idx int, id string, overall_score double")
    got = sorted((r["id"], r["domain"], r["overall_score"]) for r in D.extend_with_new_texts(base, more, scores).collect())
    assert got == [("0", "unknown", 0.1), ("1", "blog", 0.2)]


def test_build_from_artifacts_with_all_sides(spark):
    scored = spark.createDataFrame([(k, f"triple_{k // 3:03d}_{label}", f"p{k}", 0.5) for k, label in enumerate(["human", "ai", "humanized"] * 2)], "row_idx int, id string, text_preview string, overall_score double")
    side = lambda n, c: spark.createDataFrame([(k, f"{c}{k}") for k in range(n)], "pos long, response string")
    seeds = side(1, "s").withColumns({"domain": F.lit("email"), "instruction": F.lit("i"), "source": F.lit("curated")})
    got = {r["id"]: (r["text"], r["text_is_preview"], r["domain"]) for r in D.build_from_artifacts(scored, seeds, side(2, "a"), side(1, "h")).collect()}
    assert got == {"triple_000_human": ("s0", False, "email"), "triple_000_ai": ("a0", False, "email"), "triple_000_humanized": ("h0", False, "email"), "triple_001_human": ("p3", False, "unknown"), "triple_001_ai": ("a1", False, "unknown"), "triple_001_humanized": ("p5", True, "unknown")}


def samples(spark):
    return spark.createDataFrame([(f"s{k}", "human" if k % 2 else "ai", None if k == 3 else "blog", (HUMAN if k % 2 else AI) + f" Number {k}.") for k in range(8)], "id string, label string, source string, text string")


def test_evaluation_in_one_call(spark, tmp_path):
    found = E.evaluate(samples(spark))
    overall = found["overall"].first().asDict()
    assert (overall["auroc"], overall["accuracy"], overall["tp"], overall["fp"], overall["tn"], overall["fn"], overall["n_human"], overall["n_ai"]) == (1.0, 1.0, 4, 0, 4, 0, 4, 4)
    dims = [(r["auroc"], r["dim"]) for r in found["per_dim"].collect()]
    assert dims == sorted(dims, key=lambda x: (-x[0], x[1])) and len(dims) == 8
    assert {r["source"]: r["n"] for r in found["by_source"].collect()} == {"blog": 7, "unknown": 1}
    io.write_jsonl(E.scored_records(found["samples"]), str(tmp_path / "scored"))
    rows = [json.loads(x) for x in lines_of(tmp_path / "scored")]
    assert len(rows) == 8 and all(r["text_preview"].endswith("...") and len(r["text_preview"]) == 103 and len(r["per_dim"]) == 8 for r in rows)
    with pytest.raises(IndexError):
        E.evaluate(samples(spark).limit(0))


def test_reports_and_skeleton(spark, tmp_path):
    triples = spark.createDataFrame([(f"t{k}", "email" if k % 2 else "blog", "", HUMAN, AI, HUMAN + " Yes.") for k in range(4)], "id string, domain string, instruction string, original string, aiified string, humanized string")
    gated = G.gate(R.score_triples(triples), G.Thresholds(max_aiify_to_original=9.0, max_humanized_to_aiified=9.0, min_length_ratio=0.1, min_humanize_delta=0.1, min_aiify_delta=0.1, min_humanized_score=0.5, max_aiified_score=0.9), preserve=False)
    report.write_skeleton(gated, str(tmp_path))
    assert len(lines_of(tmp_path / "benchmark")) == 12
    accepted = gated.filter("accepted").count()
    assert accepted == 4 == len(lines_of(tmp_path / "sft"))
    domains = {d["domain"]: (d["n"], d["accepted"]) for d in json.loads((tmp_path / "report.json").read_text())["domains"]}
    assert domains == {"all": (4, 4), "blog": (2, 2), "email": (2, 2)}
    classes = R.three_classes(gated, ["id", "domain"]).withColumnsRenamed({"overall_score": "score", "per_dim": "dims"})
    ood = D.split_ood(classes.withColumnRenamed("score", "overall_score").withColumn("overall_score", F.lit(None).cast("double")))
    diagnostics = classes.select("id", "label", F.lit("t").alias("triple_id"), "domain", F.col("score").alias("overall_score"), F.monotonically_increasing_id().alias("row_idx"))
    sections = report.full_report(classes, ood, diagnostics)
    report.write_report(sections, str(tmp_path / "r.json"), str(tmp_path / "r.md"), "All")
    got = json.loads((tmp_path / "r.json").read_text())
    assert {x["split"]: x["n"] for x in got["rows"]} == {"core": 12, "ood": 4, "diagnostics": 12}
    assert got["ood_ai"][0]["n"] == 4 and len(got["manual_review_queue"]) == 10
    assert {x["pair"]: x["auroc"] for x in got["auroc"]}["human_vs_ai"] == 1.0
    text = (tmp_path / "r.md").read_text()
    assert text.startswith("# All") and "## manual_review_queue" in text and "| human_vs_ai | 1.000 |" in text
    report.write_splits(D.split_core(classes.withColumnRenamed("score", "overall_score")), ood, diagnostics.drop("row_idx"), str(tmp_path / "splits"))
    assert [len(lines_of(tmp_path / "splits" / s)) for s in ("core", "ood", "diagnostics")] == [12, 4, 12]


def test_both_layers_report_and_export(spark, tmp_path):
    rows = S.with_scores(samples(spark), ["text"]).withColumnsRenamed({"text_score": "score", "text_dims": "dims"})
    layers = J.drive(rows, lambda: lambda t: ({"flow": 1 if t.startswith("Certainly") else 5}, "said"), {"flow": 1.0})
    assert "AUROC human_vs_ai" in report.combined_report(layers)
    io.write_jsonl(E.combined_records(layers), str(tmp_path / "combined"))
    got = [json.loads(x) for x in lines_of(tmp_path / "combined")]
    asked = layers.filter("l2_overall is not null").count()
    assert len(got) == 8 and sum("l2_overall" in r for r in got) == asked == sum("l2_reasoning" in r for r in got)
    assert report.summary_text(samples(spark).withColumns({"domain": F.lit("d"), "text_is_preview": F.col("id") == "s1"})).split("\n")[:3] == ["Samples: 8", "Labels: {'ai': 4, 'human': 4}", "Preview-only rows: 1"]


def test_command_line(spark, transform, tmp_path, capsys, monkeypatch):
    assert cli.main(["score", HUMAN], spark) == 0 and "opener_pattern" in capsys.readouterr().out
    (tmp_path / "t.txt").write_text(AI)
    assert cli.main(["score", "--file", str(tmp_path / "t.txt")], spark) == 0
    monkeypatch.setattr("sys.stdin", type("Stdin", (), {"read": staticmethod(lambda: " \n")}))
    assert cli.main(["score"], spark) == 1
    rows = [r.asDict() for r in samples(spark).collect()]
    for label in ("human", "ai"):
        (tmp_path / f"{label}.jsonl").write_text("\n".join(json.dumps(r) for r in rows if r["label"] == label))
    assert cli.main(["bench", str(tmp_path / "human.jsonl"), str(tmp_path / "ai.jsonl"), "--out", str(tmp_path / "o")], spark) == 0
    assert "auroc=1.000" in capsys.readouterr().out and len(lines_of(tmp_path / "o" / "scored")) == 8
    assert cli.main(["pipeline", transform], spark) == 0
    assert cli.main(["pipeline", transform, transform, "--out", str(tmp_path / "p"), "--min-delta", "-1"], spark) == 0
    assert "3 training pairs" in capsys.readouterr().out and len(lines_of(tmp_path / "p" / "benchmark")) == 9


def test_stream_scores_equal_table_scores(spark, tmp_path):
    rows = samples(spark)
    rows.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r["text_score"] for r in spark.table("scored_stream").collect()}
    assert got == {r["id"]: r["text_score"] for r in S.with_scores(rows, ["text"]).collect()} and len(got) == 8


def test_seeds_round_trip(spark, tmp_path):
    bundles = [("e1", " Hi Mike, it's 42% now. ", "email", "request", "note"), ("t1", "Use v3.14.1 of `it`.", "instruction_technical", "troubleshooting", None), ("b1", "A day.", "blog_opinion", "anecdote", None)]
    seeds = G.build_seeds(spark.createDataFrame(bundles, "id string, text string, domain string, discourse_role string, notes string"))
    assert all(not r["violations"] for r in seeds.collect())
    io.write_jsonl(G.seed_rows(seeds), str(tmp_path / "seeds"))
    rows = [json.loads(x) for x in lines_of(tmp_path / "seeds")]
    assert sorted(rows[0]) == sorted(G.SEED_COLUMNS)
    back = {r["id"]: r for r in io.read_jsonl(spark, str(tmp_path / "seeds"), io.SEED).collect()}
    assert back["e1"]["response"] == "Hi Mike, it's 42% now." and (back["t1"]["word_count"], back["t1"]["anchors_count"], back["t1"]["length_band"]) == (6, 2, "short")
    assert back["b1"]["instruction"] == "Write in the style of: blog_opinion." and back["e1"]["instruction"].startswith("Write a short professional email")
    kept = G.seed_rows(seeds.withColumn("instruction", F.when(F.col("id") == "b1", "own").otherwise(""))).collect()
    assert {r["id"]: r["instruction"] for r in kept}["b1"] == "own"


def test_domains_by_the_original_text(spark):
    triples = spark.createDataFrame([("1", "a text "), ("2", "other")], "id string, original string")
    seeds = spark.createDataFrame([(0, "a text", "old"), (1, "  a text", "email")], "row_idx int, response string, domain string")
    assert {r["id"]: r["domain"] for r in R.with_domain(triples, seeds).collect()} == {"1": "email", "2": "unknown"}
    # two hops: selected texts to their originals' scores
    selected = spark.createDataFrame([("a text ", "styled"), ("gone", "x")], "original string, response string")
    scores = spark.createDataFrame([("a text ", 0.8)], "original string, score double")
    assert [tuple(r) for r in C.original_scores(selected, scores).collect()] == [("styled", 0.8)]
