"""Registered queries of the analytics operators and the same in DuckDB's SQL.

The driver's documents hold none of the phrases that layer 1 looks for, so
texts are derived from them: the same expressions, in both engines, put
phrases around each document's whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.functions import extract as X
from prosewright.functions import patterns as P
from prosewright.functions import score as S
from prosewright.functions import text as T
from prosewright.operators import datasets as D
from prosewright.operators import evaluate as E
from prosewright.operators import gate as G
from prosewright.operators import judge as J
from prosewright.operators import metrics as M
from prosewright.operators import select as C
from prosewright.operators import triples as R
from prosewright.plans import report
from prosewright.sources import io

# ---------------------------------------------------------------- derived texts, valid in both engines
ORIGINAL = (
    "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN concat('Hi Mike, I don''t think it''s that simple. We''re at 42% and GDPR applies. ', short, ' Is that so?')"
    " WHEN 1 THEN concat('I''ve seen 180ms at 11:30 in v3.14.1. They''re fine -- mostly. ', short) WHEN 2 THEN short"
    " WHEN 3 THEN concat('- one', chr(10), '- two', chr(10), short, chr(10), chr(10), 'We can''t say. It''s 2024-04-15 and $1,234.50.') ELSE '' END"
)
AIIFIED = (
    "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN concat('When working with this, it is worth noting that it''s also worth mentioning one thing. Furthermore, in general, it''s important to note this. ', short, ' I hope this helps!')"
    " WHEN 1 THEN concat('Certainly! Moreover, it is important to acknowledge that -- in many cases, -- one might argue so. ', short, chr(10), chr(10), 'In conclusion, let me know if you have questions.')"
    " ELSE concat('In modern software systems it may potentially matter. Additionally, GDPR is critically important at 42%. ', short) END"
)
HUMANIZED = "concat('Hi all, I don''t think it''s that simple, we''ve 42% and GDPR. ', short, ' You''re right?')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    rows = docs.withColumn("short", T.text_of(F.col("text")))
    return rows.select("doc_id", "lang", "source", F.expr(ORIGINAL).alias("original"), F.expr(AIIFIED).alias("aiified"), F.expr(HUMANIZED).alias("humanized"))


TEXTS_SQL = f"""
derived AS (SELECT doc_id, lang, source, coalesce(text, '') AS short FROM documents),
texts AS (SELECT doc_id, lang, source, {ORIGINAL} AS original, {AIIFIED} AS aiified, {HUMANIZED} AS humanized FROM derived)"""


# ---------------------------------------------------------------- layer 1 in SQL
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _words(t: str) -> str:
    return rf"len(list_filter(string_split_regex({t}, '\s+'), lambda w: w <> ''))"


def _matches(t: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({t}, {_q('(?i)' + p)}))" for p in patterns) + ")"


def _ladder(value: str, steps: list[tuple[str, float, int]], rest: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} {sign} {bound} THEN {t}" for sign, bound, t in steps) + f" ELSE {rest} END"


BULLET_SQL = r"^\s*(?:[-*•]|\d+[.)]) "


def scored_sql(source: str, columns: list[str], keep: str) -> str:
    """CTEs up to ``scored``: ``<column>_<dimension>`` in tenths and ``<column>_score`` for each column of ``source``."""
    helpers, tenths, overall = [], [], []
    for c in columns:
        lines = f"list_filter(string_split({_strip(c)}, chr(10)), lambda s: {_strip('s')} <> '')"
        sizes = rf"list_filter(list_transform(string_split(regexp_replace({_strip(c)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_words('s')}), lambda n: n >= 2)"
        paragraphs = f"list_filter(list_transform(string_split({_strip(c)}, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"
        helpers.append(f"{_words(c)} AS {c}_w, {lines} AS {c}_lines, {sizes} AS {c}_sizes, coalesce(list_extract({paragraphs}, -1), '') AS {c}_last, string_split({_strip(c)}, chr(10))[1] AS {c}_first")
        w, n = f"{c}_w", f"len({c}_sizes)"
        density = lambda p, c=c, w=w: f"({_matches(c, p)} / greatest({w} / 200.0::DOUBLE, 1.0::DOUBLE))"
        share = f"(len(list_filter({c}_lines, lambda s: regexp_matches(s, {_q(BULLET_SQL)}))) / greatest(len({c}_lines), 1)::DOUBLE)"
        total, squares = f"list_sum({c}_sizes)::DOUBLE", f"list_sum(list_transform({c}_sizes, lambda x: x * x))::DOUBLE"
        spread = f"(sqrt(({n} * {squares} - {total} * {total}) / greatest({n} * ({n} - 1), 1)::DOUBLE) / ({total} / greatest({n}, 1)))"
        tail = f"{c}_last || ' ' || list_extract(string_split({c}_last, chr(10)), -1)"
        any_ = lambda t, p: f"regexp_matches({t}, {_q('(?i)(?:' + '|'.join(p) + ')')})"
        dashes = f"(len(regexp_extract_all({c}, '—|--')) / greatest({w}, 1)::DOUBLE * 500)"
        sql = {
            "opener_pattern": f"CASE WHEN {any_(f'{c}_first', P.OPENERS)} THEN 0 ELSE 10 END",
            "hedging_density": f"CASE WHEN {w} = 0 THEN 5 ELSE {_ladder(density(P.HEDGES), [('>=', 3, 1), ('>=', 2, 3), ('>=', 1, 5), ('>=', 0.5, 8)], 10)} END",
            "list_overuse": f"CASE WHEN len({c}_lines) = 0 THEN 5 ELSE {_ladder(share, [('>', 0.5, 1), ('>', 0.25, 3), ('>', 0.1, 5), ('>', 0.05, 7)], 10)} END",
            "sentence_variance": f"CASE WHEN {n} < 3 THEN 5 ELSE {_ladder(spread, [('<', 0.15, 1), ('<', 0.25, 3), ('<', 0.35, 5), ('<', 0.5, 7)], 9)} END",
            "contractions": f"CASE WHEN {w} = 0 THEN 5 ELSE {_ladder(f'({_matches(c, P.CONTRACTIONS)} / greatest({w}, 1)::DOUBLE)', [('<', 0.005, 2), ('<', 0.015, 5), ('<', 0.035, 8)], 9)} END",
            "closing_pattern": f"CASE WHEN {any_(tail, P.CLOSINGS)} THEN 0 ELSE 10 END",
            "em_dash_density": f"CASE WHEN {w} = 0 THEN 5 ELSE {_ladder(dashes, [('>', 3.0, 1), ('>', 1.5, 3), ('>', 0.5, 5), ('>', 0.2, 7)], 9)} END",
            "transition_overuse": f"CASE WHEN {w} = 0 THEN 5 ELSE {_ladder(density(P.TRANSITIONS), [('>=', 3, 1), ('>=', 2, 3), ('>=', 1, 5)], 9)} END",
        }
        tenths += [f"CAST({sql[d]} AS INTEGER) AS {c}_{d}" for d in S.DIMENSIONS]
        overall.append("(" + " + ".join(f"{c}_{d}" for d in S.DIMENSIONS) + f") / 80.0::DOUBLE AS {c}_score")
    names = ", ".join(columns)
    return f"""
helped AS (SELECT {keep}, {names}, {", ".join(helpers)} FROM {source}),
tenthed AS (SELECT {keep}, {names}, {", ".join(tenths)} FROM helped),
scored AS (SELECT *, {", ".join(overall)} FROM tenthed)"""


THREE = ["original", "aiified", "humanized"]
KEEP = "doc_id, lang, source"
SCORED = f"WITH {TEXTS_SQL.strip()}, {scored_sql('texts', THREE, KEEP).strip()}"
DELTAS = f"""{SCORED}, deltas AS (
  SELECT *, original_score - aiified_score AS aiify_delta, humanized_score - aiified_score AS humanize_delta FROM scored),
triples AS (SELECT *, CASE WHEN aiify_delta = 0 THEN 0.0 ELSE humanize_delta / aiify_delta END AS recovery_ratio FROM deltas)"""
CLASSES = f"""{DELTAS}, classes AS (
  SELECT doc_id, lang, source, 'human' AS label, original AS text, original_score AS score FROM triples
  UNION ALL SELECT doc_id, lang, source, 'ai', aiified, aiified_score FROM triples
  UNION ALL SELECT doc_id, lang, source, 'humanized', humanized, humanized_score FROM triples)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.score_triples(_texts(spark, sf_dir))


def _classes(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = ("human", "ai", "humanized")) -> DataFrame:
    """Labelled rows with scores; only texts of the labels asked for are scored."""
    rows = R.labelled_texts(_texts(spark, sf_dir), ["doc_id", "lang", "source"], labels)
    return S.with_scores(rows, ["text"]).withColumnsRenamed({"text_score": "score", "text_dims": "dims"})


# ---------------------------------------------------------------- scoring
@query(f"{SCORED} SELECT doc_id, {', '.join(f'aiified_{d} AS {d}' for d in S.DIMENSIONS)}, round(aiified_score, 6) AS overall FROM scored")
def l1_dims(spark, sf_dir):
    rows = S.with_scores(_texts(spark, sf_dir).select("doc_id", "aiified"), ["aiified"])
    return rows.select("doc_id", "aiified_dims.*", F.round("aiified_score", 6).alias("overall"))


@query(f"WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {scored_sql('raw', ['t'], 'doc_id').strip()} SELECT doc_id, {', '.join(f't_{d} AS {d}' for d in S.DIMENSIONS)}, round(t_score, 6) AS overall FROM scored")
def l1_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return S.with_scores(io.spread(docs), ["t"]).select("doc_id", "t_dims.*", F.round("t_score", 6).alias("overall"))


_W = {"opener_pattern": 2.0, "closing_pattern": 0.5}


@query(f"{SCORED} SELECT doc_id, round(({' + '.join(f'original_{d} / 10.0::DOUBLE * {_W.get(d, 1.0)}' for d in S.DIMENSIONS)}) / 8.5, 6) AS weighted FROM scored")
def l1_weighted(spark, sf_dir):
    rows = S.with_scores(_texts(spark, sf_dir).select("doc_id", "original"), ["original"], _W)
    return rows.select("doc_id", F.round("original_score", 6).alias("weighted"))


@query(f"{SCORED}, l AS (SELECT doc_id, original_score AS s, (doc_id % 11) / 10.0 AS l2 FROM scored) SELECT doc_id, NOT (s > 0.85 OR s < 0.3) AS run_source, NOT (s < 0.25) AS run_aiified, round(0.4 * s + 0.6 * l2, 6) AS combined FROM l")
def gate_l2(spark, sf_dir):
    s, l2 = F.col("original_score"), F.col("doc_id") % 11 / 10.0
    rows = S.with_scores(_texts(spark, sf_dir).select("doc_id", "original"), ["original"])
    return rows.select("doc_id", S.needs_layer2(s).alias("run_source"), S.needs_layer2(s, "aiified_scoring").alias("run_aiified"), F.round(S.combine(s, l2), 6).alias("combined"))


@query(f"{SCORED} SELECT count(*) AS n, count(*) FILTER (original_score > 0.85 OR original_score < 0.3) AS skipped, round(100.0 * count(*) FILTER (original_score > 0.85 OR original_score < 0.3) / nullif(count(*), 0), 6) AS percent FROM scored")
def gate_savings(spark, sf_dir):
    rows = S.with_scores(_texts(spark, sf_dir).select("original"), ["original"])
    return E.gate_savings(rows, "original_score")


_RUBRIC = {"flow": 0.5, "voice": 0.3, "detail": 0.2}


@query("SELECT doc_id, round(((doc_id % 5) / 4.0::DOUBLE * 0.5 + ((doc_id // 5) % 5) / 4.0::DOUBLE * 0.3 + 0.0 * 0.2) / 1.0, 6) AS l2_overall FROM documents")
def l2_weighted_mean(spark, sf_dir):
    ratings = F.create_map(F.lit("flow"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit("voice"), (F.floor(F.col("doc_id") / 5) % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.round(S.weighted_ratings(ratings, _RUBRIC), 6).alias("l2_overall"))


# ---------------------------------------------------------------- text functions
@query(rf"SELECT doc_id, CAST({_words('coalesce(text, chr(32))')} AS INTEGER) AS words_ws, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+')) AS INTEGER) AS words_re, CASE WHEN {_words('coalesce(text, chr(32))')} < 100 THEN 'short' WHEN {_words('coalesce(text, chr(32))')} < 220 THEN 'medium' ELSE 'long' END AS band FROM documents")
def word_counts(spark, sf_dir):
    t = T.text_of(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.words_ws(t).alias("words_ws"), T.words_re(t).alias("words_re"), T.length_band(T.words_ws(t)).alias("band"))


def _numbers_sql(t: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, {_q('(?i)(?:' + P.NUMBER + ')')}), lambda x: lower(replace(trim(x), ',', '')))))"


@query(f"WITH {TEXTS_SQL.strip()} SELECT doc_id, array_to_string({_numbers_sql('original')}, '|') AS numbers FROM texts")
def numbers(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("original"))), "|").alias("numbers"))


@query()  # in SQL quadratic in a text's tokens; tests/test_rules.py holds it against Python
def entities(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(X.entities(F.col("original"))), "|").alias("entities"))


_KEPT = ("numbers_dropped", "numbers_added", "entities_dropped", "entities_added")


@query()
def preservation(spark, sf_dir):
    kept = X.preservation(F.col("original"), F.col("aiified"))
    rows = _texts(spark, sf_dir).select("doc_id", kept.alias("k"))
    return rows.select("doc_id", *[F.array_join(f"k.{c}", "|").alias(c) for c in (*_KEPT, "role_drift")])


@query()  # RE2 knows no Unicode word boundary; tests/test_rules.py holds it against Python
def anchor_counts(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", X.anchors(F.col("original")).alias("anchors"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("SELECT doc_id, length(text) AS size FROM documents WHERE length(text) BETWEEN 50 AND 4096")
def length_filter(spark, sf_dir):
    docs = J.within_length(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    return docs.select("doc_id", F.length("text").cast("long").alias("size"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, 'triple_' || printf('%03d', doc_id) AS padded FROM documents")
def previews(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.preview(F.col("text"), 100, "...").alias("preview"), F.format_string("triple_%03d", "doc_id").alias("padded"))


@query("SELECT source, CASE WHEN source IN ('src0') THEN 'blog' WHEN source = 'src1' THEN 'unknown' ELSE lang END AS domain, count(*) AS n FROM documents GROUP BY ALL")
def domains(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = F.when(F.col("source") == "src0", "blog").otherwise(F.col("source"))
    given = F.when(F.col("source").isin("src0", "src1"), "").otherwise(F.col("lang"))
    return docs.select("source", io.infer_domain(given, named).alias("domain")).groupBy("source", "domain").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pairs and triples
@query(f"{SCORED} SELECT doc_id, round(original_score, 6) AS original_score, round(aiified_score, 6) AS aiified_score, round(original_score - aiified_score, 6) AS delta FROM scored")
def pairs_scored(spark, sf_dir):
    rows = R.score_pairs(_texts(spark, sf_dir).select("doc_id", "original", "aiified"))
    return rows.select("doc_id", *[F.round(c, 6).alias(c) for c in ("original_score", "aiified_score", "delta")])


_T = ["original_score", "aiified_score", "humanized_score", "aiify_delta", "humanize_delta", "recovery_ratio"]


@query(f"{DELTAS} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in _T)} FROM triples")
def triples_scored(spark, sf_dir):
    return _triples(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(c) for c in _T])


@query(
    """WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS pos, role FROM conversations WHERE text <> '')
SELECT 'triple_' || printf('%03d', a.pos) AS id, a.text AS aiified, h.text AS humanized FROM u a JOIN u h USING (pos) WHERE a.role = 'user' AND h.role = 'assistant'"""
)
def triples_by_position(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text <> ''").withColumn("row_idx", F.col("conv_id") * (1 << 20) + F.col("turn"))
    side = lambda role: turns.filter(F.col("role") == role).select("row_idx", F.lit("").alias("instruction"), F.lit("").alias("original"), F.col("text").alias("response"))
    return R.join_by_position(side("user"), side("assistant")).select("id", "aiified", "humanized")


@query(f"WITH {TEXTS_SQL.strip()} SELECT a.doc_id, a.aiified, h.humanized FROM texts a JOIN (SELECT DISTINCT aiified, humanized FROM texts) h USING (aiified)")
def triples_by_text(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    a = rows.select(F.col("doc_id").alias("id"), F.lit("").alias("instruction"), "original", F.col("aiified").alias("response"))
    h = rows.select(F.col("aiified").alias("original"), F.col("humanized").alias("response")).distinct()
    return R.join_by_text(a, h).select(F.col("id").alias("doc_id"), "aiified", "humanized")


@query(f"{CLASSES} SELECT doc_id, label, substr(text, 1, 120) AS text_preview, round(score, 4) AS overall_score FROM classes")
def unpivot_3class(spark, sf_dir):
    rows = R.three_classes(_triples(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "label", F.substring("text", 1, 120).alias("text_preview"), F.round("overall_score", 4).alias("overall_score"))


@query(f"{DELTAS} SELECT doc_id AS id, aiified AS input, humanized AS output, round(humanize_delta, 4) AS delta, round(recovery_ratio, 4) AS recovery_ratio FROM triples WHERE humanize_delta >= 0.15")
def sft_pairs(spark, sf_dir):
    rows = R.sft_pairs(_triples(spark, sf_dir).withColumn("id", F.col("doc_id")).withColumn("instruction", F.lit("")))
    return rows.select("metadata.id", "input", "output", "metadata.delta", "metadata.recovery_ratio")


@query("SELECT doc_id || '__c' || i AS id FROM documents, (SELECT unnest([0, 1, 2]) AS i)")
def dup_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"))
    return R.fan_out(docs, 3).select("id")


# ---------------------------------------------------------------- selection
#: Candidates of one original: neighbouring documents, so groups stay small however many there are.
_GROUP = 25
_CANDIDATES = f"""{SCORED}, cand AS (
  SELECT doc_id // {_GROUP} AS grp, doc_id AS row_idx, aiified AS response, aiified_score AS score, len(regexp_extract_all(aiified, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM scored),
base AS (SELECT grp, arg_min(words, row_idx) AS base_words FROM cand GROUP BY grp)"""


def _candidates(spark, sf_dir):
    rows = S.with_scores(_texts(spark, sf_dir).select("doc_id", "aiified"), ["aiified"]).select(
        F.floor(F.col("doc_id") / _GROUP).alias("grp"), F.col("doc_id").alias("row_idx"), F.col("aiified").alias("response"), F.col("aiified_score").alias("score"), T.words_re(F.col("aiified")).alias("words")
    )
    base = rows.groupBy("grp").agg(F.min_by("response", "row_idx").alias("original"))
    return rows.join(base, "grp")


@query(f"{_CANDIDATES} SELECT grp, row_idx, round(score, 6) AS score FROM cand JOIN base USING (grp) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY words / greatest(base_words, 1)::DOUBLE > 1.25, abs(score - 0.30), row_idx) = 1")
def aiify_best(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("original", F.struct("grp", "original"))
    return C.aiify_best(rows, text=F.col("original.original")).select("grp", "row_idx", F.round("score", 6).alias("score"))


@query(
    f"""{SCORED}, cand AS (SELECT doc_id // {_GROUP} AS aiified, doc_id AS row_idx, humanized_score AS score, aiified_score AS a, original_score AS o FROM scored),
g AS (SELECT aiified, min(a) AS aiified_score, max(o) FILTER (row_idx % 2 = 0) AS o FROM cand GROUP BY aiified),
r AS (SELECT c.aiified, c.row_idx, c.score, c.score - g.aiified_score AS delta, abs(c.score - coalesce(g.o, 1.0)) AS dist,
  CASE WHEN c.score - g.aiified_score >= 0.30 AND c.score <= coalesce(g.o, 1.0) + 0.05 THEN 0 WHEN c.score - g.aiified_score >= 0.30 THEN 1 ELSE 2 END AS tier FROM cand c JOIN g USING (aiified))
SELECT aiified AS grp, row_idx, tier, round(delta, 6) AS delta FROM r QUALIFY row_number() OVER (PARTITION BY aiified ORDER BY tier, -delta, dist, row_idx) = 1"""
)
def humanize_best(spark, sf_dir):
    rows = _triples(spark, sf_dir).select(F.floor(F.col("doc_id") / _GROUP).alias("aiified"), F.col("doc_id").alias("row_idx"), F.col("humanized_score").alias("score"), F.col("aiified_score").alias("a"), F.col("original_score").alias("o"))
    groups = rows.groupBy("aiified").agg(F.min("a").alias("aiified_score"), F.max(F.when(F.col("row_idx") % 2 == 0, F.col("o"))).alias("original_score"))
    return C.humanize_best(rows.drop("a", "o").join(groups, "aiified")).select(F.col("aiified").alias("grp"), "row_idx", "tier", F.round("delta", 6).alias("delta"))


@query(f"{_CANDIDATES} SELECT grp, count(*) AS n_candidates, string_agg(row_idx || ':' || CAST(round(score * 10000) AS BIGINT) || ':' || words, '|' ORDER BY row_idx) AS candidates, round(arg_min(score, row_idx), 4) AS chosen_score, CAST(arg_min(words, row_idx) AS INTEGER) AS chosen_words FROM cand GROUP BY grp")
def selection_report(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    made = C.selection_report(rows, C._best(rows, "grp", F.col("row_idx")), "grp")
    each = F.transform("candidates", lambda c: F.concat_ws(":", c["row_idx"], F.round(c["score"] * 10000).cast("long"), c["words"]))
    return made.select("grp", "n_candidates", F.array_join(each, "|").alias("candidates"), "chosen_score", "chosen_words")


# ---------------------------------------------------------------- gate and seeds
@query()
def pair_gate(spark, sf_dir):
    rows = G.gate(_triples(spark, sf_dir))
    return rows.select("doc_id", F.array_join("rejected_reasons", "|").alias("reasons"), F.array_join("suspicion_flags", "|").alias("flags"), "accepted")


_SEED_DOMAIN = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'email' WHEN 1 THEN 'creative' WHEN 2 THEN 'poem' ELSE 'instruction_technical' END"
_SEEDS = rf"WITH {TEXTS_SQL.strip()}, s AS (SELECT doc_id, {_SEED_DOMAIN} AS domain, CASE WHEN doc_id % 7 = 0 THEN 'chat' ELSE 'anecdote' END AS role, {_strip('original')} AS t FROM texts), c AS (SELECT *, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) AS words FROM s)"


def _seeds(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.col("original").alias("text"), F.expr(_SEED_DOMAIN).alias("domain"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'chat' ELSE 'anecdote' END").alias("discourse_role"))
    return G.build_seeds(rows)


@query(f"{_SEEDS} SELECT doc_id, concat_ws('|', CASE WHEN t = '' THEN 'text' END, CASE WHEN domain = 'poem' THEN 'domain' END, CASE WHEN role = 'chat' THEN 'discourse_role' END, CASE WHEN words < 1 THEN 'word_count' END) AS violations FROM c")
def seed_validate(spark, sf_dir):
    return _seeds(spark, sf_dir).select("doc_id", F.array_join("violations", "|").alias("violations"))


@query()  # holds anchor counts, as above
def seed_stats(spark, sf_dir):
    return E.seed_stats(_seeds(spark, sf_dir))


# ---------------------------------------------------------------- metrics
_AREA = """{by_sel} round(CASE WHEN count(*) = 0 THEN 0.5 ELSE (sum(CASE WHEN p.score > n.score THEN p.c * n.c ELSE 0 END) + 0.5 * sum(CASE WHEN NOT p.score > n.score AND abs(p.score - n.score) <= greatest(1e-9 * greatest(abs(p.score), abs(n.score)), 1e-9) THEN p.c * n.c ELSE 0 END)) / sum(p.c * n.c) END, 6) AS auroc"""
_BINARY = f"{CLASSES}, b AS (SELECT *, label = 'human' AS positive FROM classes WHERE label IN ('human', 'ai')), h AS (SELECT score, positive, count(*)::DOUBLE AS c FROM b GROUP BY ALL)"


def _binary(spark, sf_dir):
    return _classes(spark, sf_dir, ("human", "ai")).withColumn("positive", F.col("label") == "human")


@query(f"{_BINARY} SELECT {_AREA.format(by_sel='')} FROM h p, h n WHERE p.positive AND NOT n.positive")
def auroc_overall(spark, sf_dir):
    return M.auroc(_binary(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dim, original_{d} / 10.0::DOUBLE AS score, TRUE AS positive FROM triples UNION ALL SELECT '{d}', aiified_{d} / 10.0::DOUBLE, FALSE FROM triples" for d in S.DIMENSIONS)


@query(f"{DELTAS}, b AS ({_DIMS}), h AS (SELECT dim, score, positive, count(*)::DOUBLE AS c FROM b GROUP BY ALL) SELECT {_AREA.format(by_sel='p.dim AS dim,')} FROM h p JOIN h n ON p.dim = n.dim WHERE p.positive AND NOT n.positive GROUP BY p.dim")
def auroc_per_dim(spark, sf_dir):
    rows = report.dim_rows(_binary(spark, sf_dir)).select("dim", F.col("dim_score").alias("score"), "positive")
    return M.auroc(rows, by=["dim"]).select("dim", F.round("auroc", 6).alias("auroc"))


@query(f"{CLASSES}, h AS (SELECT label, score, count(*)::DOUBLE AS c FROM classes GROUP BY ALL) SELECT {_AREA.format(by_sel="p.label || '_vs_' || n.label AS pair,")} FROM h p JOIN h n ON (p.label, n.label) IN (('human', 'ai'), ('humanized', 'ai'), ('human', 'humanized')) GROUP BY p.label, n.label")
def auroc_pairs(spark, sf_dir):
    return report.auroc_pairs(_classes(spark, sf_dir)).select("pair", F.round("auroc", 6).alias("auroc"))


@query(f"{_BINARY} SELECT {_AREA.format(by_sel='')} FROM h p, h n WHERE p.positive AND NOT n.positive")
def auroc_rank(spark, sf_dir):
    return M.auroc_rank(_binary(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


@query(f"{_BINARY} SELECT t.score AS threshold, round(sum(CASE WHEN (h.score >= t.score) = h.positive THEN h.c ELSE 0 END) / sum(h.c), 6) AS accuracy FROM (SELECT DISTINCT score FROM h) t, h GROUP BY t.score ORDER BY sum(CASE WHEN (h.score >= t.score) = h.positive THEN h.c ELSE 0 END) DESC, t.score LIMIT 1")
def best_threshold(spark, sf_dir):
    return M.best_threshold(_binary(spark, sf_dir)).select("threshold", F.round("accuracy", 6).alias("accuracy"))


@query(f"{_BINARY} SELECT count(*) FILTER (positive AND score >= 0.6) AS tp, count(*) FILTER (NOT positive AND score >= 0.6) AS fp, count(*) FILTER (NOT positive AND score < 0.6) AS tn, count(*) FILTER (positive AND score < 0.6) AS fn FROM b")
def confusion(spark, sf_dir):
    return M.confusion(_binary(spark, sf_dir), 0.6)


def _rounded(df: DataFrame) -> DataFrame:
    """Means to six digits, off the ties that two engines may round differently."""
    return df.withColumn("mean_score", F.round(F.col("mean_score") + 1e-9, 6))


def _means_sql(by: str, where: str = "TRUE") -> str:
    return f"{CLASSES} SELECT {by}, count(*) AS n, round(avg(score) + 1e-9, 6) AS mean_score FROM classes WHERE {where} GROUP BY {by}"


@query(_means_sql("label"))
def by_label(spark, sf_dir):
    return _rounded(M.group_means(_classes(spark, sf_dir), ["label"], digits=12))


@query(_means_sql("source"))
def by_source(spark, sf_dir):
    return _rounded(M.group_means(_classes(spark, sf_dir), ["source"], digits=12))


@query(_means_sql("lang, label"))
def domain_label_means(spark, sf_dir):
    return _rounded(M.group_means(_classes(spark, sf_dir), ["lang", "label"], digits=12))


@query(f"{CLASSES}, w AS (SELECT *, {_words('text')} AS w FROM classes WHERE text <> '') SELECT CASE WHEN w < 100 THEN 'short' WHEN w < 220 THEN 'medium' ELSE 'long' END AS band, label, count(*) AS n, round(avg(score) + 1e-9, 6) AS mean_score FROM w GROUP BY ALL")
def band_label_means(spark, sf_dir):
    rows = _classes(spark, sf_dir).filter("text <> ''")
    return _rounded(M.group_means(rows.withColumn("band", T.length_band(T.words_ws(F.col("text")))), ["band", "label"], digits=12))


_DIM_MEANS = " UNION ALL ".join(f"SELECT '{label}' AS label, '{d}' AS dim, round(avg({c}_{d}) / 10.0, 6) AS mean_score FROM scored" for label, c in (("human", "original"), ("ai", "aiified"), ("humanized", "humanized")) for d in S.DIMENSIONS)


@query(f"{SCORED} {_DIM_MEANS}")
def dim_means(spark, sf_dir):
    return report.dim_means(_classes(spark, sf_dir))


@query(f"{CLASSES} SELECT count(*) AS n, round(avg(score) + 1e-9, 6) AS mean_score, round(avg(CAST(score < 0.5 AS INT)), 6) AS frac_below_05, round(avg(CAST(score < 0.7 AS INT)), 6) AS frac_below_07 FROM classes WHERE label = 'ai'")
def ood_summary(spark, sf_dir):
    return M.ood_summary(_classes(spark, sf_dir, ("ai",)))


@query(f"{DELTAS} SELECT coalesce(lang, 'all') AS domain, count(*) AS n, count(*) FILTER (humanize_delta > 0.15) AS ready, round(avg(original_score) + 1e-9, 6) AS mean_original, round(avg(aiified_score) + 1e-9, 6) AS mean_aiified, round(avg(humanized_score) + 1e-9, 6) AS mean_humanized, round(avg(aiify_delta) + 1e-9, 6) AS mean_aiify_delta, round(avg(humanize_delta) + 1e-9, 6) AS mean_humanize_delta FROM triples GROUP BY ROLLUP (lang)")
def domain_rollup(spark, sf_dir):
    return E.domain_rollup(_triples(spark, sf_dir), "lang")


@query(f"{DELTAS} SELECT count(*) AS n, round(avg(original_score) + 1e-9, 6) AS mean_original, round(avg(aiified_score) + 1e-9, 6) AS mean_aiified, round(avg(humanized_score) + 1e-9, 6) AS mean_humanized, round(avg(recovery_ratio) + 1e-9, 6) AS mean_recovery, count(*) FILTER (humanize_delta > 0.15) AS ready FROM triples")
def triple_report(spark, sf_dir):
    return E.triple_report(_triples(spark, sf_dir))


@query(f"{SCORED} SELECT round(avg(original_score) + 1e-9, 6) AS mean_original, round(avg(aiified_score) + 1e-9, 6) AS mean_aiified, round(min(original_score - aiified_score), 6) AS min_delta, round(max(original_score - aiified_score), 6) AS max_delta, count(*) FILTER (original_score - aiified_score > 0.1) AS effective FROM scored")
def pair_report(spark, sf_dir):
    return E.pair_report(R.score_pairs(_texts(spark, sf_dir).select("original", "aiified")))


# ---------------------------------------------------------------- datasets
@query("SELECT text, doc_id, source, round((doc_id % 7) / 7.0::DOUBLE, 6) AS overall_score FROM documents WHERE text <> '' AND text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def repo_dataset(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("id"), F.lit("human").alias("label"), "text", "source")
    base = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("").alias("id"), F.lit("ai").alias("label"), F.lit("").alias("domain"), "text", F.lit("benchmark").alias("source"), F.lit("x").alias("generator"), F.lit(0.0).alias("overall_score"))
    early = docs.select("id", F.col("row_idx") * 2, (F.col("row_idx") % 10 / 10.0))
    scores = early.union(docs.select("id", F.col("row_idx") * 2 + 1, F.col("row_idx") % 7 / 7.0)).toDF("id", "row_idx", "overall_score")  # the last one counts
    rows = D.extend_with_new_texts(base, docs, scores).filter("id <> ''")
    return rows.select("text", F.expr("try_cast(id AS BIGINT)").alias("doc_id"), "source", F.round("overall_score", 6).alias("overall_score"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 25")
def per_label_cap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return D.first_per_label(docs, 25, "lang", "doc_id")


@query("SELECT 'triple_' || printf('%03d', doc_id) AS triple_id, doc_id AS row_idx FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 50")
def diagnostics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_idx"), F.format_string("triple_%03d_ai", "doc_id").alias("id"))
    accepted = docs.filter("row_idx % 3 = 0").select(D.triple_id(F.col("id")).alias("triple_id"))
    return D.split_diagnostics(docs, accepted).select("triple_id", "row_idx")


@query(
    """WITH s AS (SELECT item_id, length(text) AS n, 'triple_' || printf('%03d', item_id) || CASE WHEN item_id % 3 = 0 THEN '_human' WHEN item_id % 3 = 1 THEN '_ai' ELSE '_humanized' END AS id, substr(text, 1, 20) AS preview, text FROM benchmark)
SELECT id, regexp_extract(id, '_([a-z]+)$', 1) AS label, CASE WHEN (item_id % 3 = 1 AND n <= 150) OR (item_id % 3 = 2 AND n > 150) THEN preview ELSE text END AS text,
  (item_id % 3 = 1 AND n <= 150) OR (item_id % 3 = 2 AND n > 150) AS text_is_preview FROM s"""
)
def mvp_dataset(spark, sf_dir):
    # long items have a machine-styled text, short ones a rewrite; the others fall back to previews
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pos"), "text")
    label = F.when(F.col("pos") % 3 == 0, "human").when(F.col("pos") % 3 == 1, "ai").otherwise("humanized")
    scored = items.select(F.col("pos").alias("row_idx"), F.concat(F.format_string("triple_%03d_", "pos"), label).alias("id"), F.substring("text", 1, 20).alias("text_preview"), F.lit(0.5).alias("overall_score"))
    side = items.select("pos", F.col("text").alias("response"))
    seeds = side.withColumns({"domain": F.lit("email"), "instruction": F.lit(""), "source": F.lit("curated")})
    long = F.length("response") > 150
    return D.build_from_artifacts(scored, seeds, side.filter(long), side.filter(~long)).select("id", "label", "text", "text_is_preview")


@query("SELECT 'core' AS split, doc_id AS id, coalesce(lang, 'unknown') AS domain FROM documents UNION ALL SELECT 'ood', doc_id, coalesce(lang, 'unknown') FROM documents WHERE doc_id % 2 = 1")
def splits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 1, "ai").otherwise("human").alias("label"), F.col("lang").alias("domain"), "text", F.lit(0.5).alias("overall_score"))
    return D.split_core(docs).union(D.split_ood(docs)).select("split", "id", "domain")


_DATASET = "WITH d AS (SELECT CASE WHEN doc_id % 2 = 1 THEN 'ai' ELSE 'human' END AS label, coalesce(lang, 'unknown') AS domain, length(text) > 100 AS text_is_preview FROM documents)"


@query(f"{_DATASET} SELECT 'samples' AS what, '' AS value, count(*) AS n FROM d UNION ALL SELECT 'label', label, count(*) FROM d GROUP BY label UNION ALL SELECT 'domain', domain, count(*) FROM d GROUP BY domain UNION ALL SELECT 'preview_only', '', count(*) FILTER (text_is_preview) FROM d")
def dataset_summary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = F.when(F.col("doc_id") % 2 == 1, "ai").otherwise("human").alias("label")
    return D.summary(docs.select(label, F.coalesce("lang", F.lit("unknown")).alias("domain"), (F.length("text") > 100).alias("text_is_preview")))


@query("SELECT doc_id AS id, 'triple_' || printf('%03d', doc_id) AS triple_id, 'ai' AS label, coalesce(lang, 'unknown') AS domain, (doc_id % 7) / 7.0::DOUBLE AS score FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 10")
def review_queue(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("triple_id", F.format_string("triple_%03d", "doc_id"))
    rows = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("row_idx"), "triple_id", F.lit("ai").alias("label"), F.col("lang").alias("domain"), (F.col("doc_id") % 7 / 7.0).alias("overall_score"))
    return E.review_queue(rows)


@query(f"WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {scored_sql('raw', ['t'], 'doc_id').strip()} SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 AND t <> '' THEN t_score WHEN doc_id % 3 <> 0 THEN 0.25 END, 6) AS overall_score FROM scored")
def ood_rescored(spark, sf_dir):
    docs = io.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = D.rescored(docs.withColumn("overall_score", F.when(F.col("doc_id") % 3 != 0, 0.25)))
    return rows.select("doc_id", F.round("overall_score", 6).alias("overall_score"))


def _layers(spark, sf_dir):
    """Both layers, with ratings that are a function of the text's length; asked where layer 1 is not decisive."""
    flow = F.length("text") % 5 / 4.0
    asked = F.when(F.col("label") == "human", S.needs_layer2(F.col("score"))).when(F.col("label") == "ai", S.needs_layer2(F.col("score"), "aiified_scoring")).otherwise(True)
    rows = _classes(spark, sf_dir).withColumns({"l2_overall": F.when(asked, flow), "l2_per_dim": F.when(asked, F.create_map(F.lit("flow"), flow)), "raw": F.when(asked, F.create_map(F.lit("flow"), (F.length("text") % 5 + 1).cast("int"))), "reasoning": F.when(asked, F.lit("said"))})
    return J.with_final(rows)


_LAYERS = f"""{CLASSES}, asked AS (SELECT *, CASE label WHEN 'human' THEN NOT (score > 0.85 OR score < 0.3) WHEN 'ai' THEN NOT (score < 0.25) ELSE TRUE END AS asked FROM classes),
layers AS (SELECT *, CASE WHEN asked THEN (length(text) % 5) / 4.0::DOUBLE END AS l2, CASE WHEN asked THEN score * 0.4 + (length(text) % 5) / 4.0::DOUBLE * 0.6 ELSE score END AS final FROM asked)"""


@query(f"{_LAYERS} SELECT label, count(*) AS n, count(l2) AS n_l2, round(avg(score) + 1e-9, 6) AS mean_l1, round(avg(l2) + 1e-9, 6) AS mean_l2, round(avg(final) + 1e-9, 6) AS mean_final FROM layers GROUP BY label")
def layer_means(spark, sf_dir):
    return E.layer_means(_layers(spark, sf_dir))


@query(f"{_LAYERS}, v AS (SELECT 'l1' AS layer, label, score FROM layers UNION ALL SELECT 'combined', label, final FROM layers), h AS (SELECT layer, label, score, count(*)::DOUBLE AS c FROM v GROUP BY ALL) SELECT {_AREA.format(by_sel="p.layer AS layer, p.label || '_vs_' || n.label AS pair,")} FROM h p JOIN h n ON p.layer = n.layer AND (p.label, n.label) IN (('human', 'ai'), ('humanized', 'ai'), ('human', 'humanized')) GROUP BY p.layer, p.label, n.label")
def layer_aurocs(spark, sf_dir):
    return E.layer_aurocs(_layers(spark, sf_dir)).withColumn("auroc", F.round("auroc", 6))


@query(f"{_LAYERS} SELECT doc_id, label, round(score, 4) AS l1_overall, round(l2, 4) AS l2_overall, CASE WHEN asked THEN CAST(length(text) % 5 + 1 AS INTEGER) END AS flow, CASE WHEN asked THEN 'said' END AS l2_reasoning, round(final, 4) AS combined_overall, substr(text, 1, 150) AS text_preview FROM layers")
def combined_export(spark, sf_dir):
    rows = _layers(spark, sf_dir)
    made = E.combined_records(rows.withColumn("label", F.concat("doc_id", F.lit(":"), "label")))
    doc = F.substring_index("label", ":", 1).cast("long").alias("doc_id")
    return made.select(doc, F.substring_index("label", ":", -1).alias("label"), "l1_overall", "l2_overall", F.col("l2_raw.flow").alias("flow"), "l2_reasoning", "combined_overall", "text_preview")


@query(f"{SCORED}, p AS (SELECT doc_id, original AS text, original_score AS score, TRUE AS positive FROM scored UNION ALL SELECT doc_id, aiified, aiified_score, FALSE FROM scored), h AS (SELECT score, positive, count(*)::DOUBLE AS c FROM p GROUP BY ALL), t AS (SELECT t.score AS threshold, sum(CASE WHEN (h.score >= t.score) = h.positive THEN h.c ELSE 0 END) / sum(h.c) AS accuracy FROM (SELECT DISTINCT score FROM h) t, h GROUP BY t.score ORDER BY accuracy DESC, t.score LIMIT 1), area AS (SELECT {_AREA.format(by_sel='')} FROM h p, h n WHERE p.positive AND NOT n.positive) SELECT (SELECT auroc FROM area) AS auroc, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, count(*) FILTER (positive AND score >= threshold) AS tp, count(*) FILTER (NOT positive AND score >= threshold) AS fp, count(*) FILTER (NOT positive AND score < threshold) AS tn, count(*) FILTER (positive AND score < threshold) AS fn, count(*) FILTER (positive) AS n_human, count(*) FILTER (NOT positive) AS n_ai FROM p, t GROUP BY threshold, accuracy")
def evaluation(spark, sf_dir):
    rows = R.labelled_texts(_texts(spark, sf_dir), ["doc_id"], ("human", "ai"))
    return E.evaluate(rows)["overall"].withColumns({c: F.round(c, 6) for c in ("auroc", "threshold", "accuracy")})


@query()  # the gate has no SQL; tests/test_rules.py holds it against Python
def accepted_pairs(spark, sf_dir):
    gated = G.gate(_triples(spark, sf_dir), G.Thresholds(max_aiified_score=1.0, min_humanized_score=0.0, min_humanize_delta=0.0, min_aiify_delta=-1.0, min_dim_improvements=0, max_aiify_to_original=9.0, max_humanized_to_aiified=9.0, max_humanized_to_original=9.0, min_length_ratio=0.0), preserve=False)
    return E.accepted_pairs(gated.withColumnsRenamed({"doc_id": "id", "lang": "domain"})).withColumn("suspicion_flags", F.array_join("suspicion_flags", "|"))


# ---------------------------------------------------------------- layer 2 with offline stand-ins
@query()
def judge_stub(spark, sf_dir):
    rows = S.with_scores(_texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("original").alias("text")), ["text"]).select("id", "text", F.col("text_score").alias("score"))
    return J.gated(rows, lambda: lambda t: {"flow": 1 + len(t) % 5, "voice": 1 + t.count(" ") % 5}, _RUBRIC).select("id", F.round("score", 6).alias("score"), "l2_overall", "combined")


@query()
def rewrite_stub(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return J.rewrite(rows, lambda: lambda prompt: prompt.upper(), "Rewrite: {input_text}")
