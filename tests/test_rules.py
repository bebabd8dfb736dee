"""Layer 1, extraction, preservation, the gate, seeds and the offline judge against plain Python."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from prosewright.functions import extract as X
from prosewright.functions import patterns as P
from prosewright.functions import score as S
from prosewright.operators import gate as G
from prosewright.operators import judge as J
from prosewright.operators import triples as R
from prosewright.plans import catalogue

PHRASES = """Certainly! Let us begin.|That's an excellent point about rivers.|I'd be happy to help you.|When working with pytest, wait.|In modern development workflows, we ship.|It is worth noting that|it's also worth mentioning
it is important to note and consider|may potentially|could be considered|one might argue|to be fair,|I should mention|I'd add|one common pitfall|one of the most important|In general, it rains.|generally speaking,|in many cases,|as a general rule,|what's interesting here is
Furthermore, we go.|MOREOVER|additionally|in addition|consequently|cannot be overstated|profound impact|critically important|it is crucial to understand|don't|can't|It's|they're|I've|he's|you'd|let's|we'll|x—y|a -- b|--
I hope this helps!|Let me know if you have time.|feel free to ask|do not hesitate to call|In conclusion, no.|to sum up, yes|if you need any more|ſure it iſ worth noting|İt is worth noting|- one item|* two|3. three|• four|plain words here|Short.|Is that so?|3.14.1|1,234.50|$1,200|11:30|2024-04-15|42%|180 ms|7 x|99|GDPR|GitHub|pg_stat.activity|e-mail|Mike|Mike met Anna|Anna|The|MAX_SIZE|`code here`|file.py|camelCaseName|Hi Mike,|Re: this| wide space\x1c end""".replace("\n", "|").split("|")


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(21), ["", " \n\t ", "one", "Really?", "a\n\n\nb\n\n", "Hi there.\n\nI hope this helps\n", "x" * 3000, "- a\n- b\n  - c\n\n4) d"]
    for _ in range(400):
        parts = [rng.choice(PHRASES) + rng.choice([" ", " ", "\n", "\n\n", ". ", "! ", "\n \n"]) for _ in range(rng.randint(1, 25))]
        out.append("".join(parts))
    return out


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string").cache()


def ladder(value, steps, rest):
    for test, tenths in steps:
        if test(value):
            return tenths
    return rest


def plain_dims(t):
    words, stripped = t.split(), t.strip()
    n = len(words)
    count = lambda patterns: sum(len(re.findall(p, t, re.I)) for p in patterns)
    per = max(n / 200, 1)
    lines = [x for x in stripped.split("\n") if x.strip()]
    share = sum(bool(re.match(r"\s*(?:[-*•]|\d+[.)]) ", x)) for x in lines) / max(len(lines), 1)
    sizes = [k for k in (len(x.split()) for x in re.split(r"(?<=[.!?])\s+", stripped)) if k >= 2]
    paragraphs = [x.strip() for x in stripped.split("\n\n") if x.strip()]
    last = paragraphs[-1] if paragraphs else ""
    tail = last + " " + last.split("\n")[-1]
    at_least = lambda *pairs: [(lambda v, b=b: v >= b, x) for b, x in pairs]
    above = lambda *pairs: [(lambda v, b=b: v > b, x) for b, x in pairs]
    below = lambda *pairs: [(lambda v, b=b: v < b, x) for b, x in pairs]
    spread = statistics.stdev(sizes) / statistics.mean(sizes) if len(sizes) > 2 else 0
    return {
        "opener_pattern": 0 if any(re.search(p, stripped.split("\n")[0], re.I) for p in P.OPENERS) else 10,
        "hedging_density": 5 if not n else ladder(count(P.HEDGES) / per, at_least((3, 1), (2, 3), (1, 5), (0.5, 8)), 10),
        "list_overuse": 5 if not lines else ladder(share, above((0.5, 1), (0.25, 3), (0.1, 5), (0.05, 7)), 10),
        "sentence_variance": 5 if len(sizes) < 3 else ladder(spread, below((0.15, 1), (0.25, 3), (0.35, 5), (0.5, 7)), 9),
        "contractions": 5 if not n else ladder(count(P.CONTRACTIONS) / n, below((0.005, 2), (0.015, 5), (0.035, 8)), 9),
        "closing_pattern": 0 if any(re.search(p, tail, re.I) for p in P.CLOSINGS) else 10,
        "em_dash_density": 5 if not n else ladder(len(re.findall("—|--", t)) / n * 500, above((3, 1), (1.5, 3), (0.5, 5), (0.2, 7)), 9),
        "transition_overuse": 5 if not n else ladder(count(P.TRANSITIONS) / per, at_least((3, 1), (2, 3), (1, 5)), 9),
    }


def test_layer_1(frame, texts):
    got = {r["k"]: r["t_dims"].asDict() for r in S.with_dims(frame, ["t"]).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_dims(t), (t, got[k])


def test_every_match_holds_a_needed_string():
    for patterns in (P.HEDGES, P.TRANSITIONS):
        for p, parts in patterns.items():
            hits = [m.group() for x in PHRASES for m in re.finditer(p, x, re.I)]
            assert all(any(s in h.lower().replace("ſ", "s") for s in parts) for h in hits), p


def plain_numbers(t):
    return {m.group().strip().replace(",", "").lower() for m in re.finditer(P.NUMBER, t, re.I)}


def plain_entities(t):
    tokens = re.findall(P.TOKEN, t)
    strong = lambda w: len(w) > 1 and (any(c.isupper() for c in w[1:]) or "." in w or "-" in w)
    return {w for w in tokens if w not in P.STOPWORDS and len(w) > 1 and (strong(w) or (w[0].isupper() and tokens.count(w) > 1))}


def plain_drift(a, b):
    email = lambda t: bool(re.match(P.GREETING, t.strip().split("\n")[0], re.I))
    question = lambda t: t.rstrip().endswith("?")
    return ["question_to_statement"] * (question(a) and not question(b)) + ["email_lost_greeting"] * (email(a) and not email(b))


def test_extraction(frame, texts):
    t = F.col("t")
    got = {r["k"]: r for r in frame.select("k", X.numbers(t).alias("n"), X.entities(t).alias("e"), X.anchors(t).alias("a"), X.is_question(t).alias("q")).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (set(r["n"]), set(r["e"]), r["a"], r["q"]) == (plain_numbers(text), plain_entities(text), len(re.findall(P.ANCHOR, text)), text.rstrip().endswith("?")), text
        assert len(r["n"]) == len(set(r["n"])) and len(r["e"]) == len(set(r["e"]))


def test_preservation_and_gate(spark, texts):
    rng = random.Random(4)
    rows = [(k, a, rng.choice([a, rng.choice(texts)]), rng.choice([a, rng.choice(texts)])) for k, a in enumerate(texts)]
    df = R.score_triples(spark.createDataFrame(rows, "id int, original string, aiified string, humanized string"))
    t = G.Thresholds()
    score = lambda x: sum(plain_dims(x).values()) / 80
    size = lambda x: len(re.findall(r"[^\W]+", x))
    ratio = lambda a, b: size(a) / max(size(b), 1)
    some = 0
    for r in G.gate(df).collect():
        o, a, h = r["original"], r["aiified"], r["humanized"]
        so, sa, sh = score(o), score(a), score(h)
        better = sum(plain_dims(h)[d] / 10 - plain_dims(a)[d] / 10 >= 0.05 for d in S.DIMENSIONS)
        want = [f"aiified_score>{t.max_aiified_score}"] * (sa > t.max_aiified_score) + [f"humanized_score<{t.min_humanized_score}"] * (sh < t.min_humanized_score)
        want += [f"aiify_delta<{t.min_aiify_delta}"] * (so - sa < t.min_aiify_delta) + [f"humanize_delta<{t.min_humanize_delta}"] * (sh - sa < t.min_humanize_delta) + [f"dim_improvements<{t.min_dim_improvements}"] * (better < 2)
        for name, x, most in (("aiify/original", ratio(a, o), 1.25), ("humanized/aiified", ratio(h, a), 1.2), ("humanized/original", ratio(h, o), 1.2)):
            want += [f"length_ratio_{name}>{most}"] * (x > most) + [f"length_ratio_{name}<0.75"] * (x < 0.75)
        for stage, new in (("aiify", a), ("humanize", h)):
            for what, of in (("numbers", plain_numbers), ("entities", plain_entities)):
                lost = sorted(of(o) - of(new))
                want += [f"{stage}_dropped_{what}:{','.join(lost[:3])}"] * bool(lost)
            want += [f"{stage}_role_drift:{d}" for d in plain_drift(o, new)]
            kept = r[f"{stage}_kept"]
            assert kept["numbers_added"] == sorted(plain_numbers(new) - plain_numbers(o)) and kept["entities_added"] == sorted(plain_entities(new) - plain_entities(o))
            assert kept["has_violations"] == bool(plain_numbers(o) - plain_numbers(new) or plain_entities(o) - plain_entities(new) or plain_drift(o, new))
        assert r["rejected_reasons"] == want and r["accepted"] == (not want)
        recovery = (sh - sa) / (so - sa) if so - sa > 0 else 0.0
        assert r["suspicion_flags"] == ["recovery_ratio>1.25"] * (recovery > 1.25) + ["humanized_beats_original"] * (sh - so > 0.05)
        assert math.isclose(r["metrics"]["recovery_ratio"], recovery, abs_tol=1e-9)
        some += bool(want)
    assert some > 100


def test_seed_stats(spark, sf_dir):
    rows = catalogue._seeds(spark, sf_dir).collect()
    by = {}
    for r in rows:
        assert r["anchors_count"] == len(re.findall(P.ANCHOR, r["text"])) and r["word_count"] == len(re.findall(r"\w+", r["text"]))
        by.setdefault(r["domain"], []).append((r["word_count"], r["anchors_count"]))
    got = {r["domain"]: tuple(r)[1:] for r in catalogue.QUERIES["seed_stats"](spark, sf_dir).collect()}
    assert got == {d: (len(v), min(v)[0], sorted(x[0] for x in v)[len(v) // 2], max(v)[0], min(x[1] for x in v), max(x[1] for x in v)) for d, v in by.items()}


def test_judge(spark):
    weights = {"flow": 0.5, "voice": 0.5}
    rows = spark.createDataFrame([(1, "good text", 0.5), (1, "good text again", 0.5), (2, "fail", 0.6), (3, "decided", 0.99), (4, None, 0.4)], "id int, text string, score double")

    def make():
        def judge(t):
            if t == "fail":
                raise RuntimeError
            return {"flow": 5, "voice": 3}, f"of {t}"

        return judge

    got = sorted((r["id"], r["text"] or "", r["l2_overall"], r["reasoning"], round(r["final"], 6)) for r in J.gated(rows, make, weights).collect())
    assert got == [(1, "good text", 0.75, "of good text", 0.65), (1, "good text again", 0.75, "of good text again", 0.65), (2, "fail", 0.5, None, 0.54), (3, "decided", None, None, 0.99), (4, "", 0.75, "of ", 0.61)]
    assert J.judge_one("x", make(), weights) == {"raw": {"flow": 5, "voice": 3}, "reasoning": "of x", "l2_per_dim": {"flow": 1.0, "voice": 0.5}, "l2_overall": 0.75}
    assert J.judge_one("fail", make(), weights)["l2_overall"] == 0.5
    missing = J.rate(rows.limit(1), lambda: lambda t: {"flow": 5}, weights).first()
    assert (missing["l2_overall"], missing["l2_per_dim"]) == (0.5, {"flow": 1.0, "voice": 0.0})
    assert J.gated(rows, make, weights, skip_gate=True).filter("id = 3").first()["l2_overall"] == 0.75
    classes = spark.createDataFrame([("human", "a", 0.9), ("human", "b", 0.5), ("ai", "c", 0.2), ("humanized", "d", 0.95)], "label string, text string, score double")
    asked = {r["text"]: r["l2_overall"] is not None for r in J.drive(classes, make, weights).collect()}
    assert asked == {"a": False, "b": True, "c": False, "d": True}


def test_client(monkeypatch):
    client = J.Client("some-judge", key_variable="PROSEWRIGHT_NO_SUCH_KEY", retries=2)
    with pytest.raises(RuntimeError):
        client.key()
    monkeypatch.setenv("PROSEWRIGHT_NO_SUCH_KEY", "k")
    assert client.key() == "k"
    calls = []

    def flaky(t):
        calls.append(t)
        if len(calls) < 3:
            raise OSError
        return t

    assert client.patient(flaky)("x") == "x" and len(calls) == 3


def test_rewrite_and_length(spark):
    rows = spark.createDataFrame([(i, "w" * n) for i, n in enumerate([0, 40, 41, 4086, 4087])] + [(9, None)], "id int, text string")
    got = J.rewrite(rows, lambda: lambda p: p.upper(), "Rewrite: {input_text}")
    assert sorted((r["id"], r["response"]) for r in got.collect()) == [(str(i), "REWRITE: " + "W" * n) for i, n in [(2, 41), (3, 4086), (4, 4087)]]
    assert J.length_bounds({"filters": {"length": {"min_length": 10, "max_length": 20}}}) == (10, 20)
    assert J.length_bounds({"filters": [{"type": "length", "min": 5, "max": 7}]}) == (5, 7) and J.length_bounds({}) == (50, 4096)


def test_rounding_is_pythons(spark):
    rng = random.Random(2)
    values = [2.675, 1.005, 0.125, 0.375, -0.125, 1e-9, 123456.78905, 0.0, 0.28125, 1234.00005] + [rng.uniform(-9, 9) for _ in range(300)] + [rng.randrange(10**6) / 10**5 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 4):
        assert [r[0] + 0.0 for r in df.select(S.rounded(df.v, digits)).collect()] == [round(v, digits) + 0.0 for v in values]
