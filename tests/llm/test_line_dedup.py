"""Line dedup against brute force, and on extreme and null ids, null and empty texts, repeated lines, an empty table."""

import random

from prosewright.llm import line_dedup
from tests.llm.test_edges import distance

LINE = "the quick brown fox jumps over the lazy dog today"


def test_edge_cases(spark):
    rows = [
        (-5, "x\n" + LINE),
        (-(2**63), "first line that is long enough to count here"),
        (2**63 - 1, "first line that is long enough to count hare"),
        (3, LINE.replace("quick", "quack") + "\n" + LINE),
        (None, LINE),
        (7, None),
        (8, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {tuple(r) for r in line_dedup.repeated_lines(docs).collect()}
    assert gone == {(3, 0, -5, 1), (3, 1, -5, 1), (2**63 - 1, 0, -(2**63), 0)}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept == dict(rows) | {3: "", 2**63 - 1: ""}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_within_equals_brute_force(spark):
    rng = random.Random(11)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("é😀x", "😀x"), ("a" * 200, "a" * 202), ("ab" * 90, "ba" * 90)]
    for _ in range(600):
        x = [rng.choice("abcé") for _ in range(rng.randint(0, 12))]
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "z"])
        pairs.append(("".join(x), "".join(y)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for tau in (0, 1, 2, 3):
        got = [r[0] for r in df.select(line_dedup.within(df.x, df.y, tau)).collect()]
        assert got == [distance(x, y) <= tau for x, y in pairs]


def brute(rows, tau=2):
    """Lines to go, by comparing all pairs of distinct lines."""
    occ = sorted((i, k, s.strip(" \t\r").lower()) for i, t in rows if i is not None for k, s in enumerate((t or "").split("\n")) if s.strip(" \t\r"))
    lines = sorted({s for _, _, s in occ})
    of = {s: s for s in lines}
    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= line_dedup.EDIT_CHARS and abs(len(a) - len(b)) <= tau and of[a] != of[b] and distance(a, b) <= tau:
                old, new = of[a], of[b]
                of = {s: new if c == old else c for s, c in of.items()}
    seen, gone = set(), set()
    for i, k, s in occ:
        (gone.add((i, k)) if of[s] in seen else seen.add(of[s]))
    return gone


def test_removed_lines_equal_brute_force(spark):
    rng, rows = random.Random(4), []
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "x" for n in (3, 12, 23, 24, 25, 26, 40, 61, 80)]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(s))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r[0], r[1]) for r in line_dedup.repeated_lines(docs).collect()} == brute(rows)


def test_clashing_columns_and_a_long_text(spark):
    text = "\n".join(f"line number {k} of a text that is very long indeed" for k in range(3000)) + "\n" + "z" * 300_000
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 1, 2, 3)], "doc_id long, text string, gone int, doc int, __gone int")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[2]["text"] == "" and (out[2]["gone"], out[2]["doc"], out[2]["__gone"]) == (1, 2, 3)
    assert out[1]["text"].startswith("line number 0") and out[1]["text"].endswith("z")
