"""Quality and toxicity: held-out accuracy on made-up texts, and nulls, empty and long texts, labels of one class or none."""

import random

import numpy as np
import pytest

from prosewright.llm import quality, toxicity

SYLLABLES = "an be co du el fi go ha in jo ka le mo na or pe qui ra so ti un ve wi".split()
INSULTS = ["blockhead", "nitwit", "dunderpate", "scoundrel", "ganzblöde"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def sentences(rng, n, insult=""):
    out = []
    for k in range(n):
        words = [word(rng) for _ in range(rng.randint(4, 12))]
        if insult and k == 0:
            words.insert(rng.randrange(len(words)), insult)
        out.append(" ".join(words).capitalize() + ".")
    rng.shuffle(out)
    return " ".join(out)


def disguised(rng, w):
    at = rng.randrange(1, len(w) - 1)
    return rng.choice([w, w.upper(), w[:at] + "*" + w[at:], w[:at] + rng.choice("xyz") + w[at:], " ".join(w), w + "!!"])


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def toxic_docs(seed, n):
    rng = random.Random(seed)
    y = [int(k % 5 == 0) for k in range(n)]
    return [sentences(rng, rng.randint(1, 6), disguised(rng, rng.choice(INSULTS)) if t else "") for t in y], np.array(y)


def test_toxicity_on_held_out_texts(spark):
    texts, y = toxic_docs(1, 900)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(t), 0) for i, t in enumerate(y)] + [(5000, 1, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train_on(docs, labels)
    held, truth = toxic_docs(2, 400)
    score = model.score(held)
    assert auc(score, truth) > 0.95 and ((score >= 0.5) & (truth == 0)).mean() < 0.02 and (score >= 0.5)[truth == 1].mean() > 0.85
    assert (model.score(held) == score).all()
    odd = [None, "", " \n", "ab", "漢字 текст", "a" * 100_000, "blockhead " * 50_000, "b l o c k h e a d"]
    got = model.score(odd)
    assert ((got >= 0) & (got <= 1)).all() and got[0] == got[1] == got[2] < 0.5 and got[6] >= 0.5 and got[7] >= 0.5
    rows = docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, text string")
    assert [r[1] for r in rows.select("k", toxicity.score(model, rows.text)).orderBy("k").collect()] == pytest.approx(got.tolist())


def test_kernel_equals_enumeration():
    from itertools import combinations

    def features(w):
        out = {}
        for at in combinations(range(len(w)), 3):
            key = tuple(w[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    a, b = "blockhead", "bloxckhead"
    fa, fb = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    want = dot(fa, fb) / np.sqrt(dot(fa, fa) * dot(fb, fb))
    assert toxicity.Marks.of([a]).kernels([b])[0, 0] == pytest.approx(want)


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1], [None, 7, None]])
def test_toxicity_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(i, "some text") for i in range(3)], "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    share = float(bool(labels) and labels[0] == 1)
    assert toxicity.train_on(docs, table).score(["x", None]).tolist() == [share, share]


def page(rng, good):
    if good:
        return "\n".join(sentences(rng, rng.randint(1, 3)) for _ in range(rng.randint(1, 6)))
    kinds = [lambda: "| " + " | ".join(word(rng) for _ in range(8)) + " |", lambda: (word(rng) + " ") * 9, lambda: "".join(rng.choice("#$%&*<>={}") for _ in range(40)), lambda: " ".join(word(rng).upper() + "!!" for _ in range(8))]
    kind = rng.choice(kinds)
    return "\n".join(kind() for _ in range(rng.randint(1, 6)))


def test_quality_on_held_out_texts(spark):
    rng = random.Random(3)
    y = [int(k % 3 > 0) for k in range(500)]
    docs = spark.createDataFrame([(i, page(rng, t), "x") for i, t in enumerate(y)], "doc_id long, text string, label string")
    model = quality.train_on(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"))
    truth = np.array([int(k % 3 > 0) for k in range(300)])
    held = [page(rng, t) for t in truth]
    score = model.score(held)
    assert auc(score, truth) > 0.99 and ((score >= quality.THRESHOLD) == truth).mean() > 0.97
    odd = [None, "", "\n\n", "x" * 500_000, "\n".join("a line of words." for _ in range(20_000))]
    got = model.score(odd)
    assert ((got >= 0) & (got <= 1)).all() and got[0] == got[1]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, text string")
    assert [r[1] for r in frame.select("k", quality.score(model, frame.text)).orderBy("k").collect()] == pytest.approx(got.tolist())


@pytest.mark.parametrize("labels, share", [([], 1.0), ([1, 1], 1.0), ([0, 0], 0.0), ([None, 9], 1.0)])
def test_quality_without_both_classes(spark, labels, share):
    docs = spark.createDataFrame([(i, "some text") for i in range(3)], "doc_id long, text string")
    assert quality.train_on(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")).score(["x", None]).tolist() == [share, share]


def test_line_marginals_are_weighted_by_length():
    rng = np.random.default_rng(0)
    from prosewright.llm.crf import Chain

    x, size, counts = quality.line_numbers(["a good line.\n###", None, "one\ntwo three\n"])
    model = quality.Model(Chain(rng.normal(size=(3 * quality.N_OWN, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)), 1, 0, 0.5)
    p, at, want = quality.line_marginals(model.chain, x, counts), 0, []
    for n in counts:
        w = size[at : at + n] + 1
        want.append((p[at : at + n] * w).sum() / w.sum())
        at += n
    assert model.goodness(x, size, counts) == pytest.approx(want) and counts.tolist() == [2, 1, 3]
