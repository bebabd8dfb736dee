"""Leaks against a plain alignment, repetitive and long texts, items without an id."""

import random
import resource
import time

import numpy as np

from prosewright.llm import decontamination as D


def fewest(item, text):
    """Fewest edits from the whole item to any part of the text."""
    row = np.zeros(len(text) + 1, int)
    letters, lanes = np.array(list(text)), np.arange(len(text) + 1)
    for k, c in enumerate(item):
        new = np.concatenate([[k + 1], np.minimum(row[:-1] + (letters != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - lanes) + lanes
    return int(row.min())


def edited(rng, text, n, alphabet):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        s[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(alphabet)]])
    return "".join(s)


def test_leaks_equal_a_plain_alignment():
    rng = random.Random(2)
    for alphabet in ("abcdefghijklmnop ", "ab "):
        items = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([16, 25, 40, 90, 200])))) for i in range(12)]
        items += [(20, "abc " * 30), (21, "ab" * 40)]
        texts = []
        for _ in range(60):
            parts = []
            for _ in range(rng.randint(0, 3)):
                own = rng.choice(items)[1]
                parts.append(edited(rng, own, rng.choice([0, 1, int(0.08 * len(own)), int(0.08 * len(own)) + 1, 20]), alphabet))
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))))
            texts.append(D.normal("".join(parts)))
        index = D.Items(items, D.RATE, D.MIN_CHARS)
        got = {(d, i): edits for d, i, edits, _, _ in index.search(texts)}
        want = {}
        for d, t in enumerate(texts):
            for i, item in enumerate(index.texts):
                n = fewest(item, t) if t else len(item)
                if n <= D.edit_budget(len(item)):
                    want[d, i] = n
        assert got == want and len(want) > 40


def test_windows_of_a_long_text_equal_the_whole(monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    item = " ".join(rng.choice(words) for _ in range(30))
    text = " ".join(rng.choice(words) for _ in range(4000))
    index = D.Items([(1, item), (2, "abc " * 30)], D.RATE, D.MIN_CHARS)
    for at in (0, 995, 1000, 1003, len(text)):
        whole = text[:at] + edited(rng, item, 3, "xyz") + text[at:] + " abc" * 40
        want = [tuple(r[1:]) for r in index.search([whole])]
        monkeypatch.setattr(D, "SLICE", 1000)
        assert index.search_long(whole) == want and len(want) == 2
        monkeypatch.undo()


def test_repetition_takes_bounded_memory():
    index = D.Items([(1, "ab " * 400), (2, "-" * 500), (3, "one two three four five six seven eight nine ten")], D.RATE, D.MIN_CHARS)
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text in ("ab " * 700_000, "-" * 2_000_000):
        found = index.search([D.normal(text)])
        assert [(i, e, s) for _, i, e, s, _ in found] in ([(0, 0, 0)], [(1, 0, 0)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - began < 30


def test_items_without_an_id_and_extra_columns(spark):
    bench = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog", "x"), (5, "tiny", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "so The quick  brown fox jumps over the lazy dog", 1), (2, "tiny", 2), (None, "the quick brown fox jumps over the lazy dog", 3)], "doc_id long, text string, item_id int")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == [(0, None), (1, None)]
    assert sorted(r["doc_id"] or 0 for r in D.without_leaks(docs, bench).collect()) == [0, 2]
