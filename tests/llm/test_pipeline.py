"""The whole pipeline against brute force on a small folder of tables."""

import random
from zlib import crc32

import corpus_pipeline
from prosewright.llm import decontamination, packing, quality
from tests.llm.test_decontamination import fewest
from tests.llm.test_line_dedup import brute
from tests.llm.test_near_copies import shingles


def tables(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(5, 11))).capitalize() + "."
    good = lambda: "\n".join(" ".join(sentence() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 6)))
    bad = lambda: "\n".join("$$ || CLICK || " + word().upper() * 3 + " >>> !!! ### " + " | ".join(["buy"] * 6) for _ in range(rng.randint(2, 6)))
    bench = [(k, " ".join(word() for _ in range(18))) for k in range(5)]
    texts, labels = [], []
    for i in range(110):
        texts.append(bad() if i % 5 == 4 else good())
        labels.append((i, 0 if i % 5 == 4 else 1, 0))
    shared = sentence() + " " + sentence()
    for i in (0, 1, 2, 3):
        texts[i] += "\n" + shared.replace("a", "e", i % 3)  # up to two edits apart
    for i in (5, 6, 7):
        texts.append(texts[i])  # exact copies: their lines go
    long = [" ".join(sentence() for _ in range(12)) for _ in range(3)]
    for t in long:  # near copies of one line each, more than two edits apart
        texts += [t, t.replace(t.split(" ")[3], "another"), t + " " + word() + " " + word() + " " + word()]
    for k, (_, item) in enumerate(bench):
        texts[10 + k] = (texts[10 + k] if (10 + k) % 5 != 4 else good()) + " " + item.replace("e", "i", 1)
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs] + [(None, good(), "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return bench


def test_run_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    bench = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    before = len(rows)
    rows = [r for r, s in zip(rows, model.score([t for _, t in rows]), strict=True) if s >= quality.THRESHOLD]
    assert before - len(rows) > 15
    gone = brute(rows)
    assert len(gone) > 8
    rows = [(i, t if i is None or t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]
    sets = [shingles(t or "") for _, t in rows]
    group = {k: k for k in range(len(rows))}
    for b in range(len(rows)):
        for a in range(b):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    kept = [r for k, r in enumerate(rows) if r[0] is None or least[group[k]] == r[0]]
    assert len(rows) - len(kept) >= 5
    plain = [(i, decontamination.normal(t)) for i, t in bench]
    leaked = {k for k, (i, t) in enumerate(kept) for _, item in plain if i is not None and t and fewest(item, decontamination.normal(t)) <= decontamination.edit_budget(len(item))}
    assert len(leaked) >= 4
    final = [r for k, r in enumerate(kept) if k not in leaked]
    library = packing.encoder(packing.vocabulary_path()).library
    want = sorted((i is None, i or 0, len(library(t or "")) // 4 + 1, crc32(library(t or "") + b"\0\0\0\0")) for i, t in final)
    got = corpus_pipeline.run(spark, folder).collect()
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"])
    assert set(pieces) <= set(want)
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(None if null else i, n) for null, i, n, _ in want}
    assert sum(r["length"] for r in got) == sum(n for _, _, n, _ in want)


def test_stages_pass_on_empty_tables_and_keep_columns(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0, name
