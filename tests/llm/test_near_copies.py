"""The pipeline's near-copy stage against brute force over all pairs."""

import random

from prosewright.llm import simhash


def edited(rng, words, share):
    return [rng.choice(["so", "then", "but", "here", "now"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_at_similarity_0_8(spark):
    rng, texts = random.Random(8), []
    for _ in range(40):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randint(40, 400))]
        texts += [base] + [edited(rng, base, rng.choice([0.002, 0.01, 0.02, 0.025, 0.04])) for _ in range(4)]
    crowd = [f"c{k}" for k in range(300)]
    texts += [edited(rng, crowd, 0.012) for _ in range(80)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    close = 0
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                close += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert close > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect())
    assert kept == sorted(set(group))


def test_bands_of_pairs_at_0_8_meet():
    rng, met = random.Random(9), 0
    for _ in range(300):
        common, one, two = ([rng.getrandbits(64) for _ in range(n)] for n in (400, 50, 50))
        a, b = (simhash.band_keys(simhash.np.array(sorted(common + own), "u8")) for own in (one, two))
        met += bool((a == b).any())
    assert met == 300


def test_fingerprints_and_home_anchors_equal_plain_ones():
    rng, free = random.Random(10), 5
    sets = [simhash.np.array(sorted(rng.getrandbits(64) for _ in range(n)), "u8") for n in (1, 2, 300, 900)]
    m = 2**64 - 1
    for s in sets:
        votes = [int(x) >> b & 1 for x in simhash._SALTS for b in range(64)]
        for h in s.tolist():
            for k, (salt, odd) in enumerate(zip(simhash._SALTS.tolist(), simhash._ODD.tolist(), strict=True)):
                x = (h ^ salt) * odd & m
                x = (x ^ x >> 32) * odd & m
                x ^= x >> 29
                for b in range(64):
                    votes[64 * k + b] += x >> b & 1
        bits = [v * 2 > len(s) + 1 for v in votes]
        assert simhash.np.unpackbits(simhash.set_print(s), bitorder="little").tolist() == bits
        words = [w for w in range(1 << 15) if simhash.syndrome_of(w) == 0]
        for k, key in enumerate(simhash.band_keys(s, free).tolist()[:20]):
            value = sum(bits[at] << i for i, at in enumerate(simhash._PLACES[k][: 15 + free].tolist()))
            home = min(words, key=lambda w: (w ^ value & 0x7FFF).bit_count())
            assert (home ^ value & 0x7FFF).bit_count() <= 1 and key == k << 40 | value >> 15 << 15 | home


def test_near_copies_meet_by_anchors_of_fingerprints(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(edited(rng, base, 0.003)) for _ in range(12)] + ["", None, "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == [0, 12, 14]
    monkeypatch.setattr(simhash, "anchor_rows", lambda keyed, free: spark.createDataFrame([], "key long, id long"))
    alone = {frozenset(shingles(t or "")) for t in texts}
    assert simhash.keep_one_of_each(docs).count() == len(alone) > 3


def test_texts_that_cannot_link_make_few_candidates(spark, monkeypatch):
    rng, made, cut = random.Random(13), [], simhash.Scratch.cut

    def counted(self, df):
        out = cut(self, df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "cut", counted)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(edited(rng, base, 0.05)) for _ in range(150)] + [f"x{k} y" for k in range(400)]
    at_bound = [f"z{k}" for k in range(9)]  # four of five shingles, and three of four
    texts += [" ".join(at_bound), " ".join(at_bound[:8]), "p q r s t u v w", "p q r s t u v"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()}
    assert set(range(len(texts))) - kept == {551}
    assert max(made) <= len(texts), made
