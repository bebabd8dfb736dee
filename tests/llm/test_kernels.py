"""The operators' kernels against brute force, without Spark."""

import itertools
import random
import re

import numpy as np

from prosewright.llm import crf, decontamination, packing, pii, sharding, simhash

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choice("a@.-1+ 2(") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 100_000 + "a" * 100_000 + "@") == []


def test_hypergeometric_matrix_has_its_sums():
    blocks, shards = [7, 0, 100, 33], sharding.shard_sizes(140, 24)
    m = sharding.communication_matrix(blocks, shards, 1)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m, strict=True)] == shards


def test_hypergeometric_mean():
    rng = random.Random(5)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and max(draws) <= 20


def test_every_close_pair_meets_under_an_anchor():
    for width in simhash.widths(3):
        near = simhash.flips(width, 2)
        home = simhash.flips(15, 1)
        rng = random.Random(width)
        for _ in range(300):
            x = rng.getrandbits(width)
            y = x ^ (1 << rng.randrange(width))
            s = simhash.syndrome_of(x & 0x7FFF)
            anchor = x ^ home[s][0]
            assert anchor in {y ^ m for m in near[simhash.syndrome_of(y & 0x7FFF)]}


def test_fingerprint_edges():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_packing_keeps_every_token_and_limits():
    rng = random.Random(1)
    sizes = [rng.randint(1, 3000) for _ in range(300)]
    limits = packing.Limits(tokens=1024, segments=4, loss=1024, pool=32)
    got = list(packing.pack((packing.Item(i, 0, n, n) for i, n in enumerate(sizes)), limits, cut=True))
    for i, own in itertools.groupby(sorted(got, key=lambda g: (g[2].key, g[2].start)), key=lambda g: g[2].key):
        at = 0
        for _, _, p in own:
            assert p.start == at
            at += p.tokens
        assert at == sizes[i]
    for _, own in itertools.groupby(got, key=lambda g: g[0]):
        own = list(own)
        assert len(own) <= 4 and sum(p.tokens for _, _, p in own) <= 1024


def test_encoder_equals_the_library():
    e = packing.Encoder(packing.vocabulary_path())
    for t in ["", "a  b", "\n", "x\ty", " lead", "trail ", "a\n\nb", "don't stop 123's", "é ½ x²", "<|endoftext|> x", "one two\nthree."]:
        assert e(t) == e.library(t), t


def test_leaks_with_edits():
    item = "the quick brown fox jumps over the lazy dog and then goes home to sleep for the night again"
    items = decontamination.Items([(7, item)], decontamination.RATE, decontamination.MIN_CHARS)
    found = items.search(["xx the quick brwn fox jumps over thee lazy dog and then goes hme to sleep for the night again yy", "nothing here", "", "a " * 50 + item])
    assert [(d, i, e) for d, i, e, *_ in found] == [(0, 0, 3), (3, 0, 0)]


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e, chain = rng.normal(size=(1, 4, 3)), crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    score = {p: chain.start[p[0]] + sum(e[0, t, s] for t, s in enumerate(p)) + sum(chain.trans[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product(range(3), repeat=4)}
    mask = np.ones((1, 4), bool)
    assert tuple(crf.viterbi(e, mask, chain)[0]) == max(score, key=score.get)
    whole = sum(np.exp(s) for s in score.values())
    want = sum(np.exp(s) for p, s in score.items() if p[2] == 1) / whole
    assert np.isclose(crf.forward_backward(e, mask, chain)[0][0, 2, 1], want)
