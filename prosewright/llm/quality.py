"""Document quality from a linear-chain CRF over lines.

Each line is good or bad. What a line looks like is put into numbers (shares of
capitals, digits, symbols and spaces among its bytes, repeated words, word
length and so on), joined with those of the lines before and after it. The CRF
gives each line the probability of being good given the whole document; their
mean, weighted by the lines' lengths, is the document's quality, which a
logistic curve maps to the share of documents labelled good.

Labels are known for documents only. In training, the lines of a good document
are good; those of a bad one are bad at first, and in a second round those
that look good to the first model are taken as good, as long as one bad line
remains. The model is fitted on at most ``SAMPLE`` labelled documents, those
with the smallest hash of their id, without those of more than ``FIT_LINES``
lines: so what the driver holds is bounded. Every text is then scored whole.

Defined results: null and empty texts are one empty line, and are scored as
such; a document's score depends on its text alone; repeated rows are scored
alike; if no document carries a label, or all labels are alike, every score is
the share of good labels (1 without any). Labels other than 0 and 1 are not
used. Extra columns are passed on by ``score`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.crf import Chain, batches, forward_backward, padded, train

SAMPLE = 2000
FIT_LINES = 500
THRESHOLD = 0.7
#: Lines of a training sequence.
RUN = 48
#: Bytes of texts put into numbers at once.
SLICE = 8_000_000

# classes of bytes: 0 capital, 1 small letter, 2 part of another letter, 3 digit, 4 space, 5 sentence mark, 6 symbol
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 4, 5
N_OWN = 17


def line_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines laid end to end, bytes of each line, lines of each text."""
    lines: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        counts[i] = len(own)
        lines += own
    if not lines:
        return np.zeros((0, N_OWN)), np.zeros(0), counts
    data = "\n".join(lines).encode("utf-8", "surrogatepass") + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(float)
    classes = _CLASS[raw]
    x = np.zeros((len(lines), N_OWN))
    safe = np.maximum(size, 1)
    for c in range(7):
        x[:, c] = np.add.reduceat(classes == c, starts, dtype=np.int32) - (c == 6)  # the line feed is a symbol
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = (raw[1:] == raw[:-1]) & (raw[1:] != 10) & ((classes[1:] == 6) | (raw[1:] == 33))
    x[:, 7] = np.add.reduceat(doubled, starts, dtype=np.int32)
    capitals = x[:, 0] / np.maximum(x[:, 0] + x[:, 1], 1)
    x[:, :8] /= safe[:, None]
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            row = x[i]
            row[8] = 1 - len(set(words)) / n
            row[9] = sum(map(eq, words, words[1:])) / n
            row[10] = min(size[i] / n, 30) / 10
            row[11] = line[-1] in ".!?"
            row[12] = words.count("|") / n
            row[13] = n < 3
    x[:, 14] = capitals
    x[:, 15] = np.minimum(np.log1p(size), 10) / 5
    x[:, 16] = 1
    return x, size, counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own numbers, those of the line before and of the line after (zeros at the ends of a text)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after])


@dataclass
class Model:
    chain: Chain | None
    scale: float
    shift: float
    prior: float

    def goodness(self, x: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' probabilities of being good."""
        p, weight = line_marginals(self.chain, x, counts), size + 1
        at = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.chain is None:
            return out
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (held == 0 or held < SLICE):
                held += len(texts[end] or "") + 1
                end += 1
            good = self.goodness(*line_numbers(texts[at:end]))
            out[at:end] = 1 / (1 + np.exp(-np.clip(self.scale * good + self.shift, -40, 40)))
            at = end
        return out


def line_marginals(chain: Chain, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of every line, the probability of being good."""
    emissions = with_neighbours(x, counts) @ chain.w
    at, out = np.cumsum(counts) - counts, np.empty(len(x))
    for g in batches(counts):
        e, mask = padded(emissions, at[g], counts[g])
        p = forward_backward(e, mask, chain)[0][:, :, 1]
        out[np.concatenate([np.arange(at[i], at[i] + counts[i]) for i in g])] = p[mask]
    return out


def fit(x: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels) or labels.min() == labels.max():
        return Model(None, 0, 0, float(labels.mean()) if len(labels) else 1.0)
    wide = with_neighbours(x, counts)
    y = np.repeat(labels, counts)
    # long documents are trained on in runs of lines: a chain forgets within a few of them
    runs = np.concatenate([[RUN] * (c // RUN) + [c % RUN] * (c % RUN > 0) for c in counts.tolist()]).astype(int)
    chain = train(wide, y, runs, 2)
    doc = np.repeat(np.arange(len(labels)), counts)
    p = line_marginals(chain, x, counts)
    worst = np.full(len(labels), 2.0)
    np.minimum.at(worst, doc, p)
    y = np.where((y == 0) & (p > 0.5) & (worst[doc] < 0.5), 1, y)
    model = Model(train(wide, y, runs, 2), 1, 0, float(labels.mean()))
    good = model.goodness(x, size, counts)
    a, b = 10.0, -5.0
    for _ in range(200):  # logistic curve by Newton's method, with a weak prior that keeps it finite
        q = 1 / (1 + np.exp(-np.clip(a * good + b, -40, 40)))
        g = np.array([((labels - q) * good).sum() - 1e-2 * a, (labels - q).sum() - 1e-2 * b])
        w = q * (1 - q)
        h = np.array([[(w * good * good).sum() + 1e-2, (w * good).sum()], [(w * good).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 3 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.scale, model.shift = float(a), float(b)
    return model


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``sample`` documents of ``docs`` that ``labels`` (``doc_id`` and ``label_col``) covers."""

    def numbers(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            b = b.filter(pa.array([(t or "").count("\n") < FIT_LINES for t in b.column(1).to_pylist()], pa.bool_()))
            x, size, counts = line_numbers(b.column(1).to_pylist())
            ends = np.cumsum(counts)
            pack = lambda v, k=1: [v[e - c : e].ravel() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(x), pa.list_(pa.float64())), pa.array(pack(size), pa.list_(pa.float64()))], names=["label", "x", "size"])

    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .filter(F.col("__label").isin(0, 1) & F.col("__id").isNotNull())
        .orderBy(F.xxhash64("__id"), "__id", "__label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id").select("__label", "__text")  # at most `sample` small rows
    got = sorted(rows.mapInArrow(numbers, "label int, x array<double>, size array<double>").collect(), key=lambda r: (r["label"], r["size"], r["x"]))
    if not got:
        return fit(np.zeros((0, N_OWN)), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    x = np.concatenate([np.array(r["x"]).reshape(-1, N_OWN) for r in got])
    return fit(x, np.concatenate([r["size"] for r in got]), np.array([len(r["size"]) for r in got]), np.array([r["label"] for r in got]))


def score(model: Model, text: Column) -> Column:
    """The quality of a text, from 0 to 1, as a column."""

    @F.arrow_udf("double")
    def of(batches_: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches_:
            yield pa.array(model.score(texts.to_pylist()))

    return of(text)


def learning_labels(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    """The labels that may be learned from."""
    return labels.filter(fold(F.col("doc_id"), modulus) != held)


def fold(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every document's score; the fold 2 of 4 is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs, learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), 4, 2))
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
