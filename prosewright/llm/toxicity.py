"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the three-letter subsequences they share; an
occurrence that spans k letters weighs ``DECAY ** k``, so letters that are left
out or put in lower the kernel a little and do not end it. Kernels are divided
by the words' norms. Landmarks are words of the training texts; the Nyström
map sends a word to its kernels with them, whitened, and a linear machine with
hinge loss is trained there. Its decision is a weighted sum of kernels with the
landmarks; as each kernel is an inner product over subsequences, the sum is
folded into one weight per subsequence, and a word's margin is exact at a cost
that does not depend on the number of landmarks. The few words of a larger
margin go to a second machine of the same kind whose kernel is a power of the
first: what shares most of an insult's letters, but is none, has to be told
from it there.

A sentence is as toxic as its worst word: labels are known per document, so
the words that speak for a toxic document are found first (seen in several
toxic ones and in no other), and words of other documents are the
counter-examples, the hardest of them found by a first machine. A logistic
curve, fitted on documents kept out of both steps, maps the worst margin of a
document to the score.

Words are runs without white space, in lower case, of letters alone (digits
that stand for letters are read as such, other signs are left out); letters
spelled one by one make up a word too. Words longer than ``LONGEST`` letters
are read in overlapping windows. Whole texts are read.

The fit uses at most ``SAMPLE`` labelled documents of each class, those with
the smallest hash of their id, without those of more than ``FIT_WORDS`` distinct
words: so what the driver holds is bounded. Every text is then scored whole.

Defined results: null and empty texts have no word and get the curve's value
at the lowest margin; equal texts have equal scores; without labels of both
classes every score is the share of toxic labels (0 without any). Labels other
than 0 and 1 are not used; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm.quality import fold, learning_labels

SAMPLE = 2000
FIT_WORDS = 3000
DECAY = 0.7
ORDER = 3
LONGEST = 24
LETTERS = 64
LANDMARKS = 160
#: Of more words that speak for toxicity than this, those that cover the toxic texts are the positive examples: near copies share many by chance.
LIST = 60
#: Words that speak for nothing, drawn as counter-examples, and the hardest of them that are added in each round.
COUNTER, HARDEST = 6000, 3000
#: Rounds in which the second machine is given its hardest counter-examples.
ROUNDS = 4
#: Words taken on trust where too few texts are labelled to tell chance from sign: repeated ones, or any.
TRUSTED, ANY = 50, 200
#: Words whose margins a worker keeps.
KEPT = 1_000_000
LOWEST = -2.0
#: Words of a larger margin are looked at by the second machine, whose kernel is this power of the first one's.
LOOKED_AT, POWER = -0.5, 4
THRESHOLD = 0.5

_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_OTHER = re.compile(r"[^\w]+|[_\d]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ ]\w){2,}(?!\S)")


_SINGLES = frozenset(map(chr, range(97, 123)))


def clean(word: str) -> str:
    """The letters of a lower-case word."""
    return word if word.isalpha() else _OTHER.sub("", word.translate(_LOOKALIKE) if not word.isdigit() else "")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a text as written, and those it spells letter by letter."""
    low = (text or "").lower()
    found = set(low.split())
    if len(_SINGLES & found) > 1 and _SPELLED.search(low):
        found.update(m.replace(" ", "") for m in _SPELLED.findall(low))
    return found


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters as numbers: a-z, then others by their code point."""
    points = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
    latin = (points >= 97) & (points <= 122)
    return np.where(latin, points - 97, 26 + points % (LETTERS - 26)).astype(np.int32)


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), ORDER)))
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def self_kernel(letters: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself, by dynamic programming over pairs of prefixes."""
    rows, n = letters.shape
    d2 = DECAY * DECAY
    equal = [[letters[:, i] == letters[:, j] for j in range(n)] for i in range(n)]
    inner = np.ones((n + 1, n + 1, rows))  # weighted shared subsequences of prefixes, stretched to their ends
    for _ in range(ORDER - 1):
        new = np.zeros_like(inner)
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, n + 1):
                run = DECAY * run + equal[i - 1][j - 1] * (d2 * inner[i - 1, j - 1])
                new[i, j] = DECAY * new[i - 1, j] + run
        inner = new
    total = np.zeros(rows)
    for i in range(n):
        for j in range(n):
            total += equal[i][j] * (d2 * inner[i, j])
    return total


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: subsequence numbers and their normed weights (a repeated number's weights add up)."""
    n = len(words[0])
    at, weight = _triples(n)
    letters = _codes(words, n)
    code = (letters[:, at[:, 0]] * LETTERS + letters[:, at[:, 1]]) * LETTERS + letters[:, at[:, 2]]
    return code, weight / np.sqrt(self_kernel(letters))[:, None]


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - half, half)]


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.0
    second: Second | None = None
    margins: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"margins": {}}

    def margins_of(self, words: list[str]) -> np.ndarray:
        """The margin of each word, the lowest for those of fewer letters than a subsequence."""
        letters = [w if w.isalpha() else clean(w) for w in words]
        sizes = np.fromiter(map(len, letters), np.int64, len(letters))
        out = np.full(len(words), LOWEST)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            if n > LONGEST:
                out[at] = [max(self.margins_of(windows(letters[i]))) for i in at]
            elif n >= ORDER:
                step = max(1, 2_000_000 // len(_triples(int(n))[0]))
                for k in range(0, len(at), step):
                    code, value = subsequences([letters[i] for i in at[k : k + step]])
                    out[at[k : k + step]] = np.maximum((self.weights[code] * value).sum(axis=1) + self.bias, LOWEST)
                if self.second is not None and len(again := at[out[at] > LOOKED_AT]):
                    out[again] = np.clip(self.second.margins_of([letters[i] for i in again]), LOWEST, out[again])  # both have to agree
        return out

    def _fill(self, missing: set[str]) -> None:
        if len(self.margins) + len(missing) > KEPT:
            self.margins.clear()
        words = list(missing)
        self.margins.update(zip(words, self.margins_of(words).tolist(), strict=True))

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The largest margin among a text's words."""
        out = np.full(len(texts), LOWEST)
        for at in range(0, len(texts), 500):
            each = [words_of(t) for t in texts[at : at + 500]]
            missing = set().union(*each).difference(self.margins)
            if missing:
                self._fill(missing)
            for i, words in enumerate(each):
                if words:
                    try:
                        out[at + i] = max(map(self.margins.__getitem__, words))
                    except KeyError:  # the table was emptied for this slice
                        self._fill(words.difference(self.margins))
                        out[at + i] = max(map(self.margins.__getitem__, words))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.worst(texts) + self.shift, -40, 40)))


@dataclass
class Marks:
    """Landmarks as columns over the subsequences that occur in them; row 0 is for all others."""

    row: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Marks:
        found = [subsequences([w]) for w in words]
        codes = np.unique(np.concatenate([c[0] for c, _ in found]))
        row = np.zeros(LETTERS**ORDER, np.int32)
        row[codes] = np.arange(1, len(codes) + 1)
        columns = np.zeros((len(codes) + 1, len(words)))
        for k, (code, value) in enumerate(found):
            np.add.at(columns[:, k], row[code[0]], value[0])
        return cls(row, columns)

    def kernels(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark."""
        out = np.zeros((len(words), self.columns.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for at in by_length.values():
            for k in range(0, len(at), 100):
                part = at[k : k + 100]
                code, value = subsequences([words[i] for i in part])
                out[part] = np.einsum("ij,ijk->ik", value, self.columns[self.row[code]])
        return out


def _whitened(gram: np.ndarray) -> np.ndarray:
    """The Nyström map from kernels with landmarks to coordinates."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class Second:
    """The machine of the powered kernel: only words nearly alike count, so a stem can be told from its endings."""

    marks: Marks
    weights: np.ndarray
    bias: float

    def margins_of(self, words: list[str]) -> np.ndarray:
        return self.marks.kernels(words) ** POWER @ self.weights + self.bias


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine by averaged subgradients of the weighted hinge loss."""
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    velocity = np.ones(x.shape[1] + 1) * 1e-8
    weight = weight / weight.sum()
    for t in range(steps):
        short = (y * (x @ w + b) < 1) * weight * y
        g = np.append(l2 * w - short @ x, -short.sum())
        velocity += g * g
        step = 0.5 * g / np.sqrt(velocity)
        w, b = w - step[:-1], b - step[-1]
        if t >= steps // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    half = steps - steps // 2
    return mean_w / half, mean_b / half


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve with Platt's targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((target - q) * margin).sum() - 1e-3 * a, (target - q).sum() - 1e-3 * b])
        v = q * (1 - q)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def cover(words: list[str], holds: dict[str, list[int]]) -> list[str]:
    """Words, greedily the one first that holds most texts not yet held: what near copies share is not taken again and again."""
    picked: list[str] = []
    held: set[int] = set()
    heap = [(-len(holds[w]), -len(holds[w]), w) for w in words]
    heapify(heap)
    while heap:
        stale, full, w = heappop(heap)
        fresh = len(set(holds[w]) - held)
        if fresh < -stale:
            if fresh > 1:
                heappush(heap, (-fresh, full, w))
            continue
        picked.append(w)
        held.update(holds[w])
    return picked


def fit(documents: list[tuple[int, list[str]]]) -> Model:
    """``documents``: a label, 0 or 1, and the words as written."""
    n, toxic = len(documents), sum(y for y, _ in documents)
    if not n or toxic in (0, n):
        return Model(None, prior=toxic / n if n else 0.0)
    learn = [d for i, d in enumerate(documents) if i % 4]
    tune = [d for i, d in enumerate(documents) if i % 4 == 0]
    if len({y for y, _ in learn}) < 2 or len({y for y, _ in tune}) < 2:
        learn = tune = documents
    seen = (Counter(), Counter())
    for y, words in learn:
        seen[y].update({p for w in words for p in windows(clean(w)) if len(p) >= ORDER})
    # words of toxic texts only, in more of them than chance explains; copies share many words, an insult stands alone
    holds: dict[str, list[int]] = {}
    for i, (y, words) in enumerate(learn):
        if y:
            for p in {p for w in words for p in windows(clean(w)) if len(p) >= ORDER}:
                if not seen[0][p]:
                    holds.setdefault(p, []).append(i)
    company = Counter(map(tuple, holds.values()))
    bad = [w for w in sorted(holds, key=lambda w: (-len(holds[w]), w)) if len(holds[w]) > 1 and company[tuple(holds[w])] <= 2]
    share = sum(y for y, _ in learn) / len(learn)
    spread = Counter((seen[0] + seen[1]).values())
    at_least = {c: sum(n for k, n in spread.items() if k >= c) for c in {len(holds[w]) for w in bad}}
    strong = [w for w in bad if len(holds[w]) * -np.log(share) > np.log(at_least[len(holds[w])]) + 1]
    strong = cover(strong, holds) if len(strong) > LIST else strong or bad[:TRUSTED] or sorted(holds)[:ANY]  # too few texts to tell
    if not strong:
        return Model(None, prior=toxic / n)
    rng = np.random.default_rng(7)
    # every word that speaks for nothing counts against: those of other texts, and the common ones of toxic texts
    plain = sorted(seen[0])
    against = [plain[i] for i in rng.permutation(len(plain))[:COUNTER]]
    draw = lambda words, n: [words[i] for i in rng.permutation(len(words))[:n]]
    marks_bad = strong[: LANDMARKS // 2]
    marks = Marks.of(marks_bad + draw(plain, LANDMARKS - len(marks_bad)))
    whiten = _whitened(marks.columns.T @ marks.columns)

    def trained(x: np.ndarray, positives: list[str], negatives: list[str]) -> tuple[np.ndarray, float]:
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        support = np.sqrt([len(holds[w]) for w in positives])
        return _machine(x, y, np.r_[support / support.sum(), np.full(len(negatives), 1 / max(len(negatives), 1))])

    def machine(positives: list[str], negatives: list[str]) -> Model:
        w, b = trained(marks.kernels(positives + negatives) @ whiten, positives, negatives)
        weights = np.zeros(LETTERS**ORDER)
        weights[marks.row > 0] = (marks.columns @ (whiten @ w))[marks.row[marks.row > 0]]
        return Model(weights, b)

    model = machine(strong, against)
    for _ in range(2):
        # the hardest counter-examples, and the words of toxic texts that the machine itself takes for insults
        hard = [plain[i] for i in np.argsort(-model.margins_of(plain))[:HARDEST]]
        alike = [w for w, m in zip(bad, model.margins_of(bad), strict=True) if m > 0]
        against = sorted({*against, *hard})
        model = machine(sorted({*strong, *alike}), against)
    # the second machine: the words that the first one takes for insults, rightly and wrongly
    near = [w for w, m in zip(against, model.margins_of(against), strict=True) if m > LOOKED_AT]
    positives = sorted({*strong, *alike})
    first = model.margins_of(plain)
    doubtful = [w for w, m in zip(plain, first, strict=True) if m > LOOKED_AT]
    for _ in range(ROUNDS if near else 0):
        own = Marks.of(draw(positives, LANDMARKS) + draw(near, LANDMARKS))
        map_ = _whitened((own.columns.T @ own.columns) ** POWER)
        w, b = trained(own.kernels(positives + near) ** POWER @ map_, positives, near)
        model.second = Second(own, map_ @ w, b)
        # the words that it still takes for insults
        wrong = model.second.margins_of(doubtful)
        more = {doubtful[i] for i in np.argsort(-wrong)[:HARDEST] if wrong[i] > LOOKED_AT} - {*near}
        if not more:
            break
        near = sorted({*near, *more})
    model.prior = toxic / n
    worst = model.worst([" ".join(words) for _, words in tune])
    model.scale, model.shift = _curve(worst, np.array([y for y, _ in tune]))
    model.margins = {}
    return model


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` documents of each class that ``labels`` covers."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(words_of(t)) for t in b.column(1).to_pylist()]
            b = b.filter(pa.array([len(w) <= FIT_WORDS for w in found], pa.bool_()))
            found = [w for w in found if len(w) <= FIT_WORDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "words"])

    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter(F.col("__id").isNotNull())
    order = F.xxhash64("__id"), "__id"
    chosen = marked.filter("__label = 1").orderBy(*order).limit(sample).union(marked.filter("__label = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(chosen), "__id").select("__label", "__text")  # at most 2 * `sample` small rows
    got = rows.mapInArrow(words, "label int, words array<string>").collect()
    return fit([(r["label"], r["words"]) for r in sorted(got, key=lambda r: (hash_of(r["words"]), r["label"]))])


def hash_of(words: list[str]) -> int:
    from zlib import crc32

    return crc32(" ".join(words).encode("utf-8", "surrogatepass"))


def score(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(texts.to_pylist()))

    return of(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every document's score; the fold 0 of 5 is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on(docs, learning_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), 5, 0))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
