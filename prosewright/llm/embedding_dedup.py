"""Embedding near-duplicates with an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves, each with a codebook of
its own; the pairs of codewords form a grid of cells. Every vector is filed in
the cell of its nearest codewords. As a query it visits cells in the order of
the sum of its distances to their two codewords (the multi-sequence order), as
many as the target recall asks for: on a bounded sample, vectors are turned by
exactly the threshold's angle in random directions, and the number of cells is
the quantile, at the target recall, of the place their partner's cell takes.
Every vector filed in a visited cell is verified by its cosine in double
precision.

The codebooks and that number are fitted on at most ``SAMPLE`` vectors and
``SAMPLE_BYTES`` bytes of them; all vectors are filed and all are queries.
Vectors of each length have an index of their own. The codebooks grow with the
square root of the number of vectors, so cells stay small, up to one codeword
for ``PER_WORD`` vectors of the sample (a grid of a million cells at the full
sample); a larger sample raises that. Equal vectors are merged first
and counted. Work is dealt out by label, a run of ``SPAN`` neighbouring cells and a chunk of each
side, so a hot label or cell is many tasks; each yields counts and the edges of
a spanning forest, never its pairs. A query goes to a run once, however many of its cells it visits.

A pair is a link if either side visits the other: each filed vector carries
the cells it visits itself, so a side that was found without visiting counts
the link too, once.

Defined results: a null label, a null or empty vector, one with null or
non-finite parts or of length zero links with nothing and is kept; vectors of
different lengths never link; repeated rows are vectors of their own with
equal ids; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm._common import Scratch, components

SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
PER_WORD = 20
PROBED = 2_000
#: Vectors of one side that a task compares at once.
CHUNK = 2_000
#: Vectors aimed at in a cell.
FILED = 50
#: Cells worked on together: small groups cost more to hand over than to compare.
SPAN = 20


@dataclass
class Index:
    words: tuple[np.ndarray, np.ndarray]
    visits: int
    recall: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = len(self.words[0][0])
        out = []
        for part, words in zip((x[:, :half], x[:, half:]), self.words, strict=True):
            out.append((part**2).sum(1)[:, None] - 2 * part @ words.T + (words**2).sum(1))
        return out[0], out[1]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector: its own cell, and the cells it visits, its own first.

        The cell of the i-th and j-th nearest codewords comes after at least
        ``i * j - 1`` others, so pairs of ranks with a larger product than
        ``visits`` are not looked at."""
        a, b = self.distances(x)
        n, k = a.shape
        v = min(self.visits, k * k)
        near_a, near_b = (np.argsort(d, axis=1, kind="stable")[:, :v] for d in (a, b))
        i, j = np.nonzero(np.multiply.outer(np.arange(1, near_a.shape[1] + 1), np.arange(1, near_b.shape[1] + 1)) <= v)
        at_a, at_b = near_a[:, i], near_b[:, j]
        rows = np.arange(n)[:, None]
        order = np.argsort(a[rows, at_a] + b[rows, at_b], axis=1, kind="stable")[:, :v]
        cells = (at_a * k + at_b)[rows, order].astype(np.int32)
        return cells[:, 0], cells


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((words**2).sum(1) - 2 * x @ words.T).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, own, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return words


def fit(sample: np.ndarray, n_vectors: int, threshold: float, target: float) -> Index:
    """Codebooks and the number of visits, from unit vectors."""
    rng = np.random.default_rng(11)
    half = sample.shape[1] // 2
    k = int(np.clip(2 ** round(np.log2(max(1, n_vectors / FILED)) / 2), 2, max(2, len(sample) // PER_WORD)))
    index = Index((_means(sample[:, :half], k, rng), _means(sample[:, half:], k, rng)), k * k, 1.0)
    x = sample[rng.permutation(len(sample))[:PROBED]]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * noise
    a, b = index.distances(x)
    ya, yb = index.distances(y)
    rows = np.arange(len(x))
    own = a[rows, ya.argmin(1)] + b[rows, yb.argmin(1)]
    place = np.empty(len(x), np.int64)
    for start in range(0, len(x), 50):
        part = slice(start, start + 50)
        b_sorted = np.sort(b[part], axis=1)
        left = own[part, None] - a[part]  # cells of a codeword that come before: a place in the other half's order
        place[part] = [int(np.searchsorted(row, values, side="left").sum()) for row, values in zip(b_sorted, left, strict=True)]
    place = np.sort(place) + 1
    at = min(int(np.ceil(target * len(place))), len(place)) - 1
    index.visits, index.recall = int(place[at]), target
    return index


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs, as star edges to each part's smallest id."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(u), root(v)
        if r != s:
            parent[max(r, s)] = min(r, s)
    return [(v, root(v)) for v in list(parent) if root(v) != v]


def links(
    vectors: DataFrame,
    threshold: float = 0.98,
    target: float = 0.999,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = (
        F.col("label").isNotNull()
        & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    good = rows.filter(sound)
    # equal vectors of a label are one row; its least id stands for it
    merged = scratch.cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("v")))
    links_schema = "id long, other long, n long"
    found = [spark.createDataFrame([], links_schema)]
    for dim, size in sorted(map(tuple, merged.groupBy("dim").count().collect())):
        own = merged.filter(F.col("dim") == dim)
        index = _fitted(own, int(dim), int(size), threshold, target)
        found.append(scratch.cut(_verified(scratch, own, index, threshold, links_schema)))
    found = scratch.cut(reduce(DataFrame.union, found))
    counts = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(scratch, found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = scratch.cut(
        merged.select("label", "v", "id", F.col("n").alias("copies"))
        .join(counts, "id", "left")
        .join(parts.distinct(), "id", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    scratch.only(named)
    linked = good.join(named, ["label", "v"])
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", F.col("n_links").cast("long"), "component_id").union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _fitted(vectors: DataFrame, dim: int, size: int, threshold: float, target: float) -> Index:
    """An index of ``size`` vectors of length ``dim``, from a sample of bounded size that comes in columns."""
    if dim == 1:
        return Index((np.zeros((2, 0)), np.array([[-1.0], [1.0]])), 4, 1.0)
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    rows = vectors.orderBy(F.xxhash64("id", "label"), "id").limit(most).select("v").toArrow()
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column(0).chunks]).reshape(-1, dim)
    return fit(x / np.linalg.norm(x, axis=1)[:, None], size, threshold, target)


def _verified(scratch: Scratch, merged: DataFrame, index: Index, threshold: float, schema: str) -> DataFrame:
    """Counts (``other`` null) and forest edges of all links between distinct vectors of one length."""

    def placed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist())
            unit = x / np.linalg.norm(x, axis=1)[:, None]
            parts = [index.place(unit[at : at + 500]) for at in range(0, len(x), 500)]
            cell, visits = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pdf.assign(cell=cell, visits=list(visits))

    filed = merged.select(F.col("label").cast("string").alias("label"), "v", "id", "n").mapInPandas(
        placed, "label string, v array<double>, id long, n long, cell int, visits array<int>"
    )
    filed = scratch.cut(filed)
    again = scratch.again
    # queries go to every run of cells they visit
    own, runs = F.floor(F.col("cell") / SPAN).alias("run"), F.explode(F.array_distinct(F.transform("visits", lambda c: F.floor(c / SPAN)))).alias("run")
    size = again(filed).groupBy("label", own).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    asks = again(filed).select("label", runs).groupBy("label", "run").agg(F.ceil(F.count("*") / (4 * CHUNK)).cast("int").alias("ask_chunks"))
    plan = scratch.cut(size.join(asks, ["label", "run"]))
    coin = F.xxhash64("id", F.lit(5).cast("long"))
    left = filed.select("label", "v", "id", "n", "cell", "visits", runs).join(plan, ["label", "run"]).select(
        "label", "run", F.pmod(coin, "ask_chunks").alias("q"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("s"), "v", "id", "n", "cell", "visits"
    )
    right = again(filed).withColumn("run", own).join(again(plan), ["label", "run"]).select(
        "label", "run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("ask_chunks") - 1).cast("long"))).alias("q"), F.pmod(coin, "chunks").cast("int").alias("s"), "v", "id", "n", "cell", "visits"
    )

    def holds(visits: np.ndarray, at: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector visits a cell, a bounded number of pairs at a time."""
        step = 100_000
        return np.concatenate([(visits[at[k : k + step]] == cells[k : k + step, None]).any(1) for k in range(0, max(len(at), 1), step)])

    def compare(asked_: pd.DataFrame, filed_: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        if not len(asked_) or not len(filed_):
            return none
        y = np.array(filed_["v"].tolist())
        y_norm = np.linalg.norm(y, axis=1)
        y_unit = y / y_norm[:, None]
        y_id, y_n, y_cell = filed_["id"].to_numpy(), filed_["n"].to_numpy(), filed_["cell"].to_numpy()
        y_visits = np.array(filed_["visits"].tolist()).reshape(len(y), -1)
        pairs = []
        for at in range(0, len(asked_), 500):
            part = asked_.iloc[at : at + 500]
            x = np.array(part["v"].tolist())
            x_norm = np.linalg.norm(x, axis=1)
            cosine = (x / x_norm[:, None]) @ y_unit.T
            i, j = np.nonzero(cosine >= threshold - 1e-9)
            exact = np.einsum("ij,ij->i", x[i], y[j]) / (x_norm[i] * y_norm[j]) >= threshold
            x_id = part["id"].to_numpy()
            mine = exact & (x_id[i] != y_id[j])
            i, j = i[mine], j[mine]
            mine = holds(np.array(part["visits"].tolist()), i, y_cell[j])
            i, j = i[mine], j[mine]
            back = holds(y_visits, j, part["cell"].to_numpy()[i])
            pairs.append((x_id[i], part["n"].to_numpy()[i], y_id[j], y_n[j], back))
        a, a_n, b, b_n, back = (np.concatenate(p) for p in zip(*pairs, strict=True))
        if not len(a):
            return none
        ids = np.concatenate([a, b[~back]])
        counts = pd.Series(np.concatenate([b_n, a_n[~back]])).groupby(ids).sum()
        forest = _forest(a, b)
        return pd.concat(
            [
                pd.DataFrame({"id": counts.index.to_numpy(), "other": pd.array([pd.NA] * len(counts), "Int64"), "n": counts.to_numpy()}),
                pd.DataFrame({"id": [e[0] for e in forest], "other": pd.array([e[1] for e in forest], "Int64"), "n": 0}),
            ]
        )

    key = ["label", "run", "q", "s"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, schema)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: links at a cosine of 0.98 among vectors of one label."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
