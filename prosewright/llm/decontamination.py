"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared in lower case with runs of white space as one space. A
benchmark item of ``m`` characters is found in a document if some region of it
is at most ``e = rate * m`` edits away from the whole item. By the q-gram lemma
such a region shares at least ``m - q + 1 - q * e`` q-grams with the item, and
their diagonals (place in the document less place in the item) lie within a
band of ``e + 1``. So shared q-grams are counted in diagonal bands of width
``w > e`` that overlap by ``e``; bands that reach the bound are verified by a
banded alignment, whose free ends lie in the document.

Places of an item whose q-gram it repeats often are left out of its index, and
the bound is lowered by as many: ``e`` edits still spoil ``q * e`` of the places
kept at most, so nothing is lost. An item that is made of repetition keeps what
the bound needs; for such an item an exact find comes first. Shared q-grams are
counted ``POSTINGS`` at a time, and a document longer than ``SLICE`` is read in
windows that overlap by more than the longest match, so memory is bounded
whatever a text repeats and however long it is.

Items are read in blocks of at most ``BLOCK_CHARS`` characters, each against
all documents, so what is shipped to the workers is bounded, however large the
benchmark. Documents are worked on where they are read: nothing is shuffled.

Defined results: null and empty texts and items match nothing; items of fewer
than ``min_chars`` characters are too short to tell a leak from chance and are
not searched for; an item without an id is searched for and reported without
one; repeated documents and items are reported as often as they
occur; each document and item make one row at most, that of the fewest edits,
and the leftmost of these; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q = 10
RATE = 0.08
MIN_CHARS = 16
BLOCK_CHARS = 8_000_000
#: Characters of documents worked on at once.
SLICE = 2_000_000
#: Shared q-grams counted at once.
POSTINGS = 2_000_000
#: Places of an item with one q-gram, up to which all are in its index.
REPEATS = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_BREAK = 0x110000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all runs of Q = 8 + 2 characters, by doubling."""
    with np.errstate(over="ignore"):
        b1 = _BASE
        b2, b4 = b1 * b1, b1 * b1 * b1 * b1
        two = points[:-1] * b1 + points[1:]
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * b4 + four[4:]
        return (eight[:-2] * b2 + two[8:]) * np.uint64(0xD6E8FEB86659FD93)


def edit_budget(m: int, rate: float = RATE) -> int:
    """Edits allowed: the rate, but so that at least one q-gram must be shared."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits from the whole item to a part of ``text``, on diagonals ``low..high``; edits, start, end, or None above ``most``."""
    width, big = high - low + 1, 1 << 20
    lanes = np.arange(width)
    cost = np.where((lanes + low >= 0) & (lanes + low <= len(text)), 0, big)
    begin = lanes + low
    for i, c in enumerate(item):
        column = lanes + low + i  # the place in the text before this step, by lane
        inside = (column >= 0) & (column < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[column[inside]] == c
        step = np.where(inside, cost + ~same, big)
        skip = np.append(cost[1:] + 1, big)  # an item's character left out
        after = column + 1
        skip[(after < 0) | (after > len(text))] = big
        new, source = np.where(skip < step, skip, step), np.where(skip < step, np.append(begin[1:], 0), begin)
        # characters of the text put in: along the lanes
        slope = new - lanes
        best = np.minimum.accumulate(slope)
        first = np.maximum.accumulate(np.where(slope == best, lanes, 0))
        cost, begin = np.minimum(best + lanes, big), source[first]
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(begin[k]), k + low + len(item)) if cost[k] <= most else None


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_chars: int, alone: bool = False):
        """``alone``: the index of one item made of repetition, which an index of many leaves out."""
        kept = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if len(t) >= max(min_chars, Q)]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.points = [_points(t) for t in self.texts]
        self.budget = np.array([edit_budget(len(t), rate) for t in self.texts], np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.width = 1 << np.ceil(np.log2(np.maximum(self.budget + 1, 16))).astype(np.int64)
        self.needed = np.zeros(len(kept), np.int64)
        self.alone: dict[int, Items] = {}
        self.grams = np.zeros(0, np.uint64)
        if not kept:
            return
        parts = []
        for i, p in enumerate(self.points):
            own = gram_hashes(p)
            _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
            often, spoilt = count[inverse], Q * int(self.budget[i])
            most = max(REPEATS, int(np.sort(often)[spoilt]))  # one place more than edits can spoil
            places = np.flatnonzero(often <= most)
            self.needed[i] = len(places) - spoilt
            if most > REPEATS and not alone:
                self.alone[i] = Items([kept[i]], rate, min_chars, alone=True)
                places = places[:0]
            parts.append((own[places], places))
        grams = np.concatenate([g for g, _ in parts])
        item = np.repeat(np.arange(len(kept)), [len(g) for g, _ in parts])
        place = np.concatenate([places for _, places in parts])
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, number of the item, edits, start, end) of normal texts."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, index in self.alone.items():
            for d, text in enumerate(texts):
                k = text.find(self.texts[i])
                if k >= 0:
                    best[d, i] = 0, k, k + len(self.texts[i])
                elif text:
                    best.update({(d, i): (edits, start, end) for _, _, edits, start, end in index.search([text])})
        for d, i, *got in self._counted(texts):
            best[d, i] = tuple(got)
        return [(d, i, *got) for (d, i), got in sorted(best.items())]

    def _counted(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """The same without items made of repetition."""
        joined = _points("".join(t + " " for t in texts))
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        joined[starts + lengths] = _BREAK
        if len(joined) < Q or not len(self.grams):
            return []
        hashes = gram_hashes(joined)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        found = np.searchsorted(self.grams, hashes[at]).clip(max=len(self.grams) - 1)
        real = self.grams[found] == hashes[at]
        at, found = at[real], found[real]
        if not len(at):
            return []
        doc = np.searchsorted(starts, at, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        reach = int(self.size.max())
        bands = (int(lengths.max()) + reach) // 16 + 3
        keys = counts = np.zeros(0, np.int64)
        edges = np.cumsum(self.count[found])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + POSTINGS, side="right")))
            new = self._keys(at[begin:end] - starts[doc[begin:end]], doc[begin:end], found[begin:end], reach, bands)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(new), np.int64)]), len(keys)).astype(np.int64)
            begin = end
        item = keys // bands % len(self.ids)
        for k in keys[counts >= self.needed[item]]:
            d, i = divmod(int(k) // bands, len(self.ids))
            low = (int(k) % bands - 1) * int(self.width[i]) - reach
            got = self._verified(d, i, low, low + int(self.width[i] + self.budget[i]), joined[starts[d] : starts[d] + lengths[d]])
            if got and ((d, i) not in best or got < best[d, i]):
                best[d, i] = got
        return [(d, i, *got) for (d, i), got in sorted(best.items())]

    def search_long(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the item, edits, start, end) of one text, window by window."""
        overlap = int((self.size + 2 * self.budget).max(initial=0)) + Q
        best: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(len(text) - overlap, 1), SLICE):
            for _, i, edits, start, end in self.search([text[at : at + SLICE + overlap]]):
                best[i] = min(best.get(i, (edits, at + start, at + end)), (edits, at + start, at + end))
        return [(i, *got) for i, got in sorted(best.items())]

    def _keys(self, place: np.ndarray, doc: np.ndarray, found: np.ndarray, reach: int, bands: int) -> np.ndarray:
        """A number for text, item and band, one for each shared q-gram (two where bands overlap)."""
        n = self.count[found]
        posting = np.repeat(self.first[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, doc, item = np.repeat(place, n), np.repeat(doc, n), self.item[posting]
        diagonal = place - self.place[posting] + reach
        width = self.width[item]
        band, within = diagonal // width, diagonal % width < self.budget[item]
        own = (doc * len(self.ids) + item) * bands
        return np.concatenate([own + band + 1, (own + band)[within]])

    def _verified(self, d: int, i: int, low: int, high: int, text: np.ndarray) -> tuple[int, int, int] | None:
        e, m = int(self.budget[i]), int(self.size[i])
        start, end = max(0, low - e), min(len(text), high + m + e + 1)
        region, item = text[start:end], self.points[i]
        for k in range(max(0, low - start), min(high - start, len(region) - m) + 1) if len(region) >= m else ():
            if region[k] == item[0] and region[k + m - 1] == item[-1] and (region[k : k + m] == item).all():
                return 0, start + k, start + k + m
        got = banded(item, region, low - e - start, high + e - start, e)
        return got and (got[0], got[1] + start, got[2] + start)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``edits``, ``start``, ``end`` (in the normal text)."""
    schema = "doc_id long, item_id long, edits long, `start` long, `end` long"
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [plain.mapInArrow(_searcher(block, rate, min_chars), schema) for block in _blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items, read one partition at a time, in blocks of bounded size."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if not row[1]:
            continue
        if block and held + len(row[1]) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    if block:
        yield block


def _searcher(block: list[tuple[int | None, str]], rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, names = Items(block, rate, min_chars), ["doc_id", "item_id", "edits", "start", "end"]

        def rows_of(texts: list[str], own: list[int | None]) -> list[tuple]:
            return [(own[d], items.ids[i], *rest) for d, i, *rest in items.search(texts)]

        for batch in batches:
            ids, rows, texts, own, held = batch.column(0).to_pylist(), [], [], [], 0
            for k, t in enumerate(batch.column(1)):
                text = normal(t.as_py())
                if len(text) > SLICE:
                    rows += [(ids[k], items.ids[i], *rest) for i, *rest in items.search_long(text)]
                else:
                    texts.append(text)
                    own.append(ids[k])
                    held += len(text)
                if texts and (held >= SLICE or k == len(ids) - 1):
                    rows += rows_of(texts, own)
                    texts, own, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=names)

    return run


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found; rows without an id stay."""
    leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")
