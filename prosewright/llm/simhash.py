"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into pieces. Two fingerprints at most ``max_bits``
apart differ in at most ``tau = max_bits // pieces`` bits of some piece, so it
is enough to find, piece by piece, all values at most ``tau`` apart.

The anchors of a piece are a covering code: the perfect Hamming code of length
15 on its first 15 bits, times all values of its other bits. Its covering
radius is 1: every value has one home anchor at distance 0 or 1. If a value
``x`` has home ``a`` and ``y`` is at most ``tau`` from ``x``, then ``y`` is at
most ``1 + tau`` from ``a``. So each distinct fingerprint is put once under its
home and once under every anchor within ``1 + tau``; homes and replicas that
meet under an anchor are compared. Nothing is lost. Equal fingerprints are
merged first: a group of copies, however large, is one row. Two larger pieces
make many more anchors than three, and more replicas: ``pieces_for`` weighs
replicas against the compares to be expected among that many fingerprints, so
compares don't grow with their square until there are as many fingerprints as
anchors. Fingerprints that crowd under an anchor are an equi-join's frequent
key, which Spark splits.

The pipeline's stage (``keep_one_of_each``) is by similarity of the shingle
sets: at a Jaccard similarity of 0.8 about 0.15 of a fingerprint's bits differ,
which no radius reaches in pieces that many fingerprints can be told apart by.
So its fingerprints have 1,024 bits, votes of the distinct shingles, and each is
put under its home anchor in some hundreds of pieces drawn from them, without
replicas; the number of pieces gives a pair at 0.8 its chance to meet.
Fingerprints that meet are compared, and near ones verified by the exact
similarity of their sets.

Defined results: a null or wordless text has fingerprint 0 and links like any
other; a null id is kept as a row of its own group by fingerprint (its
component is the smallest id of that component, null if there is none);
repeated rows are repeated in the result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosewright.llm._common import Scratch, components

HAMMING = 15
CHUNK = 1 << 14
#: Bits of a set's fingerprint; of a piece's bits besides the code's at most.
BITS, MOST_FREE = 1024, 17
#: Bits compared before the sets are, and of those that may differ, first and last: a pair at 0.8 differs in 0.152 of them
#: (19 of 128 on average with a deviation of 4, 156 of 1,024 with one of 12), a pair without common shingles in half.
CHECKED, MOST_APART, MOST_APART_OF_ALL = 128, 42, 230
#: Ids of candidates, 8 bytes each, that are sent to all executors at most.
MOST_SENT = 2_000_000
SLACK = 1e-6
_SALTS, _ODD = np.random.default_rng(42).integers(0, 2**64, (2, BITS // 64), np.uint64)
_ODD |= np.uint64(1)


def fingerprint(text: str | bytes | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text, as an unsigned number.

    A-Z are lower-cased; words are runs of other bytes than space and
    0x09-0x0D; shingles of ``words`` words, repeats included, are joined by
    spaces and hashed by XXH64. A bit is 1 if more than half the hashes set it.
    """
    import xxhash

    if not text:
        return 0
    data = text if isinstance(text, bytes) else text.encode()
    split = data.lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    n = len(split)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, split), np.int64, n)
    starts = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[words - 1 :].tolist()
    starts = starts[: n - words + 1].tolist()
    digest, total = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # uint8 sums of 255 rows at a time stay within a byte and are several times faster than wide sums
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per document: ``doc_id`` and ``fp``, the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = np.fromiter((fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
            yield pa.array(got.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def widths(pieces: int) -> list[int]:
    return [64 // pieces + (k < 64 % pieces) for k in range(pieces)]


def syndrome_of(mask: int) -> int:
    """Of the Hamming code: the XOR of the positions 1..15 whose bits are set."""
    s = 0
    for i in range(HAMMING):
        if mask >> i & 1:
            s ^= i + 1
    return s


#: Of each word of 15 bits: its word of the code.
_HOMES = np.array([v ^ (1 << (x - 1) if (x := syndrome_of(v)) else 0) for v in range(1 << HAMMING)])


def flips(width: int, radius: int) -> list[list[int]]:
    """For each syndrome, the bits to flip to reach every anchor within ``radius``."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for n in range(radius + 1):
        for at in combinations(range(width), n):
            mask = sum(1 << i for i in at)
            out[syndrome_of(mask)].append(mask)
    return out


def _anchor_columns(fp: Column, width: int, shift: int, tau: int) -> tuple[Column, Column]:
    """The home anchor and the array of anchors within ``1 + tau`` of one piece."""
    x = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
    parity = [sum(1 << i for i in range(HAMMING) if (i + 1) >> k & 1) for k in range(4)]
    syndrome = sum((F.bit_count(x.bitwiseAND(F.lit(p))).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, p in enumerate(parity)), F.lit(0))
    longs = lambda values: F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")
    to_home = longs([0] + [1 << (s - 1) for s in range(1, HAMMING + 1)])
    near = F.array(*[longs(m) for m in flips(width, 1 + tau)])
    home = x.bitwiseXOR(F.element_at(to_home, syndrome + 1))
    return home, F.transform(F.element_at(near, syndrome + 1), lambda m: x.bitwiseXOR(m))


def _each_or(values: Column, bits: Column) -> Column:
    return F.transform(values, lambda x: x.bitwiseOR(bits))


def pieces_for(n: int, max_bits: int = 4, choices: tuple[int, ...] = (3, 2)) -> int:
    """The number of pieces with the least work for ``n`` evenly spread fingerprints: replicas to move, and compares."""

    def work(pieces: int) -> float:
        radius, total = 1 + max_bits // pieces, 0.0
        for w in widths(pieces):
            replicas = sum(comb(w, r) for r in range(radius + 1)) / (HAMMING + 1)
            total += 20 * n * replicas + n * n * replicas / 2 ** (w - 4)
        return total

    return min(choices, key=work)


def near_pairs(fps: DataFrame, max_bits: int = 4, pieces: int = 3) -> DataFrame:
    """All pairs ``a < b`` of the distinct longs in column ``fp`` at most ``max_bits`` apart (a pair can repeat)."""
    if any(w < HAMMING for w in widths(pieces)):
        raise ValueError("a piece needs at least 15 bits")
    tau, homes, replicas, shift = max_bits // pieces, [], [], 0
    for k, width in enumerate(widths(pieces)):
        home, near = _anchor_columns(F.col("fp"), width, shift, tau)
        piece = F.lit(k << 32)
        homes.append(home.bitwiseOR(piece))
        replicas.append(_each_or(near, piece))
        shift += width
    left = fps.select(F.col("fp").alias("a"), F.explode(F.array(*homes)).alias("anchor"))
    right = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*replicas)).alias("anchor"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # Spark takes the exploded side for as small as the file below it, and would send all replicas by way of the driver
    return left.hint("merge").join(right, (left["anchor"] == right["anchor"]) & close).select("a", "b")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    pieces: int | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long) and ``component_id``,
    the smallest id reachable over links of at most ``max_bits`` differing bits.
    ``pieces`` changes the work, not the result; it follows the number of distinct fingerprints if it is not given."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.cut(fingerprints(docs, id_col, text_col, words))
    distinct = scratch.cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(scratch, near_pairs(distinct.select("fp"), max_bits, pieces or pieces_for(distinct.count(), max_bits)))
    parts = scratch.cut(distinct.join(linked.withColumnRenamed("id", "fp"), "fp", "left"))
    root = F.coalesce("component", "fp").alias("root")
    least = scratch.cut(parts.filter("component is not null").groupBy("component").agg(F.min("first_id").alias("least_id")))
    named = scratch.cut(
        parts.join(least, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"), root)
    )
    scratch.only(own, named)
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: four-word shingles, links at four or fewer bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str | bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of a text's distinct shingles, cut as for ``fingerprint``; a text of fewer words is one shingle."""
    import xxhash

    split = (text if isinstance(text, bytes) else (text or "").encode()).lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(split) - words + 1)
    joined, at = b" ".join(split), [0]
    for w in split:
        at.append(at[-1] + len(w) + 1)
    return np.unique(np.fromiter((digest(joined[at[i] : at[min(i + words, len(split))] - 1], seed) for i in range(n)), np.uint64, n))


def set_print(shingles: np.ndarray) -> np.ndarray:
    """The ``BITS`` bits of a set's fingerprint, as bytes: votes of its hashes, mixed anew for each 64 bits, and one vote
    that all sets have (without it ties make sets of four or five shingles differ in more bits); none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint8)
    ones = np.unpackbits(_SALTS.view(np.uint8), bitorder="little").astype(np.int64)
    for k in range(0, len(shingles), 255):
        mixed = (shingles[k : k + 255, None] ^ _SALTS) * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= _ODD
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)  # of 255 rows at most
    return np.packbits(ones * 2 > len(shingles) + 1, bitorder="little")


def free_bits(n: int) -> int:
    """Bits of a piece besides those of the code, for ``n`` sets: four anchors or more for each set, up to 2**26 sets."""
    return min(max(n.bit_length() - 9, 4), MOST_FREE)


def pieces_at(free: int) -> int:
    """Pieces for which a pair with 0.175 of its bits differing shares no home in one of 1,000 cases.

    At a similarity of 0.8 that is the mean of 0.152 and two deviations. The home
    of 15 bits is then the same with a chance of 0.111, each free bit with 0.825."""
    return int(np.ceil(np.log(1e3) / (0.111 * 0.825**free)))


_PLACES = np.random.default_rng(43).permuted(np.tile(np.arange(BITS, dtype=np.int16), (pieces_at(MOST_FREE), 1)), axis=1)[:, : HAMMING + MOST_FREE].copy()


def anchors(prints: np.ndarray, free: int) -> np.ndarray:
    """The home anchor of each piece (rows) of each fingerprint (columns), with the piece's number above it.

    A piece is 15 bits, whose home is their word of the Hamming code, and ``free`` bits that are anchors themselves."""
    bits = np.unpackbits(prints, axis=1, bitorder="little").T
    packed = np.packbits(bits[_PLACES[: pieces_at(free), : HAMMING + free]], axis=1, bitorder="little").astype(np.int64)
    value = sum(packed[:, k] << 8 * k for k in range(packed.shape[1]))
    home = _HOMES[value & (1 << HAMMING) - 1] | value >> HAMMING << HAMMING
    return home | np.arange(len(home))[:, None] << 40


def band_keys(shingles: np.ndarray, free: int = 9) -> np.ndarray:
    """The home anchors of a set's fingerprint, one for each piece; none for an empty set."""
    return anchors(set_print(shingles)[None, :], free)[:, 0].view(np.uint64) if len(shingles) else np.zeros(0, np.uint64)


def anchor_rows(keyed: DataFrame, free: int) -> DataFrame:
    """``key`` and ``id``: each set of ``keyed`` (id, print) under its home anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                prints = [x for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if x[1]]
                if prints:
                    keys = anchors(np.frombuffer(b"".join(x for _, x in prints), np.uint8).reshape(len(prints), -1), free)
                    ids = np.tile(np.array([i for i, _ in prints], np.int64), len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return keyed.select("id", "print").mapInArrow(rows, "key long, id long")


def shingle_rows(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``same`` (equal for equal sets), ``print`` (its set's fingerprint) and ``shingles``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(t, words) for t in part.column(1).cast(pa.binary()).to_pylist()]
                same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                prints = pa.array([set_print(s).tobytes() for s in sets], pa.binary())
                longs = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), same, prints, longs], ["doc_id", "same", "print", "shingles"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(rows, "doc_id long, same binary, print binary, shingles array<long>")


def _apart(one: str, two: str, bits: int = CHECKED) -> Column:
    """Differing bits of two fingerprints, of the first ``bits``."""
    return sum((F.bit_count(F.col(f"{one}{k}").bitwiseXOR(F.col(f"{two}{k}"))) for k in range(bits // 64)), F.lit(0))


def _sizes_allow(one: Column, two: Column, similarity: float) -> Column:
    """Whether sets of those sizes can have that similarity."""
    return F.least(one, two) >= similarity * F.greatest(one, two) - SLACK


def _alike(x: str, y: str, similarity: float) -> Column:
    """Whether two arrays of distinct values have that Jaccard similarity, exactly."""
    one, two = F.size(x), F.size(y)
    # common / (one + two - common) >= similarity, with common counted once
    return _sizes_allow(one, two, similarity) & (F.size(F.array_intersect(x, y)) * (1 + similarity) >= similarity * (one + two) - SLACK)


def similar_sets(scratch: Scratch, keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``id`` and ``component`` of the sets in written ``keyed`` (id, print, size) linked at that similarity; ``sets`` (id, shingles) is written too.

    The sets of ``keyed`` differ, and a set of ``n`` shingles has at most a
    similarity of n / (n + 1) with another: those too small for a link stay out.
    Others meet under the home anchors of their fingerprints. Under each anchor
    the smallest id is compared with all others. Then, under anchors whose
    others are not all linked by that, each set outside the component that most
    belong to is compared with all sets of other components: a group of near
    copies makes rows in proportion to its size, and no pair that meets and
    could join two components goes unlooked at. A comparison is of the sizes
    and the fingerprints (``CHECKED`` bits first where many meet), then exactly of the sets.
    """
    again, c, whole = scratch.again, F.col, range(BITS // 64)
    word = lambda k: F.conv(F.hex(F.substring("print", 1 + 8 * k, 8)), 16, -10).cast("long")
    linkable = _sizes_allow(c("size"), c("size") + 1, similarity)
    prints = scratch.cut(again(keyed).filter(linkable).select("id", "size", *[word(k).alias(f"w{k}") for k in whole]))
    side = lambda x, bits: [c("size").alias(f"{x}_size"), *[c(f"w{k}").alias(f"{x}{k}") for k in range(bits // 64)]]

    def near(bits: int, most: int) -> Column:
        return _sizes_allow(c("a_size"), c("b_size"), similarity) & (_apart("a", "b", bits) <= most)

    def nearest(pairs: DataFrame) -> DataFrame:
        """The distinct pairs ``a``, ``b`` whose fingerprints are near, in ``CHECKED`` bits and then in all."""
        for bits, most in ((CHECKED, MOST_APART), (BITS, MOST_APART_OF_ALL)):
            for x in "ab":
                pairs = pairs.join(again(prints).select(c("id").alias(x), *side(x, bits)), x)
            pairs = pairs.filter(near(bits, most)).select("a", "b").distinct()
        return scratch.cut(pairs)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of written ``pairs`` whose sets are alike."""
        wanted = scratch.cut(again(pairs).select(F.explode(F.array("a", "b")).alias("id")).distinct())
        wanted = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
        some = scratch.cut(again(sets).select("id", "shingles").join(wanted, "id", "left_semi"))
        one, two = again(some).select(c("id").alias("a"), c("shingles").alias("x")), again(some).select(c("id").alias("b"), c("shingles").alias("y"))
        return scratch.cut(again(pairs).join(two, "b").join(one, "a").filter(_alike("x", "y", similarity)).select("a", "b"))

    met = anchor_rows(again(keyed).filter(linkable), free_bits(prints.count()))
    others = scratch.cut(met.withColumn("low", F.min("id").over(Window.partitionBy("key"))).filter("id != low"))
    links = verified(nearest(again(others).select(c("low").alias("a"), c("id").alias("b"))))
    linked = scratch.cut(components(scratch, again(links)))

    rest = scratch.cut(again(others).select("key", "id").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")))
    per = scratch.cut(again(rest).groupBy("key", "component").agg(F.count("*").alias("m")))
    mixed = scratch.cut(per.groupBy("key").agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main"))
    rest = scratch.cut(rest.join(mixed, "key").join(again(prints), "id"))
    out = again(rest).filter("component != main").select("key", c("id").alias("a"), c("component").alias("c"), *side("a", BITS))
    all_ = again(rest).select("key", c("id").alias("b"), c("component").alias("d"), "main", *side("b", BITS))
    other = (c("c") != c("d")) & ((c("a") < c("b")) | (c("d") == c("main"))) & near(BITS, MOST_APART_OF_ALL)
    more = verified(scratch.cut(out.join(all_, (out["key"] == all_["key"]) & other).select("a", "b").distinct()))
    return components(scratch, again(links).union(again(more)))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without an id stay.

    A group is linked by pairs of documents whose sets of ``words``-word
    shingles have a Jaccard similarity of ``similarity`` or more."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.cut(shingle_rows(docs, words).withColumn("id", F.monotonically_increasing_id()))
    distinct = scratch.cut(own.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.min("id").alias("id")))
    chosen = scratch.again(own).select("id", "print", F.size("shingles").alias("size")).join(distinct.select("id"), "id", "left_semi")
    sets = scratch.cut(chosen)
    linked = similar_sets(scratch, sets, own, similarity)
    parts = scratch.cut(scratch.again(distinct).join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")))
    least = scratch.cut(scratch.again(parts).groupBy("component").agg(F.min("first_id").alias("least_id")))
    named = parts.join(least, "component").select("same", "least_id")
    ids = scratch.cut(scratch.again(own).select("doc_id", "same").join(named, "same").filter(F.col("doc_id") != F.col("least_id")).select("doc_id").distinct())
    scratch.only(ids)
    return docs.join(ids, "doc_id", "left_anti")
