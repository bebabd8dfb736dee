r"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines are compared in lower case and without white space at their ends. Equal
lines are merged first, whatever their length; lines without a sign in them are
no lines. Lines of at least ``EDIT_CHARS`` characters are also linked if they
are at most ``tau`` edits apart: in shorter ones two edits make another line
("chapter 12", "chapter 14").

Two lines at most ``tau`` edits apart: cut the shorter one into ``tau + 1``
segments of even length, and some segment is left whole, so it occurs in the
longer line, near its own place. Every distinct line files its segments under
(length, number, hash) and looks up, for each length from its own down to
``tau`` less, the substrings that can match: the multi-match-aware window
leaves 12 of them for two edits, of which three are its own. The index holds
one row per key, with its smallest and largest line and their number. Under a
crowded key lines don't meet in pairs: all lines that ask for one are cut into
``FINER`` segments, filed under the rarest ``tau + 1`` of these, and meet only
if the parities of their letter counts allow ``tau`` edits; no link is lost.

Lines that meet are verified by a banded bit-parallel automaton (``within``):
one long holds, for each number of edits, the diagonals of the band that are
reached, and a character is a few shifts and masks on it.

Lines linked directly or through others form a class; of all occurrences of a
class the first, by document id and line number, stays.

No group is gathered anywhere: merging is a partial aggregate, the index is
another, the look-up is an equi-join against one row per key, and only
(document, line number) pairs of repeated lines return to the documents.

Defined results: a null or empty text has no lines to remove and stays as it
is; a document whose lines all occur earlier keeps its row, with an empty text;
ids are whole numbers; rows with a null id are passed on unchanged; repeated rows of one id lose the
same lines; extra columns, whatever their names, are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosewright.llm._common import Scratch, components, fresh

#: Lines of so many characters are linked by edits too, shorter ones if equal.
EDIT_CHARS = 24
#: Ids of candidates, 8 bytes each, that are sent to all executors at most.
MOST_SENT = 2_000_000
#: A key under which more lines than these two are filed is crowded: its index row names two.
CROWD = 2
#: Segments of a line under a crowded key.
FINER = 12
#: Characters counted, odd or even, in a line's signature: any would do.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 .,-'éèàü"
#: More than any line number.
PLACES = 2**31


def normal(line: Column) -> Column:
    # the ends are looked at first: trimming walks through the whole line
    outer = reduce(Column.__or__, [test(line, F.lit(c)) for c in " \t\r" for test in (F.startswith, F.endswith)])
    return F.lower(F.when(outer, F.btrim(line, F.lit(" \t\r"))).otherwise(line))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0) and the normal form of every line with a sign in it."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", normal(F.col("line")).alias("norm")).filter("norm != ''")


def _segment(length: Column, parts: int, i: Column | int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of ``parts``: the last ones are longer by one where it doesn't divide."""
    i = F.lit(i)
    short = F.floor(length / parts).cast("int")
    longer = length % parts
    return short * i + F.greatest(longer - (F.lit(parts) - i), F.lit(0)), short + (F.lit(parts) - i <= longer).cast("int")


def _shifts(tau: int) -> list[tuple[int, int]]:
    """(less, shift): how far a whole segment of a line shorter by ``less`` can have moved."""
    return [(less, s) for less in range(tau + 1) for s in range(-tau, tau + 1) if abs(s) + abs(less - s) <= tau]


def _filed(norm: Column, length: Column, tau: int) -> list[Column]:
    return [F.xxhash64(F.lit(i), length, F.substring(norm, start + 1, size)) for i in range(tau + 1) for start, size in [_segment(length, tau + 1, i)]]


def _looked_up(norm: Column, length: Column, tau: int) -> list[Column]:
    """Hashes of the substrings, but for its own segments, that can equal a segment of a line shorter by 0 to ``tau``.

    All lie within a line of ``2 * tau + 1`` characters or more."""
    out = []
    for less in range(tau + 1):
        other = length - less
        for i in range(tau + 1):
            start, size = _segment(other, tau + 1, i)
            low, high = max(-i, less - (tau - i)), min(i, less + (tau - i))
            for shift in range(low, high + 1):
                if less == shift == 0:  # its own segment: the index row names both lines
                    continue
                out.append(F.xxhash64(F.lit(i), other, F.substring(norm, start + shift + 1, size)))
    return out


def _sent(df: DataFrame) -> DataFrame:
    """A written table of one long column, to be broadcast if it has at most ``MOST_SENT`` rows."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def edit_links(scratch: Scratch, lines: DataFrame, tau: int) -> DataFrame:
    """Pairs ``a``, ``b`` of ids of written ``lines`` (id, norm, len; all distinct, a null ``norm`` takes no part) at most ``tau`` edits apart."""
    again = lambda df: scratch.again(df).filter("norm is not null") if df is lines else scratch.again(df)
    index = _under(again(lines), _filed, tau, "b").groupBy("key").agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high"))
    few, none = F.col("n") <= CROWD, F.lit(None).cast("long")
    asked = _under(again(lines), _looked_up, tau, "a").join(index.hint("shuffle_hash"), "key")
    named = F.when(few, F.array_distinct(F.array("low", "high"))).otherwise(F.array(none))
    pairs = asked.select("a", F.explode(named).alias("b"), none.alias("key"))
    own = index.filter("n > 1").select(F.when(few, F.col("low")).alias("a"), F.when(few, F.col("high")).alias("b"), F.when(~few, F.col("key")).alias("key"))
    # a pair, a line under a crowded key (b is null), or a crowded key
    found = scratch.cut(pairs.union(own))
    crowds = scratch.cut(again(found).filter("key is not null").select("key"))
    met = found.filter("a is not null and b is not null").select("a", "b")
    if crowds.head(1):
        filed = _under(again(lines), _filed, tau, "b").join(_sent(crowds), "key", "left_semi").select(F.col("b").alias("id"))
        crowded = scratch.cut(again(found).filter("a is not null and b is null").select(F.col("a").alias("id")).union(filed).distinct())
        some = again(lines).select("id", "norm", "len").join(_sent(crowded), "id", "left_semi").repartition("id")
        met = met.union(_crowded_meetings(scratch, scratch.cut(some.withColumn("sig", _letters(F.col("norm")))), tau))
    met = scratch.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = scratch.cut(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # beyond the bound the texts are dealt out by id
    texts = scratch.cut(again(lines).select("id", "norm").join(_sent(wanted), "id", "left_semi"))
    one, two = texts.select(F.col("id").alias("a"), F.col("norm").alias("x")), again(texts).select(F.col("id").alias("b"), F.col("norm").alias("y"))
    return met.join(one, "a").join(two, "b").filter(within(F.col("x"), F.col("y"), tau)).select("a", "b")


def within(x: Column, y: Column, tau: int) -> Column:
    """Whether two strings are at most ``tau`` edits apart, by a banded bit-parallel automaton.

    The state is one long of ``tau + 1`` lanes. Bit ``d + tau`` of lane ``e``
    says that with ``e`` edits the characters read of ``x`` and ``d`` more of
    ``y`` are matched. A character of ``x`` moves all lanes and diagonals at
    once: equal signs stay in their lane, a changed or left out character
    steps one lane up, and characters put in close the lanes upwards.
    """
    lane = 2 * tau + 2
    if lane * (tau + 1) > 63:
        raise ValueError("the band does not fit into a long")
    every = sum(1 << lane * e for e in range(tau + 1))
    band = every * ((1 << 2 * tau + 1) - 1)
    begin = sum(1 << lane * e + tau + d for e in range(tau + 1) for d in range(e + 1))
    xs, ys = F.split(x, ""), F.split(y, "")
    beside = [F.slice(ys, d + 1, F.greatest(F.size(ys), F.lit(1))) if d >= 0 else F.concat(F.array_repeat(F.lit(""), -d), ys) for d in range(-tau, tau + 1)]

    def step(state: Column, at: Column) -> Column:
        same = F.lit(0).cast("long")
        for k in range(2 * tau + 1):
            same = same.bitwiseOR(F.when(at["0"] == at[str(k + 1)], F.lit(every << k)).otherwise(F.lit(0)).cast("long"))
        up = F.shiftleft(state, lane)
        moved = state.bitwiseAND(same).bitwiseOR(up.bitwiseOR(F.shiftrightunsigned(up, 1)).bitwiseAND(F.lit(band)))
        for _ in range(tau):
            moved = moved.bitwiseOR(F.shiftleft(moved, lane + 1).bitwiseAND(F.lit(band)))
        # a dead state stays so: two lines that differ much cost little
        return F.when((state == 0) | (F.coalesce(at["0"], F.lit("")) == ""), state).otherwise(moved)

    final = F.aggregate(F.arrays_zip(xs, *beside), F.lit(begin).cast("long"), step)
    less = F.length(y) - F.length(x)
    ends = F.get(F.array(*[F.lit(every << k).cast("long") for k in range(2 * tau + 1)]), less + tau)
    return F.when(F.abs(less) <= tau, final.bitwiseAND(ends) != 0).otherwise(False)


def _letters(norm: Column) -> Column:
    """One bit for each of ``LETTERS``: whether it occurs an odd number of times.

    An edit changes at most two of these bits."""
    odd = lambda c: (F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit("")))).bitwiseAND(F.lit(1)).cast("long")
    bits = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        bits = bits.bitwiseOR(F.shiftleft(odd(c), k))
    return bits


def _crowded_meetings(scratch: Scratch, lines: DataFrame, tau: int) -> DataFrame:
    """Candidates ``a``, ``b`` among written lines under crowded keys (id, norm, len, sig).

    Each line is filed under the ``tau + 1`` rarest of ``FINER`` segments
    (``tau`` edits leave one of them whole), and lines meet only if their
    letter signatures are near enough."""
    again, moves = scratch.again, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(s).alias("shift")) for i in range(FINER) for less, s in _shifts(tau)])
    often = scratch.cut(_finely_filed(lines).groupBy("key").count())
    ranked = _finely_filed(again(lines)).join(often, "key").groupBy("b").agg(F.first("sig").alias("sig_b"), F.array_sort(F.collect_list(F.struct("count", "key"))).alias("keys"))
    filed = scratch.cut(ranked.select("b", "sig_b", F.explode(F.slice("keys", 1, tau + 1)["key"]).alias("key")))
    other = (F.col("len") - F.col("m.less")).cast("int")
    start, size = _segment(other, FINER, F.col("m.i"))
    asked = again(lines).select("id", "norm", "len", "sig", F.explode(moves).alias("m")).select(
        F.col("id").alias("a"), "sig", F.xxhash64(F.col("m.i"), other, F.substring("norm", start + F.col("m.shift") + 1, size)).alias("asked")
    )
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_b"))) <= 2 * tau)
    return asked.join(filed, (F.col("asked") == F.col("key")) & near).select("a", "b")


def _finely_filed(lines: DataFrame) -> DataFrame:
    """``b``, ``sig`` and ``key`` of all ``FINER`` segments of each line."""
    start, size = _segment(F.col("len"), FINER, F.col("i"))
    return lines.select("id", "norm", "len", "sig", F.explode(F.sequence(F.lit(0), F.lit(FINER - 1))).alias("i")).select(
        F.col("id").alias("b"), "sig", F.xxhash64("i", "len", F.substring("norm", start + 1, size)).alias("key")
    )


def _under(lines: DataFrame, keys: Callable[[Column, Column, int], list[Column]], tau: int, name: str) -> DataFrame:
    """The id of each line, as ``name``, under each of its keys."""
    # explode_outer: a plain explode has Catalyst build the (never empty) array twice, to test its size
    keyed = lines.select(F.col("id").alias(name), F.array(*keys(F.col("norm"), F.col("len"), tau)).alias("keys"))
    return keyed.select(name, F.explode_outer("keys").alias("key"))


def repeated_lines(docs: DataFrame, tau: int = 2, edit_chars: int = EDIT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences to remove: ``doc_id``, ``line_no``, and the occurrence that stays, ``kept_doc``, ``kept_line``."""
    if edit_chars <= 2 * tau:
        raise ValueError("lines need more characters than twice the edits")
    scratch = Scratch(docs.sparkSession)
    found = _occurrences(docs, id_col, text_col)
    # one number instead of a struct keeps this a hash aggregate: lines are not sorted
    whole = lambda value, digits: value.cast(f"decimal({digits},0)")
    place = whole(F.col("doc_id"), 19) * whole(F.lit(PLACES), 10) + whole(F.col("line_no"), 10)
    line_no = F.pmod(F.col("at"), whole(F.lit(PLACES), 10))
    doc_id = F.expr(f"(at - pmod(at, {PLACES}BD)) div {PLACES}BD")
    first = F.struct(doc_id.cast("long").alias("doc_id"), line_no.cast("int").alias("line_no")).alias("first")
    merged = found.groupBy("norm").agg(F.min(place).alias("at"), F.count("*").alias("n")).withColumn("len", F.length("norm"))
    # a short line that occurs once is of no further use, nor are the words of a short one
    merged = merged.filter((F.col("n") > 1) | (F.col("len") >= edit_chars))
    lines = scratch.cut(merged.select(F.when(F.col("len") >= edit_chars, F.col("norm")).alias("norm"), "len", first, "n", *_key(F.col("norm")), F.monotonically_increasing_id().alias("id")))
    parts = scratch.cut(components(scratch, edit_links(scratch, lines, tau)).withColumnRenamed("component", "class"))
    classed = scratch.cut(scratch.again(lines).select("id", "first", "n", "h1", "h2").join(parts, "id", "left").filter("class is not null or n > 1"))
    least = scratch.cut(classed.filter("class is not null").groupBy("class").agg(F.min("first").alias("class_first")))
    scratch.only(classed, least)
    many = classed.join(least, "class", "left").select("h1", "h2", F.coalesce("class_first", "first").alias("stays"))
    at = found.select("doc_id", "line_no", *_key(F.col("norm")))
    return (
        at.join(many, ["h1", "h2"])
        .filter((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line_no") != F.col("stays.line_no")))
        .select("doc_id", "line_no", F.col("stays.doc_id").alias("kept_doc"), F.col("stays.line_no").alias("kept_line"))
    )


def _key(norm: Column) -> list[Column]:
    """A 128-bit hash that stands for a line."""
    return [F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(1), norm).alias("h2")]


def _by_document(gone: DataFrame, name: str = "gone") -> DataFrame:
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias(name))


def dedup_lines(docs: DataFrame, tau: int = 2, edit_chars: int = EDIT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; columns and rows stay."""
    doc, lines = fresh(docs, "doc", "gone")
    gone = _by_document(repeated_lines(docs, tau, edit_chars, id_col, text_col), lines).withColumnRenamed("doc_id", doc)
    joined = docs.join(gone, docs[id_col] == gone[doc], "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    return joined.withColumn(text_col, F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses lines, with their numbers: ``doc_id``, ``n_removed``, ``removed``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _by_document(repeated_lines(docs)).select(
        "doc_id", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed")
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    return f"""
WITH RECURSIVE occ AS (
  SELECT doc_id, i - 1 AS line_no, lower(trim(parts[i], chr(32) || chr(9) || chr(13))) AS norm
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r
), used AS (SELECT * FROM occ WHERE norm <> ''),
lines AS (SELECT norm, length(norm) AS n, row_number() OVER (ORDER BY norm) AS id FROM (SELECT DISTINCT norm FROM used)),
links AS (
  SELECT a.id AS a, b.id AS b FROM lines a JOIN lines b ON b.n BETWEEN a.n - 2 AND a.n AND a.id != b.id
  WHERE least(a.n, b.n) >= {EDIT_CHARS} AND levenshtein(a.norm, b.norm) <= 2
), twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM twoway UNION SELECT r.id, e.b FROM reach r JOIN twoway e ON e.a = r.other),
classes AS (SELECT l.norm, coalesce(min(r.other), l.id) AS class FROM lines l LEFT JOIN reach r ON r.id = l.id GROUP BY l.norm, l.id),
named AS (SELECT u.doc_id, u.line_no, c.class FROM used u JOIN classes c USING (norm)),
kept AS (SELECT class, doc_id, line_no FROM named QUALIFY row_number() OVER (PARTITION BY class ORDER BY doc_id, line_no) = 1),
gone AS (SELECT DISTINCT n.doc_id, n.line_no FROM named n JOIN kept k USING (class) WHERE n.doc_id != k.doc_id OR n.line_no != k.line_no)
SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id
"""
