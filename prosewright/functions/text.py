"""Column helpers for text, with Unicode-aware white space and words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode's white space and the four separators, as a class without brackets and as characters.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TRIMMED = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = f"[{BLANKS}]+"
#: A line with a sign in it; the text has no white space at its end.
FULL_LINE = rf"[{BLANKS}]*+[^{BLANKS}][^\n]*+"
#: Signs that match a Latin letter without regard to case but are not lower-cased to it.
ODD_CASES = "ſıİ"


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_ws(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != ""))


def words_re(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def first_line(text: Column) -> Column:
    return F.substring_index(strip(text), "\n", 1)


def sentence_words(stripped: Column) -> Column:
    """Words of each sentence of a text without white space at its ends; none of an empty one."""
    sizes = F.transform(F.split(stripped, rf"(?<=[.!?]){SPACE}"), lambda x: F.size(F.split(x, SPACE)))
    return F.when(stripped == "", F.array().cast("array<int>")).otherwise(sizes)


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a string, from the left, without overlap."""
    found = (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))
    return F.when(F.contains(text, F.lit(part)), found.cast("int")).otherwise(0)


def holds_any(low: Column, parts: tuple[str, ...]) -> Column:
    """Whether a lower-case text may hold one of ``parts``, in any case of its letters: a cheap test before a pattern."""
    tests = [F.contains(low, F.lit(p)) for p in (*parts, *ODD_CASES)]
    return reduce(Column.__or__, tests)


def count_all(text: Column, low: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """Matches of every pattern, added up; ``patterns`` has with each the strings of which every match holds one, ``low`` is the text in lower case."""
    counts = [F.when(holds_any(low, parts), F.regexp_count(text, F.lit("(?iU)" + p))).otherwise(0) for p, parts in patterns.items()]
    return reduce(Column.__add__, counts)


def any_of(text: Column, patterns: list[str], before: str = "") -> Column:
    return text.rlike(f"(?iU){before}(?:" + "|".join(patterns) + ")")


def length_band(words: Column) -> Column:
    return F.when(words < 100, "short").when(words < 220, "medium").otherwise("long")


def preview(text: Column, size: int, mark: str = "") -> Column:
    short = F.substring(text, 1, size)
    return F.when(F.length(text) > size, F.concat(short, F.lit(mark))).otherwise(short)
