"""Layer 1: eight deterministic dimensions, each kept as an integer number of tenths.

With equal weights the overall score is ``tenths / 80.0``: sums of integers do
not depend on order, so ties are exact and equal in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosewright.functions import patterns as P
from prosewright.functions import text as T
from prosewright.functions.text import fresh

DIMENSIONS = ["opener_pattern", "hedging_density", "list_overuse", "sentence_variance", "contractions", "closing_pattern", "em_dash_density", "transition_overuse"]


def _steps(value: Column, steps: list[tuple[str, float, int]], rest: int) -> Column:
    out = None
    for sign, bound, tenths in steps:
        test = {">=": value >= bound, ">": value > bound, "<": value < bound}[sign]
        out = F.when(test, tenths) if out is None else out.when(test, tenths)
    return out.otherwise(rest)


def _density(matches: Column, words: Column) -> Column:
    return matches / F.greatest(words / 200.0, F.lit(1.0))


def _read(t: Column, s: Column) -> dict[str, Column]:
    """What is read off a text: ``t`` as it is, ``s`` without white space at its ends."""
    return {"low": F.lower(t), "pieces": T.sentence_words(s), "first": F.substring_index(s, "\n", 1), "last": T.strip(F.substring_index(s, "\n\n", -1))}


def _counted(t: Column, s: Column, low: Column, pieces: Column, first: Column, last: Column) -> dict[str, Column]:
    """The numbers that the dimensions are made of, each worked out once."""
    sizes = F.filter(pieces, lambda n: n >= 2)
    add = lambda of: F.aggregate(sizes, F.lit(0).cast("long"), of)
    return {
        "words": F.aggregate(pieces, F.lit(0), lambda a, x: a + x),
        "sentences": F.size(sizes),
        "total": add(lambda a, x: a + x),
        "squares": add(lambda a, x: a + x.cast("long") * x),
        "lines": F.regexp_count(s, F.lit(T.FULL_LINE)),
        "bullets": F.regexp_count(s, F.lit(P.BULLET)),
        "hedges": T.count_all(t, low, P.HEDGES),
        "transitions": T.count_all(t, low, P.TRANSITIONS),
        # a contraction stands between word boundaries, so no two of them overlap: one pass counts all
        "contractions": F.when(F.contains(t, F.lit("'")), F.regexp_count(t, F.lit("(?iU)" + "|".join(P.CONTRACTIONS)))).otherwise(0),
        "dashes": T.count_of(t, "—") + T.count_of(t, "--"),
        "opens": T.any_of(first, P.OPENERS, r"\A"),
        "closes": T.any_of(F.concat(last, F.lit(" "), F.substring_index(last, "\n", -1)), P.CLOSINGS),
    }


def _tenths(words: Column, sentences: Column, total: Column, squares: Column, lines: Column, bullets: Column, hedges: Column, transitions: Column, contractions: Column, dashes: Column, opens: Column, closes: Column) -> dict[str, Column]:
    """Tenths by dimension."""
    has = lambda c: F.when(words == 0, 5).otherwise(c)
    n, safe = sentences, F.greatest(words, F.lit(1))
    spread = F.sqrt((n * squares - total * total) / F.greatest(n * (n - 1), F.lit(1)).cast("double")) / (total / F.greatest(n, F.lit(1)))
    return {
        "opener_pattern": F.when(opens, 0).otherwise(10),
        "hedging_density": has(_steps(_density(hedges, words), [(">=", 3, 1), (">=", 2, 3), (">=", 1, 5), (">=", 0.5, 8)], 10)),
        "list_overuse": F.when(lines == 0, 5).otherwise(_steps(bullets / F.greatest(lines, F.lit(1)), [(">", 0.5, 1), (">", 0.25, 3), (">", 0.1, 5), (">", 0.05, 7)], 10)),
        "sentence_variance": F.when(n < 3, 5).otherwise(_steps(spread, [("<", 0.15, 1), ("<", 0.25, 3), ("<", 0.35, 5), ("<", 0.5, 7)], 9)),
        "contractions": has(_steps(contractions / safe, [("<", 0.005, 2), ("<", 0.015, 5), ("<", 0.035, 8)], 9)),
        "closing_pattern": F.when(closes, 0).otherwise(10),
        "em_dash_density": has(_steps(dashes / safe * 500, [(">", 3.0, 1), (">", 1.5, 3), (">", 0.5, 5), (">", 0.2, 7)], 9)),
        "transition_overuse": has(_steps(_density(transitions, words), [(">=", 3, 1), (">=", 2, 3), (">=", 1, 5)], 9)),
    }


def with_dims(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_dims``, all dimensions as one struct of ints; a null text counts as empty.

    What several dimensions need stands in projections of its own, one after
    the other, so that each value is worked out once and stays in generated code.
    """
    for column in columns:
        kept = df.columns
        t, s, *names = fresh(df, "t", "s", "low", "pieces", "first", "last")
        out = df.withColumn(t, T.text_of(F.col(column))).withColumn(s, T.strip(F.col(t)))
        read = _read(F.col(t), F.col(s))
        out = out.withColumns(dict(zip(names, read.values(), strict=True)))
        counted = _counted(F.col(t), F.col(s), **{k: F.col(n) for k, n in zip(read, names, strict=True)})
        (numbers,) = fresh(df, "numbers")
        # generated, not projected: a filter on a score would be pushed below the projections, and work all of it out again
        out = out.select(*kept, F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in counted.items()]))).alias(numbers))
        tenths = _tenths(**{k: F.col(f"{numbers}.{k}") for k in counted})
        df = out.select(*kept, F.struct(*[c.cast("int").alias(k) for k, c in tenths.items()]).alias(f"{column}_dims"))
    return df


def overall(d: Column, weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of a struct from ``with_dims``; no or empty weights: all alike."""
    if not weights:
        return sum((d[k] for k in DIMENSIONS[1:]), d[DIMENSIONS[0]]) / F.lit(80.0)
    used = {k: float(weights.get(k, 1.0)) for k in DIMENSIONS}
    whole = sum(used.values())
    if whole == 0:
        return F.lit(0.0)
    return sum((d[k] / 10.0 * w for k, w in used.items()), F.lit(0.0)) / F.lit(whole)


def with_scores(df: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``<column>_dims`` and ``<column>_score``."""
    out = with_dims(df, columns)
    return out.withColumns({f"{c}_score": overall(F.col(f"{c}_dims"), weights) for c in columns})


def rounded(value: Column, digits: int) -> Column:
    """Rounded as Python does: ties are those of the binary value, and go to the even digit."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")


def combine(layer1: Column, layer2: Column, weight1: float = 0.4, weight2: float = 0.6) -> Column:
    return layer1 * weight1 + layer2 * weight2


def needs_layer2(score: Column, context: str = "source_scoring") -> Column:
    """Whether the costly judge runs: not where layer 1 is decisive."""
    if context == "source_scoring":
        return ~((score > 0.85) | (score < 0.30))
    if context == "aiified_scoring":
        return ~(score < 0.25)
    return F.lit(True)


def normal_rating(raw: Column, low: int = 1, high: int = 5) -> Column:
    return (raw - low) / F.lit(float(high - low))


def weighted_ratings(ratings: Column, weights: dict[str, float], low: int = 1, high: int = 5) -> Column:
    """Mean of normalised ratings of a map column; a missing dimension counts as the lowest."""
    whole = sum(weights.values())
    return sum((normal_rating(F.coalesce(F.try_element_at(ratings, F.lit(k)), F.lit(low)), low, high) * w for k, w in weights.items()), F.lit(0.0)) / F.lit(whole or 1.0)
