"""Layer-1 scores of a stream: a stateless projection, the same as for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prosewright.functions.score import with_scores


def score_stream(texts: DataFrame, column: str = "text") -> DataFrame:
    return with_scores(texts, [column])
