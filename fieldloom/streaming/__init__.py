"""Operations on streams.

Projections, filters and operations on the values of fields run on streaming DataFrames as they
are. Aggregates need windows and a watermark; what depends on the order of rows has no streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, OperationError
from ..metadata import prepare_aggregation_list, prepare_key
from ..operators.aggregate import FUNCTIONS
from ..operators.util import col, present
from ..registry import ops

#: Operations that a stream supports unchanged.
STATELESS = (
    "append", "append_constant_fields", "dates_to_dimension", "debug_fields", "drop_fields", "empty_to_missing", "field_filter", "filter_by_predicate", "filter_by_range", "filter_by_set",
    "filter_by_value", "filter_empty", "filter_not_empty", "join_details", "keep_fields", "rename_fields", "retype", "split_date", "string_split_fixed", "string_strip", "string_to_date", "text_substitute", "transpose_by",
)


def apply(df: DataFrame, name: str, *args, **kwargs) -> DataFrame:
    """An operation, if it has a streaming form."""
    if df.isStreaming and name not in STATELESS:
        raise OperationError(f"{name!r} has no streaming form")
    return ops.call(name, df, *args, **kwargs)


def windowed_aggregate(df: DataFrame, time_field: str, window: str, late: str, key=None, measures=None, slide: str | None = None, count_field: str = "record_count") -> DataFrame:
    """Aggregates by time window, complete once ``late`` has passed since its end; the same on tables and streams."""
    names, pairs = present(df, prepare_key(key)), prepare_aggregation_list(measures)
    present(df, [time_field, *[m for m, _ in pairs]])
    if bad := [a for _, a in pairs if a not in FUNCTIONS]:
        raise ArgumentError(f"unknown aggregates {bad}")
    made = [FUNCTIONS[a](col(m)).alias(f"{m}_{a}") for m, a in pairs] + [F.count(F.lit(1)).alias(count_field)]
    grouped = df.withWatermark(time_field, late).groupBy(F.window(col(time_field), window, slide), *map(col, names)).agg(*made)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[col(c) for c in grouped.columns if c != "window"])


def distinct_within(df: DataFrame, key, time_field: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    names = present(df, prepare_key(key))
    return df.withWatermark(time_field, late).dropDuplicatesWithinWatermark(names) if df.isStreaming else df.dropDuplicates(names)
