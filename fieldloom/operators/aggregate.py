"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..metadata import prepare_aggregation_list, prepare_key
from ..registry import operation
from .util import col, present, tagged

FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "average": F.avg, "count": F.count}


@operation
def aggregate(df: DataFrame, key=None, measures=None, include_count: bool = True, count_field: str = "record_count") -> DataFrame:
    """Key fields, then ``measure_function`` of each measure, then the count. Without a key one row; nulls are left out of measures."""
    names = present(df, prepare_key(key))
    pairs = prepare_aggregation_list(measures)
    present(df, [m for m, _ in pairs])
    if bad := [a for _, a in pairs if a not in FUNCTIONS]:
        raise ArgumentError(f"unknown aggregates {bad}; there are {sorted(FUNCTIONS)}")
    made = [tagged(FUNCTIONS[a](col(m)), f"{m}_{a}", analytical_type="measure") for m, a in pairs]
    if include_count or not made:
        made.append(tagged(F.count(F.lit(1)), count_field, analytical_type="measure"))
    if clash := {count_field} & set(names) if include_count or not pairs else {}:
        raise ArgumentError(f"{clash} is a key; give the count another name")
    return df.groupBy(*map(col, names)).agg(*made)


def register_aggregate(name: str, function) -> None:
    """Make ``function`` (a column to an aggregate) known to ``aggregate`` and to windowed aggregation."""
    FUNCTIONS[name] = function
