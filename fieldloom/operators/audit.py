"""Data quality: duplicates, completeness, distinct values, audits and type inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions.scalar import spark_pattern
from ..metadata import prepare_key
from ..registry import operation
from .util import col, comparable, fresh, present


@operation
def count_duplicates(df: DataFrame, keys=None, threshold: int = 1, record_count_label: str = "record_count") -> DataFrame:
    """Keys (whole rows without one) that occur more often than ``threshold``, and how often."""
    if threshold < 1:
        raise ArgumentError(f"threshold {threshold} is below 1")
    names = present(df, prepare_key(keys)) or df.columns
    if record_count_label in names:
        raise ArgumentError(f"{record_count_label!r} is a field; give the count another label")
    return df.groupBy(*map(col, names)).agg(F.count(F.lit(1)).alias(record_count_label)).filter(col(record_count_label) > threshold)


@operation
def duplicate_stats(df: DataFrame, fields=None, threshold: int = 1) -> DataFrame:
    """How many groups of duplicates there are of each size."""
    label = fresh("__count", df.columns)
    return count_duplicates(df, fields, threshold, label).groupBy(col(label).alias("record_count")).agg(F.count(F.lit(1)).alias("group_count"))


@operation
def nonempty_count(df: DataFrame, fields=None) -> DataFrame:
    """One row: how many values of each field aren't null."""
    return df.agg(*[F.count(col(n)).alias(n) for n in present(df, prepare_key(fields)) or df.columns])


@operation
def distinct_count(df: DataFrame, fields=None, approximate: bool = False) -> DataFrame:
    """One row: how many distinct values each field has, nulls left out. Approximate counts take one pass and no shuffle of values."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(comparable(df, n)).alias(n) for n in present(df, prepare_key(fields)) or df.columns])


def _stacked(row: DataFrame, made: dict[str, Column]) -> DataFrame:
    """A row for each field out of one row of aggregates."""
    return row.select(F.explode(F.array(*[v.alias(k) for k, v in made.items()])).alias("x")).select("x.*")


@operation
def basic_audit(df: DataFrame, distinct_threshold: int = 100) -> DataFrame:
    """A row for each field: counts, ratios, lengths of texts, distinct values up to a threshold.

    All fields are audited in one aggregation. Values are counted by a sketch only as far as it
    takes to know whether there may be few; exact sets are kept for no more than twice the
    threshold of them, so memory doesn't grow with the table.
    """
    rough = df.agg(*[F.approx_count_distinct(comparable(df, f.name), 0.05).alias(f"r{i}") for i, f in enumerate(df.schema.fields)]).first()
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c, text = col(f.name), isinstance(f.dataType, T.StringType)
        few = rough[f"r{i}"] <= 2 * distinct_threshold
        aggregates += [
            F.count(c).alias(f"v{i}"), (F.count_if(c == "") if text else F.lit(0).cast("long")).alias(f"e{i}"), (F.min(F.length(c)) if text else F.lit(None).cast("int")).alias(f"a{i}"),
            (F.max(F.length(c)) if text else F.lit(None).cast("int")).alias(f"b{i}"), (F.size(F.collect_set(comparable(df, f.name))) if few else F.lit(2 * distinct_threshold)).cast("long").alias(f"d{i}"),
        ]
    row, n = df.agg(*aggregates), F.col("n")

    def made(i: int, name: str) -> Column:
        value, null = F.col(f"v{i}"), n - F.col(f"v{i}")
        ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
        distinct = F.col(f"d{i}") + F.when(null > 0, 1).otherwise(0)
        return F.struct(
            F.lit(name).alias("field"), n.alias("record_count"), ratio(value, n).alias("value_ratio"), null.alias("null_count"), ratio(null, value).alias("null_value_ratio"), ratio(null, n).alias("null_record_ratio"),
            F.col(f"e{i}").alias("empty_string_count"), F.col(f"a{i}").alias("min_length"), F.col(f"b{i}").alias("max_length"), F.least(distinct, F.lit(distinct_threshold)).alias("distinct_count"), (distinct > distinct_threshold).alias("distinct_overflow"),
        )

    return _stacked(row, {f.name: made(i, f.name) for i, f in enumerate(df.schema.fields)})


@operation
def infer_types(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """A row for each field: the type that all its values have. Text beats float, float beats integer, dates stand apart; nulls alone are text."""
    kinds, aggregates = ("integer", "float", "date"), []
    for i, f in enumerate(df.schema.fields):
        c = comparable(df, f.name).cast("string")
        date = F.try_to_timestamp(c, F.lit(spark_pattern(date_format))).isNotNull() if date_format else F.lit(False)
        integer = c.rlike(r"^\s*[+-]?[0-9]+\s*$")
        floating = ~integer & c.try_cast("double").isNotNull()
        tests = (integer, floating, ~integer & ~floating & date)
        aggregates += [F.coalesce(F.max(t), F.lit(False)).alias(f"{k}{i}") for k, t in zip(kinds, tests, strict=True)]
        aggregates.append(F.coalesce(F.max(c.isNotNull() & ~tests[0] & ~tests[1] & ~tests[2]), F.lit(False)).alias(f"string{i}"))
    row = df.agg(*aggregates)

    def made(i: int, name: str) -> Column:
        has = {k: F.col(f"{k}{i}") for k in (*kinds, "string")}
        number = has["integer"] | has["float"]
        found = F.when(has["string"] | (has["date"] & number), "string").when(has["float"], "float").when(has["integer"], "integer").when(has["date"], "date").otherwise("string")
        return F.struct(F.lit(name).alias("field"), found.alias("type"))

    return _stacked(row, {f.name: made(i, f.name) for i, f in enumerate(df.schema.fields)})
