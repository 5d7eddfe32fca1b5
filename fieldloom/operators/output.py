"""Loading, printing and conversion to Python values."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..metadata import prepare_key
from ..registry import operation
from .util import col, present


def aligned(source: DataFrame, schema: T.StructType) -> DataFrame:
    """``source`` with the fields of ``schema``, by name; absent ones are null, others are errors."""
    if extra := [c for c in source.columns if c not in schema.names]:
        raise OperationError(f"fields {extra} aren't in the target")
    return source.select(*[(col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@operation(2)
def insert(source: DataFrame, target: str | DataFrame) -> DataFrame:
    """Add rows to a catalog table by name, or to a DataFrame; returns the target with them."""
    if isinstance(target, DataFrame):
        return target.unionAll(aligned(source, target.schema))
    spark = source.sparkSession
    aligned(source, spark.table(target).schema).write.mode("append").saveAsTable(target)
    return spark.table(target)


@operation
def pretty_print(df: DataFrame, target=None, limit: int | None = 1000) -> DataFrame:
    """Write a text table; numbers stand right. At most ``limit`` rows come to the driver."""
    out = target or sys.stdout
    rows = (df if limit is None else df.limit(limit)).collect()
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    right = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
    line = lambda values: "|" + "|".join(v.rjust(w) if r else v.ljust(w) for v, w, r in zip(values, widths, right, strict=True)) + "|\n"
    rule = "+" + "+".join("-" * w for w in widths) + "+\n"
    out.write(rule + line(df.columns) + rule + "".join(map(line, cells)) + rule)
    return df


@operation
def as_records(df: DataFrame) -> Iterator[dict]:
    """A dict for each row; one partition at a time comes to the driver."""
    return (r.asDict() for r in df.toLocalIterator())


@operation
def fetch_all(df: DataFrame) -> list[tuple]:
    """All rows, on the driver."""
    return [tuple(r) for r in df.collect()]


@operation
def as_dict(df: DataFrame, key=None, value=None) -> dict:
    """Key to row, or to a value; the first field is the key unless one is given. Of equal keys the last row counts."""
    names = present(df, prepare_key(key)) or df.columns[:1]
    values = present(df, prepare_key(value)) if value is not None else df.columns
    pick = lambda r, fields, one: r[fields[0]] if one else tuple(r[f] for f in fields)
    return {pick(r, names, len(names) == 1): pick(r, values, isinstance(value, str)) for r in df.toLocalIterator()}
