"""Row filters. With ``discard`` each gives the rows it otherwise drops; null never lies in a range."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions.predicate import compile_predicate
from ..metadata import prepare_key
from ..registry import operation
from .util import col, present

log = logging.getLogger("fieldloom")

#: Above so many values a set is joined instead of listed in the plan.
LISTED = 1000


@operation
def filter_by_value(df: DataFrame, key, value, discard: bool = False) -> DataFrame:
    """Rows whose key equals the value, null-safe; a key of several fields takes as many values."""
    names = present(df, prepare_key(key))
    values = [value] if len(names) == 1 and not isinstance(value, list | tuple) else list(value)
    if len(names) != len(values):
        raise ArgumentError(f"{len(names)} key fields and {len(values)} values")
    test = reduce(lambda a, b: a & b, [col(n).eqNullSafe(F.lit(v)) for n, v in zip(names, values, strict=True)])
    return df.filter(~test if discard else test)


@operation
def filter_by_set(df: DataFrame, field: str, values: Iterable | DataFrame, discard: bool = False) -> DataFrame:
    """Rows whose field is in a set; long sets, or one-column tables, are joined."""
    (name,) = present(df, [field])
    if not isinstance(values, DataFrame):
        values = list(dict.fromkeys(values))
        with_null, plain = None in values, [v for v in values if v is not None]
        if len(plain) <= LISTED:
            test = F.coalesce(col(name).isin(plain), F.lit(False)) if plain else F.lit(False)
            test = test | col(name).isNull() if with_null else test
            return df.filter(~test if discard else test)
        values = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("__v", df.schema[name].dataType)]))
    other = values.toDF("__v").distinct()
    return df.join(other, col(name).eqNullSafe(other["__v"]), "left_anti" if discard else "left_semi")


@operation
def filter_by_range(df: DataFrame, field: str, low=None, high=None, discard: bool = False) -> DataFrame:
    """Rows from low to high, both included; nulls are in neither result."""
    (name,) = present(df, [field])
    if low is None and high is None:
        raise ArgumentError("a range needs low, high or both")
    sides = [col(name) >= F.lit(low)] * (low is not None) + [col(name) <= F.lit(high)] * (high is not None)
    test = reduce(lambda a, b: a & b, sides)
    return df.filter(~test if discard else test)


@operation
def filter_not_empty(df: DataFrame, field: str) -> DataFrame:
    """Rows whose field isn't null; empty text counts as there."""
    (name,) = present(df, [field])
    return df.filter(col(name).isNotNull())


@operation
def filter_empty(df: DataFrame, field: str) -> DataFrame:
    """Rows whose field is null or empty text."""
    (name,) = present(df, [field])
    test = col(name).isNull()
    return df.filter(test | (col(name) == "") if isinstance(df.schema[name].dataType, T.StringType) else test)


@operation
def filter_by_predicate(df: DataFrame, predicate: str | Column | Callable, fields=None, discard: bool = False, **kwargs) -> DataFrame:
    """Rows that a predicate accepts: text, a column, or a callable of the fields.

    A callable is first tried on columns; what gives a column stays inside the JVM. One that needs
    values runs on Arrow batches. Null results reject.
    """
    names = present(df, fields if fields is not None else [])
    if isinstance(predicate, str):
        test = compile_predicate(predicate)
    elif isinstance(predicate, Column):
        test = predicate
    else:
        test = _called(df, predicate, names, kwargs)
    test = F.coalesce(test.cast("boolean"), F.lit(False))
    return df.filter(~test if discard else test)


def _called(df: DataFrame, predicate: Callable, names: list[str], kwargs: dict) -> Column:
    if not names:
        raise ArgumentError("a callable needs fields")
    try:
        if isinstance(found := predicate(*[col(n) for n in names], **kwargs), Column):
            return found
    except (TypeError, ValueError, AttributeError, PySparkException) as e:  # what columns raise where values are meant
        log.debug("%r takes no columns: %s", predicate, e)
    return F.udf(lambda *row: bool(predicate(*row, **kwargs)), T.BooleanType(), useArrow=True)(*[col(n) for n in names])
