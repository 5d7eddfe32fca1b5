"""Distinct, sampling and order.

Operations on "first" or "n-th" rows take ``order_by``; without it they use the order in which Spark
holds the rows, which may differ from run to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..metadata import prepare_key, prepare_order_list
from ..registry import operation
from .util import col, cut, fresh, natural, ordering, present


@operation
def distinct(df: DataFrame, key=None, is_sorted: bool = False) -> DataFrame:
    """Distinct values of the key fields (all fields without a key), in the order of the fields. ``is_sorted`` changes nothing."""
    names = present(df, prepare_key(key)) or df.columns
    return df.select(*[col(c) for c in df.columns if c in names]).distinct()


def _numbered(df: DataFrame, key, order_by) -> tuple[DataFrame, str]:
    number = fresh("__number", df.columns)
    names = present(df, prepare_key(key)) or df.columns
    if order_by is None:
        base = fresh("__natural", df.columns)
        df = df.withColumn(base, F.monotonically_increasing_id())
        return df.withColumn(number, F.row_number().over(W.partitionBy(*map(col, names)).orderBy(base))).drop(base), number
    return df.withColumn(number, F.row_number().over(W.partitionBy(*map(col, names)).orderBy(*ordering(df, order_by)))), number


@operation
def distinct_rows(df: DataFrame, key=None, is_sorted: bool = False, order_by=None) -> DataFrame:
    """The first whole row of each key. ``is_sorted`` changes nothing."""
    return first_unique(df, key, order_by=order_by)


@operation
def first_unique(df: DataFrame, keys=None, discard: bool = False, order_by=None) -> DataFrame:
    """The first row of each key; with discard the second and later ones.

    Kept by a minimum over (order, row), which combines before the shuffle, so a key with many rows
    reaches no task whole; discarding has to number the rows.
    """
    if discard or order_by is None or not _plain(df, order_by):
        found, number = _numbered(df, keys, order_by)
        return found.filter(col(number) > 1 if discard else col(number) == 1).drop(number)
    names = present(df, prepare_key(keys)) or df.columns
    order = [n for n, _ in prepare_order_list(order_by)]
    rest = [c for c in df.columns if c not in order]
    whole = F.struct(*[col(c) for c in (*order, *rest)])
    pick = F.min(whole) if prepare_order_list(order_by)[0][1] == "asc" else F.max(whole)
    row = fresh("__row", df.columns)
    keyed = df.groupBy(*[col(n).alias(f"__key{i}") for i, n in enumerate(names)]).agg(pick.alias(row))
    return keyed.select(*[F.col(f"{row}.`{c}`").alias(c) for c in df.columns])


def _plain(df: DataFrame, order_by) -> bool:
    """Whether a minimum or maximum over structs orders like ``order_by``: one direction, and only types that can be ordered."""
    ways = {d for _, d in prepare_order_list(order_by)}
    present(df, [n for n, _ in prepare_order_list(order_by)])
    return len(ways) == 1 and not any(isinstance(f.dataType, T.MapType | T.VariantType) for f in df.schema.fields)


def with_position(df: DataFrame, order_by, name: str) -> DataFrame:
    """Add the place of each row, from 0, in one order over all tasks.

    Rows are dealt by range, sorted in each part and written down; a row's place is its place in the part plus
    the rows of the parts before. The sums of parts are few, so no task gets all rows.
    """
    part, place, total = fresh("__part", df.columns), fresh("__place", df.columns), fresh("__total", df.columns)
    if order_by is not None:
        df = df.orderBy(*ordering(df, order_by))
    df = cut(df.withColumn(place, F.monotonically_increasing_id()))
    df = df.withColumn(part, F.shiftright(col(place), 33).cast("int")).withColumn(place, col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    counts = {r[part]: r["n"] for r in df.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, n = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(n)
        n += counts.get(k, 0)
    if not before:
        return df.withColumn(name, F.lit(0).cast("long")).drop(part, place)
    start = F.element_at(F.from_json(F.lit(str(before)), "array<bigint>"), col(part) + 1)
    return df.withColumn(total, start).withColumn(name, col(total) + col(place)).drop(part, place, total)


@operation
def sample(df: DataFrame, value, discard: bool = False, mode: str = "first", order_by=None, seed: int | None = None) -> DataFrame:
    """``first``: n rows. ``nth``: rows 0, n, 2n... ``random``: that share of rows. With discard the others.

    Random rows are drawn by one number a row, so with one seed, and rows read in the same way, a
    sample and its discard make up the table.
    """
    if mode == "random":
        if not 0 <= value <= 1:
            raise ArgumentError(f"share {value} isn't between 0 and 1")
        drawn = fresh("__drawn", df.columns)
        found = df.withColumn(drawn, F.rand(42 if seed is None else seed))
        return found.filter(col(drawn) >= float(value) if discard else col(drawn) < float(value)).drop(drawn)
    if not isinstance(value, int) or value < 0:
        raise ArgumentError(f"sample of {value!r} rows")
    if mode == "first":
        if not discard:
            return (df.orderBy(*natural(df, order_by)) if order_by is not None else df).limit(value)
        at = fresh("__at", df.columns)
        return with_position(df, order_by, at).filter(col(at) >= value).drop(at)
    if mode != "nth":
        raise ArgumentError(f"mode {mode!r} is none of first, nth, random")
    if value < 1:
        raise ArgumentError("every 0th row")
    at = fresh("__at", df.columns)
    found = with_position(df, order_by, at)
    return found.filter(col(at) % value != 0 if discard else col(at) % value == 0).drop(at)


@operation
def discard_nth(df: DataFrame, step: int, order_by=None) -> DataFrame:
    """Drop rows 0, step, 2 * step..."""
    return sample(df, step, discard=True, mode="nth", order_by=order_by)


@operation
def sort(df: DataFrame, orderby) -> DataFrame:
    """By fields, or (field, "asc" or "desc"); nulls come first going up and last going down."""
    return df.orderBy(*ordering(df, orderby))
