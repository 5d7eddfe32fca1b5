"""Comparison of a source with a target, and slowly changing dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..metadata import prepare_key
from ..registry import operation
from .compose import null_safe, renamed_apart
from .util import col, fresh, present


def _keys(src: DataFrame, target: DataFrame, src_key, target_key) -> tuple[list[str], list[str]]:
    left = present(src, prepare_key(src_key))
    right = present(target, prepare_key(target_key if target_key is not None else src_key))
    if not left or len(left) != len(right):
        raise ArgumentError(f"keys {left} and {right}")
    return left, right


@operation(2)
def added_rows(src: DataFrame, target: DataFrame, src_key, target_key=None) -> DataFrame:
    """Rows of the source whose key the target lacks; null equals null."""
    left, right = _keys(src, target, src_key, target_key)
    other, names = renamed_apart(target.select(*map(col, right)), right, src.columns)
    return src.join(other, null_safe(left, names), "left_anti")


@operation(2)
def added_keys(src: DataFrame, target: DataFrame, src_key, target_key=None) -> DataFrame:
    """Distinct keys of the source that the target lacks."""
    left, _ = _keys(src, target, src_key, target_key)
    return added_rows(src, target, src_key, target_key).select(*map(col, left)).distinct()


@operation(2)
def changed_rows(dim: DataFrame, source: DataFrame, dim_key, source_key=None, fields=None, version_field: str | None = None, null_safe: bool = False) -> DataFrame:
    """Rows of the source whose key the dimension has with another value in a field.

    With a version field only rows of the dimension where it is null are compared. A null on either
    side is no change, unless ``null_safe``.
    """
    right, left = _keys(dim, source, dim_key, source_key)
    names = present(dim, prepare_key(fields) if fields is not None else [c for c in source.columns if c in dim.columns and c not in left])
    present(source, names)
    if version_field is not None:
        dim = dim.filter(col(*present(dim, [version_field])).isNull())
    other, found = renamed_apart(dim.select(*[col(c) for c in dict.fromkeys([*right, *names])]), list(dict.fromkeys([*right, *names])), source.columns)
    place = dict(zip(dict.fromkeys([*right, *names]), found, strict=True))
    same = reduce(lambda a, b: a & b, [col(a) == col(place[b]) for a, b in zip(left, right, strict=True)])
    differs = [(~F.equal_null(col(n), col(place[n])) if null_safe else col(n) != col(place[n])) for n in names]
    return source.join(other, same & reduce(lambda a, b: a | b, differs)).drop(*found)


@operation(2)
def load_versioned_dimension(dim: DataFrame, source: DataFrame, dim_key, fields, version_fields=("valid_from", "valid_to"), source_key=None, at=None) -> DataFrame:
    """The dimension after a type 2 load: a row that changed is closed and a new version is opened, new keys are added.

    ``version_fields`` hold from when to when a row is valid; null in the second marks the open
    version, and nulls count as values when rows are compared. ``at`` is the time of the load. A
    key whose versions are all closed is opened again. The source has one row for each key.
    """
    begin, end = present(dim, list(version_fields))
    right, left = _keys(dim, source, dim_key, source_key)
    names = present(source, prepare_key(fields))
    stamp = F.lit(at) if at is not None else F.current_timestamp()
    stamp = stamp.cast(dim.schema[end].dataType)
    changed = changed_rows(dim, source, right, left, names, end, null_safe=True)
    other, found = renamed_apart(changed.select(*map(col, left)).distinct(), left, dim.columns)
    mark = fresh("__changed", dim.columns, found)
    other = other.withColumn(mark, F.lit(True))
    joined = dim.join(other, reduce(lambda a, b: a & b, [col(a) == col(b) for a, b in zip(right, found, strict=True)]) & col(end).isNull(), "left")
    closed = joined.withColumn(end, F.when(col(mark), stamp).otherwise(col(end))).select(*map(col, dim.columns))
    fresh_rows = changed.unionByName(added_rows(source, dim.filter(col(end).isNull()), left, right))
    place = dict(zip(right, left, strict=True))
    value = lambda c: F.lit(None) if c == end or place.get(c, c) not in source.columns else col(place.get(c, c))
    opened = fresh_rows.select(*[(stamp if c == begin else value(c)).cast(dim.schema[c].dataType).alias(c) for c in dim.columns])
    return closed.unionByName(opened)
