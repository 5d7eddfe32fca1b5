"""Projection and field metadata."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions import scalar
from ..metadata import META, SPARK_TYPES, Field, FieldFilter
from ..registry import operation
from .util import col, present

log = logging.getLogger("fieldloom")


def _cast(c: Column, kind: T.DataType, target: str, soft: bool) -> Column:
    """ANSI casts raise on bad values; soft ones give null."""
    is_text = isinstance(kind, T.StringType)
    to = lambda k: c.try_cast(k) if soft else c.cast(k)
    if target == "boolean":
        return scalar.to_bool(c, kind)
    if target == "date" and is_text:
        return (F.try_to_timestamp(c, F.lit("yyyy-MM-dd")) if soft else F.to_timestamp(c, "yyyy-MM-dd")).cast("date")
    if target == "datetime" and is_text:
        return F.try_to_timestamp(c) if soft else F.to_timestamp(c)
    if target == "time":
        return F.date_format(F.try_to_timestamp(c, F.lit("HH:mm")) if soft else F.to_timestamp(c, "HH:mm"), "HH:mm") if is_text else F.date_format(c, "HH:mm")
    if target == "binary" and is_text:
        return F.try_to_binary(c, F.lit("base64")) if soft else F.unbase64(c)
    if target in ("object", "geopoint", "array") and is_text:
        if target == "object":
            return F.try_parse_json(c) if soft else F.parse_json(c)
        return F.from_json(c, SPARK_TYPES[target], {"mode": "PERMISSIVE" if soft else "FAILFAST"})
    return to(SPARK_TYPES[target])


@operation
def retype(df: DataFrame, typemap: dict[str, str], errors: str = "raise") -> DataFrame:
    """Convert fields to storage types. Null stays null (false for booleans); with errors="null" bad values become null."""
    present(df, typemap)
    if bad := [t for t in typemap.values() if t not in SPARK_TYPES]:
        raise ArgumentError(f"unknown storage types {bad}")
    if errors not in ("raise", "null"):
        raise ArgumentError(f"errors is {errors!r}, neither raise nor null")

    def one(f: T.StructField) -> Column:
        if f.name not in typemap:
            return col(f.name)
        target = typemap[f.name]
        extra = Field.from_spark(f).clone(storage_type=target, concrete_storage_type=None).to_dict()
        extra.pop("name")
        changed = f.dataType != SPARK_TYPES[target] or target == "time"
        return (_cast(col(f.name), f.dataType, target, errors == "null") if changed else col(f.name)).alias(f.name, metadata={META: extra})

    return df.select(*[one(f) for f in df.schema.fields])


@operation
def field_filter(df: DataFrame, keep=None, drop=None, rename: dict | None = None, filter: FieldFilter | None = None) -> DataFrame:
    """Keep or drop fields, rename what is left; ``filter`` states all three."""
    if filter is not None and (keep or drop or rename):
        raise ArgumentError("filter excludes keep, drop and rename")
    found = filter or FieldFilter(keep, drop, rename)
    return df.select(*[col(old).alias(new) for old, new in found.pairs(df.columns)])


@operation
def rename_fields(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    return field_filter(df, rename=rename)


@operation
def drop_fields(df: DataFrame, drop) -> DataFrame:
    return field_filter(df, drop=drop)


@operation
def keep_fields(df: DataFrame, keep) -> DataFrame:
    return field_filter(df, keep=keep)


@operation
def debug_fields(df: DataFrame, label: str | None = None) -> DataFrame:
    """Log the schema and return the data."""
    log.info("%s: %s", label or "fields", df.schema.simpleString())
    return df
