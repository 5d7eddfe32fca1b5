"""Operations on the values of fields: constants, dates, text, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, FieldError
from ..functions.scalar import java_regex, parsed_time
from ..metadata import prepare_key
from ..registry import operation
from .util import col, present, tagged

MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)
PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def replaced(df: DataFrame, made: dict[str, Column | list[Column]]) -> DataFrame:
    """``df`` with columns in place of others."""
    out: list[Column] = []
    for c in df.columns:
        found = made.get(c, col(c))
        out += found if isinstance(found, list) else [found]
    return df.select(*out)


def _of_type(df: DataFrame, kinds, fields=None) -> list[str]:
    return present(df, fields) if fields is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


@operation
def append_constant_fields(df: DataFrame, fields, value) -> DataFrame:
    """New fields at the end; one value for all of them, or a list with one for each."""
    names = [str(getattr(f, "name", f)) for f in ([fields] if isinstance(fields, str) or hasattr(fields, "storage_type") else fields)]
    values = list(value) if isinstance(value, Sequence) and not isinstance(value, str | bytes) else [value] * len(names)
    if len(values) != len(names):
        raise ArgumentError(f"{len(names)} fields and {len(values)} values")
    if there := [n for n in names if n in df.columns]:
        raise FieldError(f"fields {there} are there already")
    return df.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in zip(names, values, strict=True)})


@operation
def dates_to_dimension(df: DataFrame, fields=None, unknown_date: int = 0) -> DataFrame:
    """Dates as integer keys YYYYMMDD, null as ``unknown_date``; all date fields if none are given."""
    names = _of_type(df, T.DateType, fields)
    for n in names:
        if not isinstance(df.schema[n].dataType, MOMENTS):
            raise FieldError(f"{n!r} is no date")
    key = lambda n: F.coalesce(F.year(col(n)) * 10000 + F.month(col(n)) * 100 + F.dayofmonth(col(n)), F.lit(unknown_date)).cast("long")
    return replaced(df, {n: tagged(key(n), n, analytical_type="ordinal") for n in names})


@operation
def string_to_date(df: DataFrame, fields, fmt: str = "%Y-%m-%dT%H:%M:%S.Z", as_datetime: bool = False) -> DataFrame:
    """Dates of texts in a strptime format; null where a text is none."""
    made = {n: parsed_time(col(n), fmt) for n in present(df, prepare_key(fields))}
    return replaced(df, {n: (c if as_datetime else c.cast("date")).alias(n) for n, c in made.items()})


@operation
def split_date(df: DataFrame, fields, parts: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """Replace dates by integer fields ``name_part``, in place."""
    names = present(df, prepare_key(fields))
    if bad := [p for p in parts if p not in PARTS]:
        raise ArgumentError(f"unknown parts {bad}; there are {list(PARTS)}")
    for n in names:
        if not isinstance(df.schema[n].dataType, MOMENTS):
            raise FieldError(f"{n!r} is no date")
    return replaced(df, {n: [tagged(PARTS[p](col(n)), f"{n}_{p}", analytical_type="ordinal") for p in parts] for n in names})


@operation
def text_substitute(df: DataFrame, field: str, substitutions: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace matches of expressions, one after the other; written as in Python."""
    (name,) = present(df, [field])
    c = col(name)
    for pattern, replacement in substitutions:
        p, r = java_regex(pattern, replacement)
        c = F.regexp_replace(c, p, r)
    return replaced(df, {name: c.alias(name)})


@operation
def empty_to_missing(df: DataFrame, fields=None, strict: bool = False) -> DataFrame:
    """Empty text becomes null, in the fields given or all texts; unknown names are errors only if strict."""
    names = [f.name for f in df.schema.fields] if fields is None else prepare_key(fields)
    if strict:
        present(df, names)
    texts = [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.StringType)]
    return replaced(df, {n: F.nullif(col(n), F.lit("")).alias(n) for n in texts})


@operation
def string_strip(df: DataFrame, strip_fields=None, chars: str | None = None) -> DataFrame:
    """Strip white space, or the characters given, from both ends of the fields given or all texts."""
    names = _of_type(df, T.StringType, prepare_key(strip_fields) if strip_fields is not None else None)
    one = lambda n: F.btrim(col(n), F.lit(chars)) if chars is not None else F.regexp_replace(col(n), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return replaced(df, {n: one(n).alias(n) for n in names})


@operation
def string_split_fixed(df: DataFrame, split_fields, new_fields: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Replace a text of fixed columns by one field for each width; short texts give empty fields."""
    (name,) = present(df, prepare_key(split_fields))
    if len(new_fields) != len(widths) or any(w < 1 for w in widths):
        raise ArgumentError("as many positive widths as new fields")
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    return replaced(df, {name: [F.substring(col(name), s, w).alias(n) for n, s, w in zip(new_fields, starts, widths, strict=True)]})


@operation
def transpose_by(df: DataFrame, key, column_field: str = "column", value_field: str = "value") -> DataFrame:
    """A row for each field besides the key: key, name of the field, value. Mixed types become text; nulls stay."""
    names = present(df, prepare_key(key))
    rest = [f for f in df.schema.fields if f.name not in names]
    if not rest:
        raise ArgumentError("no field besides the key")
    if len({f.dataType.simpleString() for f in rest}) > 1:
        df = df.select(*map(col, names), *[col(f.name).cast("string").alias(f.name) for f in rest])
    return df.unpivot([col(n) for n in names], [col(f.name) for f in rest], column_field, value_field)
