"""Scalar helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError

#: Texts that mean true.
TRUE_WORDS = ("1", "true", "yes", "on")


def to_bool(c: Column, kind: T.DataType) -> Column:
    """Of texts, whether they mean true; of numbers, whether they aren't zero; of anything else, whether it is there. Null is false."""
    if isinstance(kind, T.StringType):
        found = F.lower(c).isin(*TRUE_WORDS)
    elif isinstance(kind, T.BooleanType):
        found = c
    else:
        found = c != 0 if isinstance(kind, T.NumericType) else c.isNotNull()
    return F.coalesce(found, F.lit(False))


#: strptime directives and the patterns Spark knows for them.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD",
    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%Z": "VV", "%%": "%",
}


def spark_pattern(strptime: str) -> str:
    """The Spark pattern of a strptime format; everything else is quoted text."""
    out = ""
    for part in re.findall(r"%.|[^%]+|%$", strptime):
        if part[0] == "%":
            if part not in DIRECTIVES:
                raise ArgumentError(f"no pattern for {part!r} in {strptime!r}")
            out += DIRECTIVES[part]
        else:
            out += "".join("''" if c == "'" else c if not c.isalpha() and c not in "[]{}#" else f"'{c}'" for c in part)
    return out.replace("''''", "''") if "'" in strptime else re.sub(r"(?<=\w)''(?=\w)", "", out)


def parsed_time(c: Column, strptime: str) -> Column:
    """A text as a timestamp, or null. Years of two digits from 69 on are of the last century."""
    found = F.try_to_timestamp(c, F.lit(spark_pattern(strptime)))
    return F.when(F.year(found) >= 2069, F.add_months(found, -1200) + (found - F.date_trunc("day", found))).otherwise(found) if "%y" in strptime else found


def java_regex(pattern: str, replacement: str = "") -> tuple[str, str]:
    """A Python pattern and replacement as Java writes them."""
    pattern = re.sub(r"\(\?P<([A-Za-z]\w*)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=([A-Za-z]\w*)\)", r"\\k<\1>", pattern).replace(r"\Z", r"\z")
    out = re.sub(r"\$", r"\\$", replacement)
    out = re.sub(r"\\g<(\d+)>|\\(\d+)", lambda m: f"${m[1] or m[2]}", out)
    return pattern, re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", out)


def guess_type(c: Column, date_format: str | None = None) -> Column:
    """integer, float, date or string; null of null."""
    date = parsed_time(c, date_format).isNotNull() if date_format else F.lit(False)
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), "integer").when(c.try_cast("double").isNotNull(), "float").when(date, "date").otherwise("string")


def expand_record(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns with dotted names become fields of structs."""
    tree: dict = {}
    for name in df.columns:
        at = tree
        *above, last = name.split(separator)
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ArgumentError(f"{name!r} lies below another column")
        if last in at:
            raise ArgumentError(f"{name!r} is there twice")
        at[last] = name

    def build(node) -> Column:
        return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else F.col(f"`{node}`")

    return df.select(*[build(v).alias(k) for k, v in tree.items()])


def collapse_record(df: DataFrame, separator: str = ".") -> DataFrame:
    """Fields of structs become columns with dotted names."""

    def walk(fields, path: tuple[str, ...]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(separator.join((*path, f.name)))

    return df.select(*walk(df.schema.fields, ()))
