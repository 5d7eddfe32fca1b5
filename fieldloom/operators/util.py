"""Checks and columns that operations share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, NoSuchFieldError
from ..metadata import META, prepare_key, prepare_order_list


def col(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, names: Iterable) -> list[str]:
    names = prepare_key(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise NoSuchFieldError(f"no field {', '.join(map(repr, missing))} in {df.columns}")
    return names


def ordering(df: DataFrame, order) -> list[Column]:
    """Ascending with nulls first, descending with nulls last."""
    pairs = prepare_order_list(order)
    present(df, [n for n, _ in pairs])
    return [col(n).asc_nulls_first() if d == "asc" else col(n).desc_nulls_last() for n, d in pairs]


def natural(df: DataFrame, order) -> list[Column]:
    """The order asked for, or that in which Spark happens to hold the rows."""
    return ordering(df, order) if order is not None else [F.monotonically_increasing_id()]


def tagged(column: Column, name: str, **extra) -> Column:
    return column.alias(name, metadata={META: extra})


def fresh(name: str, *taken: Iterable[str]) -> str:
    """``name``, or ``name`` with as many underscores as no other name has."""
    used = {n.lower() for names in taken for n in names}
    while name.lower() in used:
        name += "_"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that executors share; in a temporary one only where all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ArgumentError("spark.checkpoint.dir names no folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written once, as Parquet, to the shared folder, for results that must not be computed twice."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def comparable(df: DataFrame, name: str) -> Column:
    """The column, or its JSON where it has a kind of values that can't be compared."""

    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)

    return col(name) if plain(df.schema[name].dataType) else F.to_json(col(name))
