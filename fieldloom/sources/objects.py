"""Data objects of Python values, files and addresses."""

from __future__ import annotations

import contextlib
import json
import urllib.request
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..errors import ArgumentError
from ..metadata import FieldList


def _rows(spark: SparkSession, data: Iterable, fields) -> DataFrame:
    """Rows as sequences; Python values are held by the driver."""
    names = FieldList(*fields)
    return spark.createDataFrame([tuple(r) for r in data], names.to_spark(), verifySchema=False)


def _records(spark: SparkSession, data: Iterable[dict], fields) -> DataFrame:
    names = FieldList(*fields).names()
    return _rows(spark, ([r.get(n) for n in names] for r in data), fields)


def _documents(spark: SparkSession, path: str, fields=None, expand: bool = True) -> DataFrame:
    """JSON documents; nested fields become dotted names."""
    from ..functions.scalar import collapse_record

    df = spark.read.json(path) if fields is None else spark.read.schema(FieldList(*fields).to_spark()).json(path)
    return collapse_record(df) if expand else df


def _csv(spark: SparkSession, path: str, **how) -> DataFrame:
    from .csvfile import read_csv

    return read_csv(spark, path, **how)


def _xlsx(spark: SparkSession, path: str, **how) -> DataFrame:
    from .xlsx import read_xlsx

    return read_xlsx(spark, path, **how)


#: Kinds of data objects; each iterable kind has a short name and a long one.
KINDS = {
    "iterable": _rows, "iterable_data_source": _rows, "row_list": _rows, "row_list_data_object": _rows, "iterable_records": _records, "iterable_records_data_source": _records,
    "csv": _csv, "csv_source": _csv, "xlsx": _xlsx, "mongo": _documents, "documents": _documents, "parquet": lambda spark, path: spark.read.parquet(path), "table": lambda spark, name: spark.table(name),
}


def data_object(spark: SparkSession, kind: str, *args, **kwargs) -> DataFrame:
    if kind not in KINDS:
        raise ArgumentError(f"no kind {kind!r}; there are {sorted(KINDS)}")
    return KINDS[kind](spark, *args, **kwargs)


@contextlib.contextmanager
def open_resource(ref, mode: str = "r", encoding: str | None = "UTF-8"):
    """A handle of a path, an address, or a handle, which stays open. On the driver."""
    if hasattr(ref, "read"):
        yield ref
        return
    handle = urllib.request.urlopen(ref) if "://" in str(ref) else open(ref, mode, encoding=None if "b" in mode else encoding)  # noqa: SIM115
    with handle:
        yield handle


def read_json(ref) -> object:
    with open_resource(ref) as f:
        return json.load(f)
