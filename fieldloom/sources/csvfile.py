"""CSV files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..metadata import FieldList, to_field
from ..registry import ops


def read_csv(spark: SparkSession, path: str, fields=None, read_header: bool = True, delimiter: str = ",", encoding: str = "UTF-8", skip_rows: int = 0, empty_as_null: bool = True, **options) -> DataFrame:
    """Fields that are given beat those of the header; a header alone gives texts.

    ``skip_rows`` drops lines at the head of each file. Nulls are empty cells, unless
    ``empty_as_null`` is off, and the ``missing_value`` of a field.
    """
    if fields is None and not read_header:
        raise ArgumentError("neither fields nor a header")
    made = {"sep": delimiter, "encoding": encoding, "header": read_header} | options
    given = FieldList(*fields) if fields is not None else None
    if skip_rows or not _known(encoding):
        df = _skipped(spark, path, skip_rows, encoding, made, given)
    else:
        reader = spark.read.options(**{k: str(v) for k, v in made.items()})
        df = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in given])).option("enforceSchema", "true").csv(path) if given else reader.csv(path)
    if not empty_as_null:
        df = df.fillna("")
    if given is None:
        return df
    for f in given:
        if f.missing_value is not None:
            df = df.withColumn(f.name, F.nullif(F.col(f"`{f.name}`"), F.lit(str(f.missing_value))))
    typed = ops.retype(df, {f.name: f.storage_type for f in given if f.storage_type not in ("unknown", "string", "text")})
    by_name = {f.name: f for f in given.to_spark()}
    return typed.select(*[F.col(f"`{c}`").alias(c, metadata=by_name[c].metadata) for c in typed.columns])


def _known(encoding: str) -> bool:
    """Whether Spark reads the encoding itself."""
    return encoding.upper().replace("_", "-") in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


#: A record: what stands between line ends that are in no quotes.
RECORD = r'(?:[^"\r\n]++|"[^"]*+"?+)++'


def _skipped(spark: SparkSession, path: str, skip: int, encoding: str, made: dict, given: FieldList | None) -> DataFrame:
    """Each file whole, as its head has to be told from its body and its text from its bytes; meant for files that people wrote.

    ``skip`` counts lines; what follows is cut into records, which may hold line ends in quotes.
    """
    decoded = F.decode("content", encoding) if _known(encoding) else F.udf(lambda b: bytes(b).decode(encoding), "string", useArrow=True)("content")
    text = spark.read.format("binaryFile").load(path).select(decoded.alias("t"))
    rest = F.regexp_replace("t", rf"^\x{{FEFF}}?+(?:[^\n]*+(?:\n|\z)){{0,{skip}}}", "") if skip else F.regexp_replace("t", r"^\x{FEFF}", "")
    body = text.select(F.posexplode(F.regexp_extract_all(rest, F.lit(RECORD), F.lit(0))).alias("at", "value")).filter("trim(value) <> ''")
    if made["header"]:
        head = body.filter("at = 0").select("value").first()
        body = body.filter("at > 0")
        names = given.names() if given else next(__import__("csv").reader([head["value"]], delimiter=made["sep"])) if head else []
    else:
        names = given.names()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return body.select(F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", "), {"sep": made["sep"], "multiLine": "true"} | {k: str(v) for k, v in made.items() if k not in ("sep", "encoding", "header")}).alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str, header: bool = True, truncate: bool = True, encoding: str = "UTF-8", single: bool = False, **options) -> None:
    """A folder of CSV files; ``single`` writes one file, for results that one task can hold."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite" if truncate else "append").options(header=header, encoding=encoding, **options).csv(path)


def sidecar(path: str) -> str:
    return f"{path.removesuffix('.csv')}_fields.json"


def read_fields(spark: SparkSession, path: str) -> list | None:
    """Fields of ``name_fields.json`` beside ``name.csv``, if there."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(sidecar(path), wholetext=True).collect()
    except AnalysisException:
        return None
    return [to_field(f) for f in json.loads(rows[0]["value"])]
