"""Spreadsheets (XLSX), by the standard library's zip and XML readers, as a Python data source."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import ArgumentError, NoSuchObjectError
from ..metadata import FieldList

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS)]


def sheet_rows(data: bytes, sheet: str | int = 0) -> Iterator[list]:
    """Rows of values: texts, floats, booleans, dates, None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = list(ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS))
        names = [s.get("name") for s in found]
        if (sheet not in names) if isinstance(sheet, str) else not 0 <= sheet < len(names):
            raise ArgumentError(f"no sheet {sheet!r} in {names}")
        at = found[names.index(sheet) if isinstance(sheet, str) else sheet].get(REL)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        dates = _date_styles(z)
        width, path = 0, targets[at].lstrip("/")
        for _, row in ElementTree.iterparse(z.open(path if path.startswith("xl/") else f"xl/{path}")):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            values: list = []
            for c in row.findall("m:c", NS):
                place = _column(c.get("r")) if c.get("r") else len(values)
                values += [None] * (place - len(values)) + [_value(c, shared, dates)]
            width = max(width, len(values))
            yield values + [None] * (width - len(values))
            row.clear()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind("m:numFmts/m:numFmt", NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _value(c: ElementTree.Element, shared: list[str], dates: set[int]):
    kind, v = c.get("t", "n"), c.find("m:v", NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "d", "e"):
        return v.text if kind != "e" else None
    number = float(v.text)
    return datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number) if int(c.get("s", 0)) in dates else number


def _kind(value) -> T.DataType:
    return {bool: T.BooleanType(), float: T.DoubleType(), datetime.datetime: T.TimestampNTZType()}.get(type(value), T.StringType())


def _layout(rows: list[list], read_header: bool, skip_rows: int) -> tuple[list[str], list[list]]:
    if skip_rows > len(rows):
        raise ArgumentError(f"skip_rows is {skip_rows} of {len(rows)} rows")
    width = max(map(len, rows), default=0)
    names = [str(v) if v is not None else f"col{i}" for i, v in enumerate(rows[0] + [None] * (width - len(rows[0])))] if read_header and rows else [f"col{i}" for i in range(width)]
    return names, [r + [None] * (width - len(r)) for r in rows[max(skip_rows, int(read_header)) :]]


class XLSXReader(DataSourceReader):
    def __init__(self, schema: T.StructType, data: bytes, sheet: str | int, read_header: bool, skip_rows: int):
        self.schema, self.data, self.how = schema, data, (sheet, read_header, skip_rows)

    def read(self, partition) -> Iterator[tuple]:
        sheet, header, skip = self.how
        width = len(self.schema)
        for r in _layout(list(sheet_rows(self.data, sheet)), header, skip)[1]:
            yield tuple(_as(v, f.dataType) for v, f in zip((r + [None] * width)[:width], self.schema.fields, strict=True))


def _as(value, kind: T.DataType):
    if value is None or isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, float | bool) else None
    if isinstance(kind, T.LongType):
        return int(value) if isinstance(value, float | bool) else None
    return value if isinstance(value, bool | datetime.datetime) else None


class XLSXSource(DataSource):
    """Options: path, sheet (name, or number with ``sheet_index``), header, skip_rows."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_xlsx"

    def _how(self) -> tuple:
        o = self.options
        sheet = int(o["sheet_index"]) if "sheet_index" in o else o.get("sheet", 0)
        return sheet, o.get("header", "true").lower() == "true", int(o.get("skip_rows", 0))

    def _data(self) -> bytes:
        import base64

        return base64.b64decode(self.options["data"])

    def schema(self) -> T.StructType:
        sheet, header, skip = self._how()
        names, body = _layout(list(sheet_rows(self._data(), sheet)), header, skip)
        kinds = [{type(_kind(r[i])): _kind(r[i]) for r in body if r[i] is not None} for i in range(len(names))]
        return T.StructType([T.StructField(n, next(iter(k.values())) if len(k) == 1 else T.StringType()) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XLSXReader(schema, self._data(), *self._how())


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sheets; fields whose types differ are texts."""
    for n in set(a.columns) & set(b.columns):
        if a.schema[n].dataType != b.schema[n].dataType:
            a, b = (x.withColumn(n, F.col(f"`{n}`").cast("string")) for x in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


class XLSXStore:
    """A file whose sheets are the objects, by name or number. Read-only."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.spark, self.path, self.options = spark, path, options

    def object_names(self) -> list[str]:
        return sheet_names(bytes(self.spark.read.format("binaryFile").load(self.path).select("content").first()["content"]))

    def exists(self, name: str) -> bool:
        return name in self.object_names()

    def get_object(self, name: str | int = 0, **options) -> DataFrame:
        names = self.object_names()
        if (name not in names) if isinstance(name, str) else not 0 <= name < len(names):
            raise NoSuchObjectError(f"no sheet {name!r} in {names}")
        return read_xlsx(self.spark, self.path, sheet=name, **(self.options | options))


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0, read_header: bool = True, skip_rows: int = 0, fields=None) -> DataFrame:
    """One sheet of a file, or of every file of a folder, by field name. A field has the type that all its values have, or text.

    Spark reads the files, so any of its file systems will do; they pass through the driver, which is meant for
    sheets that people wrote.
    """
    import base64

    spark.dataSource.register(XLSXSource)
    how = {"sheet_index": str(sheet)} if isinstance(sheet, int) else {"sheet": sheet}

    def one(content: bytes) -> DataFrame:
        return spark.read.format("fieldloom_xlsx").options(data=base64.b64encode(content).decode(), header=str(read_header), skip_rows=str(skip_rows), **how).load()

    found = [one(bytes(r["content"])) for r in spark.read.format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator()]
    if not found:
        raise ArgumentError(f"no file in {path}")
    df = reduce(_joined, found)
    if fields is None:
        return df
    from ..registry import ops

    given = FieldList(*fields)
    df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(df.columns, given.names(), strict=False)])
    return ops.retype(df, {f.name: f.storage_type for f in given if f.storage_type != "unknown" and f.name in df.columns})
