"""Tabular data packages: a folder with ``datapackage.json`` and CSV resources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..errors import NoSuchObjectError, OperationError
from ..metadata import Field
from .csvfile import read_csv

#: Types of a table schema that storage types name differently.
TYPES = {"any": "unknown", "year": "integer", "yearmonth": "string", "duration": "string", "geojson": "object"}
STORAGE = {"string", "text", "integer", "number", "boolean", "datetime", "time", "date", "array", "object", "binary", "geopoint"}


def schema_to_fields(schema: dict) -> list[Field]:
    out = []
    for f in schema["fields"]:
        kind = TYPES.get(f.get("type", "string"), f.get("type", "string"))
        out.append(Field(f["name"], kind if kind in STORAGE else "unknown", label=f.get("title"), description=f.get("description")))
    return out


class DataPackage:
    """Read-only; objects are resources. A lone resource without a name has the package's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.text(f"{self.path}/datapackage.json", wholetext=True).collect()
        self.info = json.loads(rows[0]["value"])
        self.name = self.info.get("name") or self.path.rpartition("/")[2]
        found = self.info.get("resources", [])
        self.resources = {r.get("name") or (self.name if len(found) == 1 else f"resource{i}"): r for i, r in enumerate(found)}

    def object_names(self) -> list[str]:
        return list(self.resources)

    def exists(self, name: str) -> bool:
        return name in self.resources

    def get_object(self, name: str | None = None, **options) -> DataFrame:
        name = name or next(iter(self.resources), None)
        if name not in self.resources:
            raise NoSuchObjectError(f"no resource {name!r} in {self.name!r}")
        r = self.resources[name]
        path = r.get("path") or r.get("url")
        path = path[0] if isinstance(path, list) else path
        if r.get("format", str(path).rpartition(".")[2]).lower() != "csv":
            raise OperationError(f"resource {name!r} is no CSV")
        dialect = r.get("dialect", {})
        how = {"delimiter": dialect.get("delimiter", ","), "read_header": dialect.get("header", True), "encoding": r.get("encoding", "UTF-8")}
        fields = schema_to_fields(r["schema"]) if r.get("schema") else None
        return read_csv(self.spark, path if "://" in path else f"{self.path}/{path}", fields=fields, **(how | options))


class DataPackageCollectionStore:
    """Packages in subfolders, by folder name; their objects are ``package`` or ``package.resource``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get_object(self, name: str, **options) -> DataFrame:
        package, _, resource = name.partition(".")
        return DataPackage(self.spark, f"{self.path}/{package}").get_object(resource or None, **options)
