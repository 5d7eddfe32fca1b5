"""Stores: named objects that can be read, created, replaced, appended to and emptied."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import ArgumentError, NoSuchObjectError, OperationError
from ..functions.scalar import collapse_record, expand_record
from ..metadata import FieldList
from ..operators.output import aligned
from .csvfile import read_csv, read_fields, write_csv


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def object_names(self) -> list[str]:
        raise NotImplementedError

    def exists(self, name: str) -> bool:
        return name in self.object_names()

    def get_object(self, name: str, **options) -> DataFrame:
        raise NotImplementedError

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        raise NotImplementedError

    def create(self, name: str, data: DataFrame | FieldList, replace: bool = False) -> DataFrame:
        """A new object of these rows, or an empty one of these fields."""
        if self.exists(name) and not replace:
            raise OperationError(f"{name!r} is there already")
        df = self.spark.createDataFrame([], data.to_spark()) if isinstance(data, FieldList) else data
        self._write(name, df, "overwrite")
        return self.get_object(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows by name; absent fields are null."""
        self._write(name, aligned(df, self._get(name).schema), "append")
        return self.get_object(name)

    def truncate(self, name: str) -> None:
        self._write(name, self.spark.createDataFrame([], self._get(name).schema), "overwrite")

    def _get(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise NoSuchObjectError(f"no object {name!r}")
        return self.get_object(name)


class MemoryStore(Store):
    """DataFrames by name, in this process."""

    def __init__(self, spark: SparkSession, objects: dict[str, DataFrame] | None = None):
        super().__init__(spark)
        self.objects = dict(objects or {})

    def object_names(self) -> list[str]:
        return sorted(self.objects)

    def get_object(self, name: str, **options) -> DataFrame:
        if name not in self.objects:
            raise NoSuchObjectError(f"no object {name!r}")
        return self.objects[name]

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        self.objects[name] = self.objects[name].unionAll(df) if mode == "append" else df

    def delete(self, name: str) -> None:
        del self.objects[name]


class CatalogStore(Store):
    """Tables of Spark's catalog, in one database."""

    def __init__(self, spark: SparkSession, schema: str = "default"):
        super().__init__(spark)
        self.schema = schema

    def _full(self, name: str) -> str:
        return f"`{self.schema}`.`{name}`"

    def object_names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema) if not t.isTemporary)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.schema}.{name}")

    def get_object(self, name: str, **options) -> DataFrame:
        if not self.exists(name):
            raise NoSuchObjectError(f"no table {name!r} in {self.schema!r}")
        return self.spark.table(self._full(name))

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).saveAsTable(self._full(name))

    def truncate(self, name: str) -> None:
        self._get(name)
        self.spark.sql(f"TRUNCATE TABLE {self._full(name)}")

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self._full(name)}")

    def statement(self, sql: str) -> DataFrame:
        """A query, not run yet."""
        return self.spark.sql(sql)

    execute = statement


class JDBCStore(Store):
    """Tables of a database; its driver has to be on the class path."""

    def __init__(self, spark: SparkSession, url: str, batch: int = 1024, **options):
        super().__init__(spark)
        self.url, self.options = url, {"batchsize": str(batch)} | options

    def object_names(self) -> list[str]:
        query = "SELECT table_name FROM information_schema.tables"
        return sorted(r[0] for r in self.spark.read.format("jdbc").options(url=self.url, query=query, **self.options).load().collect())

    def get_object(self, name: str, **options) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **(self.options | options)).load()

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        df.write.format("jdbc").mode(mode).options(url=self.url, dbtable=name, truncate="true", **self.options).save()


class FileSystemStore(Store):
    """Files or folders of one folder, by name and suffix; a name without one is looked up under each."""

    SUFFIXES = ("parquet", "csv", "json", "orc", "xlsx")

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", **options):
        super().__init__(spark)
        self.path, self.format, self.options = path.rstrip("/"), format, options

    def _listed(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _file(self, name: str) -> str | None:
        found = self._listed()
        return next((f for f in (name, *(f"{name}.{s}" for s in (self.format, *self.SUFFIXES))) if f in found), None)

    def object_names(self) -> list[str]:
        return sorted({f.rpartition(".")[0] for f in self._listed() if f.rpartition(".")[2] in self.SUFFIXES and f.rpartition(".")[0] and f[0] not in "._"})

    def exists(self, name: str) -> bool:
        return self._file(name) is not None

    def get_object(self, name: str, **options) -> DataFrame:
        file = self._file(name)
        if file is None:
            raise NoSuchObjectError(f"no {name!r} in {self.path}")
        path, kind, how = f"{self.path}/{file}", file.rpartition(".")[2], self.options | options
        if kind == "csv":
            return read_csv(self.spark, path, **({"fields": read_fields(self.spark, path)} | how))
        if kind == "xlsx":
            from .xlsx import read_xlsx

            return read_xlsx(self.spark, path, **how)
        return self.spark.read.format(kind).options(**how).load(path)

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        file = self._file(name) or f"{name}.{self.format}"
        path, kind = f"{self.path}/{file}", file.rpartition(".")[2]
        if kind == "xlsx":
            raise OperationError("spreadsheets can only be read")
        if kind == "csv":
            write_csv(df, path, truncate=mode == "overwrite")
        else:
            df.write.mode(mode).format(kind).save(path)


class CSVStore(FileSystemStore):
    """A folder of CSV files; with role "source" it is only read, with "target" only written."""

    SUFFIXES = ("csv",)

    def __init__(self, spark: SparkSession, path: str, role: str | None = None, **options):
        super().__init__(spark, path, "csv", **options)
        if role not in (None, "source", "target"):
            raise ArgumentError(f"role {role!r} is neither source nor target")
        self.role = role

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        if self.role == "source":
            raise OperationError("the store is a source")
        super()._write(name, df, mode)


class DocumentStore(FileSystemStore):
    """Collections of JSON documents: nested fields are read as dotted names, and written nested again."""

    SUFFIXES = ("json",)

    def __init__(self, spark: SparkSession, path: str, expand: bool = True, **options):
        super().__init__(spark, path, "json", **options)
        self.expand = expand

    def get_object(self, name: str, **options) -> DataFrame:
        df = super().get_object(name, **options)
        return collapse_record(df) if self.expand else df

    def _write(self, name: str, df: DataFrame, mode: str) -> None:
        super()._write(name, expand_record(df) if self.expand else df, mode)


def _xlsx(spark: SparkSession, path: str, **options):
    from .xlsx import XLSXStore

    return XLSXStore(spark, path, **options)


def _package(spark: SparkSession, path: str):
    from .datapackage import DataPackage

    return DataPackage(spark, path)


STORES = {"memory": MemoryStore, "simple_memory": MemoryStore, "sql": CatalogStore, "catalog": CatalogStore, "jdbc": JDBCStore, "csv": CSVStore, "file_system": FileSystemStore, "datapackage": _package, "documents": DocumentStore, "mongo": DocumentStore, "xlsx": _xlsx}


def open_store(spark: SparkSession, kind: str, *args, **kwargs):
    if kind not in STORES:
        raise ArgumentError(f"no kind of store {kind!r}; there are {sorted(STORES)}")
    return STORES[kind](spark, *args, **kwargs)


def copy_object(source: Store, name: str, target: Store, target_name: str | None = None, create: bool = False, replace: bool = False) -> DataFrame:
    """Append an object of one store to an object of another, which ``create`` makes first."""
    df, to = source.get_object(name), target_name or name
    if create:
        return target.create(to, df, replace=replace)
    try:
        return target.append(to, df)
    except AnalysisException as e:
        raise OperationError(str(e)) from e
