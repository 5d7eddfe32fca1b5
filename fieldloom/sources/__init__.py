"""Stores and data sources."""

from .csvfile import read_csv, write_csv
from .datapackage import DataPackage, DataPackageCollectionStore
from .objects import data_object, open_resource, read_json
from .stores import CatalogStore, CSVStore, DocumentStore, FileSystemStore, JDBCStore, MemoryStore, copy_object, open_store
from .xlsx import XLSXSource, XLSXStore, read_xlsx, sheet_names

__all__ = [
    "CSVStore", "CatalogStore", "DataPackage", "DataPackageCollectionStore", "DocumentStore", "FileSystemStore", "JDBCStore", "MemoryStore", "XLSXSource", "XLSXStore", "copy_object",
    "data_object", "open_resource", "open_store", "read_csv", "read_json", "read_xlsx", "sheet_names", "write_csv",
]
