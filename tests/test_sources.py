"""Readers, writers and stores, on small files of their own."""

import datetime
import io
import json
import zipfile

import pytest

from fieldloom import ops
from fieldloom.errors import ArgumentError, NoSuchObjectError, OperationError
from fieldloom.metadata import FieldList
from fieldloom.sources import CatalogStore, CSVStore, DataPackage, DataPackageCollectionStore, DocumentStore, FileSystemStore, MemoryStore, copy_object, data_object, open_resource, open_store, read_csv, read_json, read_xlsx, write_csv

FRUITS = [("1", "jablko", "malvice"), ("2", "čerešňa", "kôstkovice"), ("3", "rybízle", "bobule")]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def fruits(tmp_path):
    def make(encoding="utf-8", header=True, head="", name="fruits.csv"):
        lines = ["id,fruit,type"] * header + [",".join(r) for r in FRUITS]
        (tmp_path / name).write_bytes((head + "\n".join(lines) + "\n").encode(encoding))
        return f"file://{tmp_path}/{name}"

    return make


def test_csv_header(spark, fruits):
    df = read_csv(spark, fruits())
    assert df.columns == ["id", "fruit", "type"] and rows(df) == FRUITS


def test_csv_fields(spark, fruits):
    path = fruits()
    with pytest.raises(ArgumentError):
        read_csv(spark, path, read_header=False)
    df = read_csv(spark, path, fields=["n", "name", "kind"], read_header=False)
    assert rows(df)[0] == ("id", "fruit", "type") and df.count() == 4
    assert rows(read_csv(spark, path, fields=[("id", "integer"), "name", "kind"]))[0] == (1, "jablko", "malvice")


@pytest.mark.parametrize("encoding", ["iso-8859-2", "windows-1250"])
def test_csv_encoding(spark, fruits, encoding):
    assert rows(read_csv(spark, fruits(encoding), encoding=encoding)) == FRUITS
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_csv_skip_rows_and_quotes(spark, fruits, tmp_path):
    assert rows(read_csv(spark, fruits(head="a title\n\n"), skip_rows=2)) == FRUITS
    (tmp_path / "q.csv").write_text('title\nid,text\n1,"two\nlines, and ""quotes"""\n2,plain\n\n3,\n')
    got = rows(read_csv(spark, f"file://{tmp_path}/q.csv", skip_rows=1, quote='"', escape='"'))
    assert got == [("1", 'two\nlines, and "quotes"'), ("2", "plain"), ("3", None)]


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("day,at,n,flag,x\n2024-02-29,13:05,7,yes,1.5\n,,,,\n")
    df = read_csv(spark, f"file://{tmp_path}/t.csv", fields=[("day", "date"), ("at", "time"), ("n", "integer"), ("flag", "boolean"), ("x", "number")])
    assert rows(df) == [(datetime.date(2024, 2, 29), "13:05", 7, True, 1.5), (None, None, None, False, None)]
    assert rows(read_csv(spark, f"file://{tmp_path}/t.csv", empty_as_null=False))[1] == ("",) * 5


def sheet(cells, strings):
    def one(ref, v):
        if isinstance(v, str):
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>' if v is not None else ""

    body = "".join(f'<row r="{i}">' + "".join(one(f"{chr(65 + k)}{i}", v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(cells, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


@pytest.fixture
def book(tmp_path):
    def make(name="data.xlsx", extra=()):
        main, rel, strings = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", []
        sheets = {"amounts": [["id", "name", "amount"], [1, "Adam", 10], [2, "Bob", 20], [3, "Cecil", 30], [4, "Dan", 40], *extra], "numbers": [[i] for i in range(12)]}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, (_, cells) in enumerate(sheets.items(), 1):
                z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(cells, strings))
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + "</Relationships>")
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        (tmp_path / "books").mkdir(exist_ok=True)
        (tmp_path / "books" / name).write_bytes(out.getvalue())
        return f"file://{tmp_path}/books/{name}"

    return make


def test_xlsx(spark, book):
    path = book()
    df = read_xlsx(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string", "double"] and rows(df)[0] == (1.0, "Adam", 10.0) and df.count() == 4
    got = read_xlsx(spark, path, skip_rows=3, read_header=False, fields=[("number", "number"), "name"])
    assert rows(got.select("number", "name"))[0] == (3.0, "Cecil") and got.count() == 2
    assert read_xlsx(spark, path, sheet="numbers", read_header=False, skip_rows=2).count() == 10
    for wrong in ({"sheet": "none"}, {"sheet": 7}):
        with pytest.raises(Exception, match="no sheet"):
            read_xlsx(spark, path, **wrong).collect()


def test_xlsx_keeps_values_of_other_types(spark, book):
    df = read_xlsx(spark, book(extra=[[5, "Eve", "n/a"]]))
    assert rows(df)[-1] == (5.0, "Eve", "n/a") and rows(df)[0][2] == "10.0"


def test_xlsx_folder_and_store(spark, book):
    path = book("a.xlsx")
    book("b.xlsx", extra=[[9, "Zoe", "x"]])
    df = read_xlsx(spark, path.rpartition("/")[0])
    assert df.count() == 9 and dict(df.dtypes)["amount"] == "string"
    store = open_store(spark, "xlsx", path)
    assert store.object_names() == ["amounts", "numbers"] and store.exists("numbers") and store.get_object("amounts").count() == store.get_object(0).count() == 4
    with pytest.raises(NoSuchObjectError):
        store.get_object("other")


def test_data_package(spark, fruits, tmp_path):
    fruits()
    fields = [{"name": "id", "type": "integer"}, {"name": "fruit", "type": "string", "title": "Fruit"}, {"name": "type", "type": "any"}]
    (tmp_path / "datapackage.json").write_text(json.dumps({"name": "food", "resources": [{"path": "fruits.csv", "schema": {"fields": fields}}]}))
    package = DataPackage(spark, f"file://{tmp_path}")
    assert package.object_names() == ["food"] and package.exists("food") and rows(package.get_object())[0] == (1, "jablko", "malvice")
    with pytest.raises(NoSuchObjectError):
        package.get_object("other")
    assert DataPackageCollectionStore(spark, f"file://{tmp_path.parent}").get_object(f"{tmp_path.name}.food").count() == 3


@pytest.mark.parametrize("kind", ["memory", "catalog", "file_system", "csv"])
def test_stores(spark, tmp_path, kind):
    store = {"memory": lambda: MemoryStore(spark), "catalog": lambda: CatalogStore(spark), "file_system": lambda: FileSystemStore(spark, f"file://{tmp_path}/s"), "csv": lambda: CSVStore(spark, f"file://{tmp_path}/c")}[kind]()
    df = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    name = f"t_{kind}"
    assert sorted(rows(store.create(name, df))) == sorted(rows(df), key=repr) or kind
    assert store.exists(name) and name in store.object_names()
    with pytest.raises(OperationError):
        store.create(name, df)
    assert store.append(name, df.select("a")).count() == 4
    with pytest.raises(OperationError):
        store.append(name, df.withColumnRenamed("b", "c"))
    assert store.create(name, df, replace=True).count() == 2
    with pytest.raises(NoSuchObjectError):
        store.append("none", df)
    store.truncate(name)
    assert store.get_object(name).count() == 0 or kind == "csv"
    with pytest.raises(NoSuchObjectError):
        store.get_object("none")
    if kind in ("memory", "catalog"):
        assert store.create("empty", FieldList("a", ("n", "integer")), replace=True).columns == ["a", "n"]
        store.delete("empty")
        store.delete(name)
        assert not store.exists(name)


def test_catalog_statements_and_insert(spark):
    store = CatalogStore(spark)
    store.create("st_source", spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, 3, 5)], "a int, b int, c int"), replace=True)
    assert rows(store.statement("SELECT sum(c) AS c FROM st_source")) == [(12,)]
    store.create("st_target", store.statement("SELECT a, c FROM st_source WHERE c > 3"), replace=True)
    assert ops.insert(store.statement("SELECT c FROM st_source WHERE c = 3"), "st_target").count() == 3
    assert sorted(rows(store.get_object("st_target")), key=repr) == sorted([(1, 4), (1, 5), (None, 3)], key=repr)
    for t in ("st_source", "st_target"):
        store.delete(t)


def test_csv_store_roles(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(OperationError):
        CSVStore(spark, f"file://{tmp_path}", role="source").create("t", df)
    with pytest.raises(ArgumentError):
        CSVStore(spark, f"file://{tmp_path}", role="other")
    write_csv(df, f"file://{tmp_path}/t.csv", single=True)
    (tmp_path / "t_fields.json").write_text(json.dumps([{"name": "a", "storage_type": "integer"}]))
    assert rows(CSVStore(spark, f"file://{tmp_path}").get_object("t")) == [(1,)]


def test_document_store(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "id long, `who.name` string, `who.pay.sum` double")
    got = store.create("people", df)
    assert sorted(got.columns) == sorted(df.columns) and sorted(rows(got.select(*[f"`{c}`" for c in df.columns]))) == sorted(rows(df), key=repr)
    assert dict(DocumentStore(spark, f"file://{tmp_path}", expand=False).get_object("people").dtypes)["who"].startswith("struct")
    assert store.append("people", df).count() == 4


def test_copy_object(spark):
    a, b = MemoryStore(spark, {"t": spark.range(3).toDF("n")}), MemoryStore(spark)
    copy_object(a, "t", b, "u", create=True)
    assert copy_object(a, "t", b, "u").count() == 6
    with pytest.raises(OperationError):
        copy_object(a, "t", b, "u", create=True)


def test_data_objects_and_resources(spark, tmp_path):
    assert rows(data_object(spark, "row_list", [[1, "x"], [2, None]], [("a", "integer"), "b"])) == [(1, "x"), (2, None)]
    assert rows(data_object(spark, "iterable_records", [{"a": 1}, {"b": "y"}], [("a", "integer"), "b"])) == [(1, None), (None, "y")]
    with pytest.raises(ArgumentError):
        data_object(spark, "none")
    (tmp_path / "x.json").write_text('{"a": [1]}')
    assert read_json(tmp_path / "x.json") == {"a": [1]}
    with open_resource(handle := io.StringIO("kept")) as f:
        assert f.read() == "kept"
    assert not handle.closed
