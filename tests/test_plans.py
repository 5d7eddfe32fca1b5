"""Field metadata, the graph, pipelines, the registry and the command line."""

import io
import logging
import subprocess
import sys

import pytest

from fieldloom import ops
from fieldloom.errors import ArgumentError, ConsistencyError, NoSuchFieldError, NoSuchObjectError, ProbeAssertionError
from fieldloom.metadata import Field, FieldFilter, FieldList, prepare_aggregation_list, prepare_key, prepare_order_list
from fieldloom.plans import Pipeline
from fieldloom.plans.graph import Graph, Node
from fieldloom.registry import CollectCalls, Registry
from fieldloom.sources import MemoryStore


def test_names_and_indexes():
    f = FieldList("a", "b", "c", "d")
    assert f.names() == ["a", "b", "c", "d"] and f.indexes(["a", "c", "d"]) == [0, 2, 3] and f.index("b") == 1
    assert f.mask(["b", "d"]) == [False, True, False, True] and f.index_map() == {"a": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(NoSuchFieldError):
        f.index("x")
    del f["c"]
    assert f.names() == ["a", "b", "d"] and "c" not in f and len(f) == 3
    assert FieldList("a", ("b", "integer")).aggregated_fields(["a", ("b", "avg")]).names() == ["a_sum", "b_avg", "record_count"]


def test_fields():
    f = FieldList(["bar", "string", "flag"], {"name": "foo", "storage_type": "integer"}, "plain")
    assert [(x.name, x.storage_type) for x in f][:2] == [("bar", "string"), ("foo", "integer")] and f[0].analytical_type == "flag"
    again = Field.from_spark(f[0].to_spark())
    assert (again.name, again.storage_type, again.analytical_type) == ("bar", "string", "flag")
    assert f.clone().names() == f.names() and f.copy() == f and (f + FieldList("more")).names() == [*f.names(), "more"]


def test_field_filter():
    names = ["a", "b", "c", "d"]
    assert FieldFilter(keep=["c", "a"]).pairs(names) == [("a", "a"), ("c", "c")] and FieldFilter(drop=["a"]).pairs(names) == [("b", "b"), ("c", "c"), ("d", "d")]
    assert FieldFilter(drop=["a"], rename={"b": "x"}).pairs(names)[0] == ("b", "x")
    assert FieldFilter(keep=["a"]).field_mask(FieldList(*names)) == [True, False, False, False]
    with pytest.raises(Exception):
        FieldFilter(keep=["a"], drop=["b"]).pairs(names)


def test_lists():
    assert prepare_key(None) == [] and prepare_key("a") == ["a"] and prepare_key(["a", "b"]) == ["a", "b"]
    assert prepare_aggregation_list(["a", ("b", "avg"), ("c", ["min", "max"])]) == [("a", "sum"), ("b", "avg"), ("c", "min"), ("c", "max")]
    assert prepare_order_list(["a", ("b", "desc")]) == [("a", "asc"), ("b", "desc")]


def test_graph():
    g = Graph()
    a, b, c, d = (Node(n, lambda *x: x) for n in "abcd")
    g.add(c)
    g.add(a)
    g.add(b, a)
    g.add(d)
    g.connect(b, c)
    g.connect(d, c, 1)
    order = g.sorted_nodes()
    assert order.index(a) < order.index(b) < order.index(c) and order.index(d) < order.index(c) and g.sources(c) == [b, d] and g.targets(a) == [b]
    with pytest.raises(ConsistencyError):
        g.connect(a, c, 1)
    g.connect(c, a)
    with pytest.raises(ConsistencyError):
        g.sorted_nodes()
    g.remove(b)
    assert g.sources(c) == [d] and len(g.sorted_nodes()) == 3


@pytest.fixture
def stores(spark):
    return {"in": MemoryStore(spark, {"t": spark.createDataFrame([(1, 2, 3), (1, 2, 4), (1, 3, 5)], "a int, b int, c int")}), "out": MemoryStore(spark)}


def test_pipeline(spark, stores):
    p = Pipeline(stores)
    p.source("in", "t").label("all").filter_by_value("b", 2).create("out", "some").aggregate("a", ["c"])
    assert [tuple(r) for r in p.run().collect()] == [(1, 7, 2)] and stores["out"].get_object("some").count() == 2
    q = p["all"].filter_by_value("b", 3).insert_into("out", "some")
    assert any("some" in x for x in q.execution_plan())
    with pytest.raises(NoSuchObjectError):
        p["none"]
    with pytest.raises(ArgumentError):
        Pipeline(stores).run_nothing if False else Pipeline(stores).distinct()
    c = p.clone()
    c.distinct("a")
    assert len(c.graph.nodes) == len(p.graph.nodes) + 1


def test_pipeline_forks(spark, stores):
    p = Pipeline(stores)
    other = p.fork(empty=True).source("in", "t").aggregate("a", [("c", "max")], include_count=False).rename_fields({"a": "key"})
    got = p.source("in", "t").join_details(other, "a", "key").run()
    assert got.count() == 3 and {r["c_max"] for r in got.collect()} == {5}


def test_gates(stores):
    p = Pipeline(stores).source("in", "t").create("out", "gated")
    p.test_if_needed().source("in", "t").assert_unique("a")
    assert p.run() is None and not stores["out"].exists("gated")
    q = Pipeline(stores).source("in", "t").create("out", "gated")
    q.test_if_satisfied().source("in", "t").assert_contains("a", 9)
    with pytest.raises(ProbeAssertionError):
        q.run()
    assert not stores["out"].exists("gated")
    r = Pipeline(stores).source("in", "t").create("out", "gated")
    r.test_if_needed().source("in", "t").assert_unique("c")
    assert r.run().count() == 3


def test_registry(spark):
    seen = CollectCalls()
    ops.observers.append(seen)
    try:
        ops.distinct(spark.range(3), "id")
    finally:
        ops.observers.remove(seen)
    assert seen.calls[0][0] == "distinct" and "distinct(" in ops.signature("distinct") and ops.operands("added_rows") == 2
    with pytest.raises(AttributeError):
        ops.no_such_operation
    own = Registry()

    @own.operation
    def size(x):
        return len(x)

    @own.implementation("size", lambda x: isinstance(x, int))
    def size_of_number(x):
        return x

    assert own.call("size", "abc") == 3 and own.call("size", 7) == 7


def test_debug_fields(spark, caplog):
    with caplog.at_level(logging.INFO, logger="fieldloom"):
        assert ops.debug_fields(spark.range(1), "here").count() == 1
    assert "here" in caplog.text


def test_command_line():
    done = subprocess.run([sys.executable, "-m", "fieldloom", "ops", "--signatures"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "aggregate(" in done.stdout


def test_outputs(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, "z")], "n int, t string").coalesce(1)
    out = io.StringIO()
    assert ops.pretty_print(df, out) is df and "|1|x|" in out.getvalue().replace(" ", "")
    assert list(ops.as_records(df))[1] == {"n": 2, "t": None} and ops.fetch_all(df)[0] == (1, "x")
    assert ops.as_dict(df, "n", "t") == {1: "x", 2: "z"} and ops.as_dict(df)[1] == (1, "x") and ops.as_dict(df, ["n", "t"], "n")[2, None] == 2
