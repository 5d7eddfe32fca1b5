"""Operations on the rows where they could go wrong: nulls, clashes of names, bad values, odd types."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom import ops
from fieldloom.errors import ArgumentError
from fieldloom.functions import scalar


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("text", "kind", "want"), [
    ("2024-02-29", "date", datetime.date(2024, 2, 29)), ("09:30", "time", "09:30"), ("2024-02-29 09:30:01", "datetime", datetime.datetime(2024, 2, 29, 9, 30, 1)), ("17", "integer", 17), ("1.5", "number", 1.5), ("Yes", "boolean", True), ("7", "string", "7"),
])
def test_retype(spark, text, kind, want):
    df = spark.createDataFrame([(text,), (None,)], "v string").coalesce(1)
    got = [r["v"] for r in ops.retype(df, {"v": kind}).collect()]
    assert got[0] == want and got[1] == (False if kind == "boolean" else None)
    if kind in ("date", "time", "datetime", "integer", "number"):
        bad = spark.createDataFrame([("no such",)], "v string")
        assert ops.retype(bad, {"v": kind}, errors="null").first()["v"] is None
        with pytest.raises(PySparkException):
            ops.retype(bad, {"v": kind}).collect()


def test_retype_of_other_types(spark):
    df = spark.sql("SELECT 1 AS i, 0.0D AS d, timestamp '2024-01-02 03:04:05' AS t, date '2024-01-02' AS x")
    got = ops.retype(df, {"i": "string", "d": "boolean", "t": "date", "x": "datetime"}).first()
    assert tuple(got) == ("1", False, datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2))
    assert ops.retype(df, {"t": "time"}).first()["t"] == "03:04"


def test_random_sample_and_the_rest(spark):
    df = spark.range(1000)
    a, b = (rows(ops.sample(df, 0.3, mode="random", seed=42, discard=d)) for d in (False, True))
    assert sorted(a + b, key=repr) == rows(df) and 200 < len(a) < 400
    assert ops.sample(df, 0, mode="random").count() == 0 and ops.sample(df, 1, mode="random").count() == 1000


def test_first_rows_and_the_rest(spark):
    df = spark.range(100).repartition(7)
    a, b = (rows(ops.sample(df, 30, discard=d, order_by="id")) for d in (False, True))
    assert a == rows(spark.range(30)) and b == rows(spark.range(30, 100))


def test_two_digit_years(spark):
    df = spark.createDataFrame([("31.12.99",), ("01.01.69",), ("31.12.68",), ("29.02.00",), (None,), ("x",)], "t string").coalesce(1)
    got = [r["t"] for r in ops.string_to_date(df, "t", "%d.%m.%y").collect()]
    assert got == [datetime.date(1999, 12, 31), datetime.date(1969, 1, 1), datetime.date(2068, 12, 31), datetime.date(2000, 2, 29), None, None]
    at = ops.string_to_date(spark.createDataFrame([("31.12.99 23:59:58",)], "t string"), "t", "%d.%m.%y %H:%M:%S", as_datetime=True).first()["t"]
    assert at == datetime.datetime(1999, 12, 31, 23, 59, 58)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "record_count int, t string")
    assert rows(ops.duplicate_stats(df)) == [(2, 1)]
    with pytest.raises(ArgumentError):
        ops.count_duplicates(df)
    assert rows(ops.count_duplicates(df, record_count_label="n")) == [(1, "x", 2)]
    with pytest.raises(ArgumentError):
        ops.aggregate(df, "record_count")
    assert rows(ops.aggregate(df, "record_count", count_field="n")) == [(1, 2), (2, 1)]


def test_audits_of_maps_and_variants(spark):
    df = spark.sql("SELECT map('a', 1) AS m, parse_json('{\"a\": 1}') AS v, array(map(1, 2)) AS a, 'x' AS t UNION ALL SELECT map('a', 1), parse_json('[2]'), NULL, ''")
    audit = {r["field"]: r for r in ops.basic_audit(df).collect()}
    assert [audit[c]["distinct_count"] for c in "mvat"] == [1, 2, 2, 2] and audit["a"]["null_count"] == 1 and audit["t"]["empty_string_count"] == 1
    assert tuple(ops.distinct_count(df).first()) == (1, 2, 1, 2) and ops.infer_types(df).count() == 4


def test_closed_keys_are_opened_again(spark):
    d = datetime.date
    dim = spark.createDataFrame([(1, "a", d(2000, 1, 1), d(2001, 1, 1)), (2, "b", d(2000, 1, 1), None), (3, "c", d(2000, 1, 1), None)], "k int, v string, valid_from date, valid_to date")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    got = rows(ops.load_versioned_dimension(dim, source, "k", ["v"], at=d(2024, 1, 1)))
    want = [(1, "a", d(2000, 1, 1), d(2001, 1, 1)), (1, "a", d(2024, 1, 1), None), (2, "b", d(2000, 1, 1), None), (3, "c", d(2000, 1, 1), d(2024, 1, 1)), (3, None, d(2024, 1, 1), None), (4, "d", d(2024, 1, 1), None)]
    assert got == sorted(want, key=repr)


def test_predicates(spark):
    df = spark.createDataFrame([(1, 2**53 + 1), (2, None), (3, 5)], "a long, b long")
    assert rows(ops.filter_by_predicate(df, lambda b: b is not None and b % 2 == 1 and str(b) == str(int(b)), ["b"])) == [(1, 2**53 + 1), (3, 5)]
    assert rows(ops.filter_by_predicate(df, lambda a: a > 2, ["a"])) == [(3, 5)]
    with pytest.raises(NameError):
        ops.filter_by_predicate(df, lambda a: no_such_name, ["a"])  # noqa: F821
    assert rows(ops.filter_by_predicate(df, "a << 1 ≥ 4 AND b ≠ 0")) == [(3, 5)] and ops.filter_by_predicate(df, "b ≠ 0", discard=True).count() == 1


def test_nulls_of_filters(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert rows(ops.filter_by_value(df, "a", 1, discard=True)) == [(2,), (None,)] and rows(ops.filter_by_set(df, "a", [1, None])) == [(1,), (None,)]
    assert rows(ops.filter_by_range(df, "a", 1, 1)) == [(1,)] and rows(ops.filter_by_range(df, "a", 1, 1, discard=True)) == [(2,)]
    assert ops.filter_by_set(df, "a", range(2, 5000)).count() == 1


def test_records(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`a.b` int, `a.c.d` string, e int")
    nested = scalar.expand_record(df)
    assert nested.first()["a"]["c"]["d"] == "x" and scalar.collapse_record(nested).columns == df.columns
    with pytest.raises(ArgumentError):
        scalar.expand_record(df.withColumn("a", F.lit(1)))
    kinds = spark.createDataFrame([("1",), ("1.5",), ("x",), ("2024-01-02",), (None,)], "t string").select(scalar.guess_type(F.col("t"), "%Y-%m-%d").alias("k")).collect()
    assert [r["k"] for r in kinds] == ["integer", "float", "string", "date", None]
