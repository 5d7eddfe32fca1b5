"""Operations on streams give what they give on tables."""

import pytest
from pyspark.sql import functions as F

from fieldloom.errors import OperationError
from fieldloom.streaming import STATELESS, apply, distinct_within, windowed_aggregate

#: A table that streams are joined with.
SMALL = []
#: Arguments of each operation that a stream supports.
CALLS = {
    "append": lambda df, other: (([df, other],), {}), "append_constant_fields": lambda df, _: ((df, ["k"], 1), {}), "dates_to_dimension": lambda df, _: ((df, "day"), {}), "debug_fields": lambda df, _: ((df,), {}),
    "drop_fields": lambda df, _: ((df, ["t"]), {}), "empty_to_missing": lambda df, _: ((df, ["t"]), {}), "field_filter": lambda df, _: ((df,), {"keep": ["id"]}), "filter_by_predicate": lambda df, _: ((df, "id > 2"), {}),
    "filter_by_range": lambda df, _: ((df, "id", 2, 4), {}), "filter_by_set": lambda df, _: ((df, "id", [1, 2]), {}), "filter_by_value": lambda df, _: ((df, "id", 2), {}), "filter_empty": lambda df, _: ((df, "t"), {}),
    "filter_not_empty": lambda df, _: ((df, "t"), {}), "keep_fields": lambda df, _: ((df, ["id", "t"]), {}), "rename_fields": lambda df, _: ((df, {"id": "n"}), {}), "retype": lambda df, _: ((df, {"id": "string"}), {}),
    "split_date": lambda df, _: ((df, "day"), {}), "string_strip": lambda df, _: ((df, ["t"]), {}), "text_substitute": lambda df, _: ((df, "t", [("a", "b")]), {}),
    "join_details": lambda df, other: ((df, SMALL[0], "id", "key"), {}), "string_split_fixed": lambda df, _: ((df, "t", ["x", "y"], [1, 1]), {}), "string_to_date": lambda df, _: ((df, "t", "%Y"), {}), "transpose_by": lambda df, _: ((df.select("id", "t", "day"), "id"), {}),
}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('stream')}"
    df = spark.range(8).select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit(" a"), F.col("id").cast("string"))).alias("t"), F.expr("date_add(date '2024-01-01', CAST(id AS INT))").alias("day"), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT))").alias("at"))
    df.repartition(2).write.parquet(f"{path}/t")
    SMALL[:] = [spark.createDataFrame([(1, "one"), (2, "two")], "key long, name string")]
    return spark.read.parquet(f"{path}/t"), lambda: spark.readStream.schema(df.schema).parquet(f"{path}/t")


def streamed(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return sorted((tuple(r) for r in spark.table("streamed").collect()), key=repr)


@pytest.mark.parametrize("name", sorted(CALLS))
def test_stateless(spark, source, tmp_path, name):
    table, stream = source
    out = []
    for df in (table, stream()):
        args, kwargs = CALLS[name](df, df)
        out.append(apply(args[0], name, *args[1:], **kwargs) if not isinstance(args[0], list) else __import__("fieldloom").ops.call(name, *args, **kwargs))
    assert set(STATELESS) == set(CALLS) and out[1].isStreaming
    assert streamed(spark, out[1], tmp_path) == sorted((tuple(r) for r in out[0].collect()), key=repr)


def test_no_streaming_form(source):
    with pytest.raises(OperationError):
        apply(source[1](), "sort", "id")


def test_windows(spark, source, tmp_path):
    table, stream = source
    how = ("at", "2 hours", "1 hour")
    want = sorted((tuple(r) for r in windowed_aggregate(table, *how, measures=["id"]).collect()), key=repr)
    got = streamed(spark, windowed_aggregate(stream(), *how, measures=["id"]), tmp_path)
    assert len(want) == 4 and set(got) <= set(want) and len(got) >= 3


def test_distinct_within(spark, source, tmp_path):
    table, stream = source
    assert len(streamed(spark, distinct_within(stream().withColumn("k", F.col("id") % 2), "k", "at", "30 days"), tmp_path)) == distinct_within(table.withColumn("k", F.col("id") % 2), "k", "at", "30 days").count() == 2
