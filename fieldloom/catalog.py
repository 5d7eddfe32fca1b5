"""Queries over the test tables, one or more for each operation, and the same in SQL."""

from __future__ import annotations

import datetime
import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ops
from .functions import scalar
from .operators.aggregate import register_aggregate
from .operators.output import aligned
from .operators.util import shared_folder
from .plans import Pipeline
from .sources import DataPackage, DocumentStore, FileSystemStore, MemoryStore, read_csv, write_csv
from .sources import copy_object as stores_copy

#: name: (query of a function that gives tables, SQL)
QUERIES: dict[str, tuple[Callable, str]] = {}


def query(sql: str) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 2) for n in names})


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, count(*) AS record_count FROM lineitem GROUP BY 1, 2")
def aggregate_sum_count(t):
    return rounded(ops.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]), "l_quantity_sum", "l_extendedprice_sum")


@query("SELECT o_orderpriority, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, round(avg(o_totalprice), 2) AS o_totalprice_avg, count(*) AS record_count FROM orders GROUP BY 1")
def aggregate_min_max_avg(t):
    return rounded(ops.aggregate(t("orders"), "o_orderpriority", [("o_totalprice", ["min", "max", "avg"])]), "o_totalprice_avg")


@query("SELECT event_type, count(*) AS record_count FROM events GROUP BY 1")
def aggregate_count_only(t):
    return ops.aggregate(t("events"), "event_type")


@query("SELECT round(sum(value), 2) AS value_sum, count(value) AS value_count, count(*) AS n FROM events")
def aggregate_global(t):
    return rounded(ops.aggregate(t("events"), None, [("value", "sum"), ("value", "count")], count_field="n"), "value_sum")


@query("SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def filter_value(t):
    return ops.filter_by_value(t("events"), "event_type", t("events").agg(F.min("event_type")).first()[0])


@query("SELECT * FROM (SELECT p_partkey, nullif(p_brand, 'Brand#11') AS p_brand FROM part) WHERE p_brand IS DISTINCT FROM 'Brand#12'")
def filter_value_discard(t):
    return ops.filter_by_value(t("part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand")), "p_brand", "Brand#12", discard=True)


@query("SELECT * FROM part WHERE p_size IN (1, 5, 9)")
def filter_set(t):
    return ops.filter_by_set(t("part"), "p_size", [1, 5, 9])


@query("SELECT * FROM part WHERE p_size NOT IN (1, 5, 9)")
def filter_set_discard(t):
    return ops.filter_by_set(t("part"), "p_size", [1, 5, 9], discard=True)


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def filter_set_joined(t):
    return ops.filter_by_set(t("orders"), "o_custkey", ops.keep_fields(ops.filter_by_value(t("customer"), "c_nationkey", 3), "c_custkey"))


@query("SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_range(t):
    return ops.filter_by_range(t("lineitem"), "l_quantity", 10, 20)


@query("SELECT * FROM lineitem WHERE l_quantity >= 45")
def filter_range_low(t):
    return ops.filter_by_range(t("lineitem"), "l_quantity", low=45)


@query("SELECT * FROM lineitem WHERE l_quantity <= 5")
def filter_range_high(t):
    return ops.filter_by_range(t("lineitem"), "l_quantity", high=5)


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS l_quantity FROM lineitem) WHERE l_quantity NOT BETWEEN 10 AND 40")
def filter_range_discard(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"))
    return ops.filter_by_range(df, "l_quantity", 10, 40, discard=True)


BLANKED = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE p_name END AS p_name FROM part"


def blanked(t) -> DataFrame:
    return t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_name")).alias("p_name"))


@query(f"SELECT * FROM ({BLANKED}) WHERE p_name IS NULL OR p_name = ''")
def filter_empty(t):
    return ops.filter_empty(blanked(t), "p_name")


@query(f"SELECT * FROM ({BLANKED}) WHERE p_name IS NOT NULL")
def filter_not_empty(t):
    return ops.filter_not_empty(blanked(t), "p_name")


@query("SELECT * FROM customer WHERE c_acctbal > 1000 AND c_nationkey < 10")
def filter_predicate(t):
    return ops.filter_by_predicate(t("customer"), lambda balance, nation: (balance > 1000) & (nation < 10), ["c_acctbal", "c_nationkey"])


@query("SELECT * FROM customer WHERE NOT (c_acctbal >= 1000 AND c_nationkey <> 3)")
def filter_predicate_text(t):
    return ops.filter_by_predicate(t("customer"), "c_acctbal ≥ 1000 and c_nationkey ≠ 3", discard=True)


@query("SELECT * FROM customer WHERE length(c_name) % 2 = 0 AND c_nationkey % 2 = 1")
def filter_predicate_python(t):
    return ops.filter_by_predicate(t("customer"), lambda name, nation: len(name) % 2 == 0 and nation % 2 == 1, ["c_name", "c_nationkey"])


@query("SELECT n_nationkey, n_regionkey FROM nation")
def keep_fields(t):
    return ops.keep_fields(t("nation"), ["n_regionkey", "n_nationkey"])


@query("SELECT n_nationkey, n_regionkey FROM nation")
def drop_fields(t):
    return ops.drop_fields(t("nation"), "n_name")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename_fields(t):
    return ops.rename_fields(t("nation"), {"n_nationkey": "id", "n_name": "name"})


@query("SELECT n_name AS nation, n_regionkey FROM nation")
def field_filter(t):
    return ops.field_filter(t("nation"), drop=["n_nationkey"], rename={"n_name": "nation"})


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def debug_fields(t):
    return ops.debug_fields(t("nation"), "nation")


@query("SELECT event_id::VARCHAR AS event_id, user_id::DOUBLE AS user_id, event_type IN ('1', 'true', 'yes', 'on') AS event_type, trunc(value)::BIGINT AS value FROM events")
def retype(t):
    return ops.retype(ops.keep_fields(t("events"), ["event_id", "user_id", "event_type", "value"]), {"event_id": "string", "user_id": "number", "event_type": "boolean", "value": "integer"})


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_key(t):
    return ops.distinct(t("documents"), ["source", "lang"])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_all(t):
    return ops.distinct(t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def distinct_rows(t):
    return ops.distinct_rows(t("documents"), "text", order_by="doc_id").drop("text")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_unique(t):
    return ops.first_unique(t("orders"), "o_custkey", order_by=[("o_totalprice", "desc"), ("o_orderkey", "asc")])


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def first_unique_discard(t):
    return ops.first_unique(t("documents"), "text", discard=True, order_by="doc_id").select("doc_id", "lang")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def sample_first(t):
    return ops.sample(t("orders"), 100, order_by="o_orderkey")


@query("SELECT * FROM orders ORDER BY o_orderkey OFFSET 100")
def sample_first_discard(t):
    return ops.sample(t("orders"), 100, discard=True, order_by="o_orderkey")


@query("SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 0")
def sample_nth(t):
    return ops.sample(t("orders"), 7, mode="nth", order_by="o_orderkey")


@query("SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 3 <> 0")
def discard_nth(t):
    return ops.discard_nth(t("orders"), 3, order_by="o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 50")
def sort_topk(t):
    return ops.sample(ops.sort(t("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), "o_orderkey"]), 50)


@query("SELECT * FROM part ORDER BY p_brand, p_partkey DESC")
def sort(t):
    return ops.sort(t("part"), ["p_brand", ("p_partkey", "descending")])


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def append_all(t):
    nation = t("nation").select(F.col("n_name").alias("name"))
    return ops.append([nation, t("region").select("r_name"), nation])


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def append_distinct(t):
    nation = t("nation").select(F.col("n_name").alias("name"))
    return ops.append([nation, t("region").select("r_name"), nation], distinct=True)


@query("SELECT o.*, c_name, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey")
def join_details(t):
    return ops.join_details(t("orders"), t("customer").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey")


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_star(t):
    details = [t("customer").select("c_custkey", "c_name", "c_nationkey"), t("nation").select("n_nationkey", "n_name")]
    joins = [{"master": "o_custkey", "detail": "c_custkey"}, {"master": "c_nationkey", "detail": "n_nationkey"}]
    return ops.join_details(t("orders").select("o_orderkey", "o_custkey"), details, joins=joins)


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def added_keys(t):
    return ops.added_keys(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def added_rows(t):
    return ops.added_rows(t("orders"), t("lineitem"), "o_orderkey", "l_orderkey")


NEWER = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer"


def newer(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", F.when(k % 10 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 15 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query(f"SELECT s.* FROM ({NEWER}) s JOIN customer d USING (c_custkey) WHERE s.c_name <> d.c_name OR s.c_acctbal <> d.c_acctbal")
def changed_rows(t):
    return ops.changed_rows(t("customer"), newer(t), "c_custkey", fields=["c_name", "c_acctbal"])


@query("SELECT o_orderkey, coalesce(year(d) * 10000 + month(d) * 100 + day(d), -1)::BIGINT AS d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders)")
def dates_to_dimension(t):
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderdate").cast("date")).alias("d"))
    return ops.dates_to_dimension(df, unknown_date=-1)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month, day(o_orderdate)::INT AS o_orderdate_day, o_orderstatus FROM orders")
def split_date(t):
    return ops.split_date(t("orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def string_to_date(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("none")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return ops.string_to_date(t("orders").select("o_orderkey", text.alias("d")), "d", "%d/%m/%Y")


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(p_brand, 'Brand#(\d)(\d)', '\2-\1', 'g'), '-', '$', 'g') AS p_brand FROM part")
def text_substitute(t):
    return ops.text_substitute(t("part").select("p_partkey", "p_brand"), "p_brand", [(r"Brand#(\d)(?P<b>\d)", r"\g<b>-\1"), ("-", "$")])


@query("SELECT p_partkey, p_name, trim(p_type, 'SNE') AS p_type FROM part")
def string_strip(t):
    padded = t("part").select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit("\n ")).alias("p_name"), "p_type")
    return ops.string_strip(ops.string_strip(padded, "p_name"), "p_type", "SNE")


@query(f"SELECT p_partkey, nullif(p_name, '') AS p_name FROM ({BLANKED})")
def empty_to_missing(t):
    return ops.empty_to_missing(blanked(t))


@query("SELECT p_partkey, substr(p_brand, 1, 5) AS word, substr(p_brand, 6, 1) AS sign, substr(p_brand, 7, 2) AS number FROM part")
def string_split_fixed(t):
    return ops.string_split_fixed(t("part").select("p_partkey", "p_brand"), "p_brand", ["word", "sign", "number"], [5, 1, 2])


@query("SELECT s_suppkey, 'x' AS tag, 7 AS version FROM supplier")
def append_constant(t):
    return ops.append_constant_fields(t("supplier").select("s_suppkey"), ["tag", "version"], ["x", 7])


@query("SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part")
def transpose_by(t):
    return ops.transpose_by(t("part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", "field", "value")


@query("SELECT l_orderkey, l_linenumber, count(*) AS record_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def count_duplicates(t):
    return ops.count_duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT record_count, count(*) AS group_count FROM (SELECT count(*) AS record_count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY 1")
def duplicate_stats(t):
    return ops.duplicate_stats(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT count(p_partkey) AS p_partkey, count(p_name) AS p_name FROM ({BLANKED})")
def nonempty_count(t):
    return ops.nonempty_count(blanked(t))


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type FROM events")
def distinct_count(t):
    return ops.distinct_count(t("events"), ["user_id", "event_type"])


def _audit_sql(name: str, text: bool) -> str:
    lengths = f"min(length({name}))::INT AS min_length, max(length({name}))::INT AS max_length" if text else "NULL::INT AS min_length, NULL::INT AS max_length"
    empty = f"count(*) FILTER ({name} = '')" if text else "0::BIGINT"
    found = f"(count(DISTINCT {name}) + CASE WHEN count({name}) < count(*) THEN 1 ELSE 0 END)"
    return (
        f"SELECT '{name}' AS field, count(*) AS record_count, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE count({name})::DOUBLE / count(*) END AS value_ratio, count(*) - count({name}) AS null_count, CASE WHEN count({name}) = 0 THEN 0.0::DOUBLE ELSE (count(*) - count({name}))::DOUBLE / count({name}) END AS null_value_ratio, "
        f"CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE (count(*) - count({name}))::DOUBLE / count(*) END AS null_record_ratio, {empty} AS empty_string_count, {lengths}, least({found}, 100)::BIGINT AS distinct_count, {found} > 100 AS distinct_overflow FROM ({BLANKED})"
    )


@query(f"{_audit_sql('p_partkey', False)} UNION ALL {_audit_sql('p_name', True)}")
def basic_audit(t):
    return ops.basic_audit(blanked(t))


@query("SELECT 'event_id' AS field, 'integer' AS type UNION ALL SELECT 'value', 'float' UNION ALL SELECT 'event_type', 'string' UNION ALL SELECT 'day', 'date'")
def infer_types(t):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return ops.infer_types(t("events").select(F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"), "event_type", day), "%Y-%m-%d")


def _status(t, passed: bool) -> DataFrame:
    return t("region").sparkSession.sql(f"SELECT {str(passed).lower()} AS passed")


def _passes(check: Callable[[], object]) -> bool:
    from .errors import ProbeAssertionError

    try:
        check()
    except ProbeAssertionError:
        return False
    return True


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS passed FROM orders")
def assert_unique(t):
    return _status(t, _passes(lambda: ops.assert_unique(t("orders"), "o_orderkey")))


@query("SELECT count(*) = count(DISTINCT o_custkey) AS passed FROM orders")
def assert_unique_fails(t):
    return _status(t, _passes(lambda: ops.assert_unique(t("orders"), "o_custkey")))


@query("SELECT count(*) > 0 AS passed FROM orders WHERE o_orderstatus = 'F'")
def assert_contains(t):
    return _status(t, _passes(lambda: ops.assert_contains(t("orders"), "o_orderstatus", "F")))


@query("SELECT count(*) = 0 AS passed FROM orders WHERE o_orderstatus = 'F'")
def assert_missing(t):
    return _status(t, _passes(lambda: ops.assert_missing(t("orders"), "o_orderstatus", "F")))


@query("SELECT o_orderkey, o_custkey, max(year(o_orderdate)) OVER (PARTITION BY o_custkey)::INT AS last_year FROM orders")
def aggregate_over_window(t):
    years = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    last = ops.rename_fields(ops.aggregate(years, "o_custkey", [("y", "max")], include_count=False), {"y_max": "last_year"})
    return ops.join_details(ops.drop_fields(years, "y"), last, "o_custkey")


@query("SELECT n_name, count(*) AS record_count, round(sum(c_acctbal), 2) AS c_acctbal_sum FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def pipeline_fork_join(t):
    p = Pipeline({"in": MemoryStore(t("customer").sparkSession, {"customer": t("customer"), "nation": t("nation")})})
    nation = p.fork(empty=True).source("in", "nation").keep_fields(["n_nationkey", "n_name"])
    p.source("in", "customer").filter_by_value("c_mktsegment", "BUILDING").join_details(nation, "c_nationkey", "n_nationkey").aggregate("n_name", ["c_acctbal"])
    return rounded(p.run(), "c_acctbal_sum")


@query(
    f"WITH s AS ({NEWER} UNION ALL SELECT 1000000000, 'new', 1.0), c AS (SELECT s.* FROM s JOIN customer d USING (c_custkey) WHERE s.c_name <> d.c_name OR s.c_acctbal <> d.c_acctbal) "
    "SELECT d.c_custkey, d.c_name, d.c_acctbal, DATE '2000-01-01' AS valid_from, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE DATE '2024-01-01' END AS valid_to FROM customer d LEFT JOIN c USING (c_custkey) "
    "UNION ALL SELECT c.*, DATE '2024-01-01', NULL FROM c UNION ALL SELECT s.*, DATE '2024-01-01', NULL FROM s WHERE c_custkey = 1000000000"
)
def scd2_load(t):
    dim = t("customer").select("c_custkey", "c_name", "c_acctbal", F.lit(datetime.date(2000, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    extra = t("customer").sparkSession.sql("SELECT CAST(1000000000 AS BIGINT) AS c_custkey, 'new' AS c_name, CAST(1.0 AS DOUBLE) AS c_acctbal")
    return ops.load_versioned_dimension(dim, newer(t).unionAll(extra), "c_custkey", ["c_name", "c_acctbal"], at=datetime.date(2024, 1, 1))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, NULL FROM nation")
def insert(t):
    return ops.insert(t("nation").select(F.col("n_nationkey").alias("r_regionkey")), t("region"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, round(sum(value), 2) AS value_sum, count(*) AS record_count FROM events GROUP BY ALL")
def windowed_aggregate(t):
    from .streaming import windowed_aggregate as windowed

    events = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rounded(windowed(events, "ts", "1 day", "1 hour", "event_type", ["value"]), "value_sum")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def retype_date(t):
    return ops.retype(t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), {"day": "date"})


@query("SELECT event_id, strftime(ts, '%H:%M') AS at FROM events")
def retype_time(t):
    return ops.retype(t("events").select("event_id", F.date_format("ts", "HH:mm").alias("at")), {"at": "time"})


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def retype_datetime(t):
    df = ops.retype(t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")), {"at": "datetime"})
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT * FROM customer")
def sample_random_parts(t):
    return ops.append([ops.sample(t("customer"), 0.3, mode="random", seed=7), ops.sample(t("customer"), 0.3, discard=True, mode="random", seed=7)])


@query("SELECT n_nationkey, n_name, 'old' AS state, DATE '2000-01-01' AS valid_from, DATE '2001-01-01' AS valid_to FROM nation UNION ALL SELECT n_nationkey, n_name, 'new', DATE '2024-01-01', NULL FROM nation")
def scd2_reopened(t):
    dim = t("nation").select("n_nationkey", "n_name", F.lit("old").alias("state"), F.lit(datetime.date(2000, 1, 1)).alias("valid_from"), F.lit(datetime.date(2001, 1, 1)).alias("valid_to"))
    return ops.load_versioned_dimension(dim, t("nation").select("n_nationkey", "n_name", F.lit("new").alias("state")), "n_nationkey", ["n_name", "state"], at=datetime.date(2024, 1, 1))


@query("SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS l_quantity_range, count(*) AS record_count FROM lineitem GROUP BY 1")
def aggregate_registered(t):
    register_aggregate("range", lambda c: F.max(c) - F.min(c))
    return ops.aggregate(t("lineitem"), "l_returnflag", [("l_quantity", "range")])


@query("SELECT * FROM orders WHERE o_totalprice >= 1000 AND o_custkey % 8 <> 3 AND NOT (o_orderstatus = 'F') AND (o_orderkey << 1) > 200")
def filter_predicate_signs(t):
    return ops.filter_by_predicate(t("orders"), "o_totalprice ≥ 1000 AND o_custkey % 8 ≠ 3 AND ¬ (o_orderstatus == 'F') AND o_orderkey << 1 > 200")


def _csv(t, name: str, fields=None) -> DataFrame:
    df = t(name)
    path = shared_folder(df.sparkSession, name)
    write_csv(df, path)
    return read_csv(df.sparkSession, path, fields=fields)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(t):
    fields = [("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "number"), ("c_mktsegment", "string")]
    df = ops.drop_fields(_csv(t, "customer", fields), ["c_mktsegment"])
    return df.select(*[F.col(c).cast(t("customer").schema[c].dataType).alias(c) for c in df.columns])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def csv_dates(t):
    df = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return _csv(lambda _: df, "orders", [("o_orderkey", "integer"), ("day", "date")]).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "day")


@query("SELECT 'p_partkey' AS field, 'integer' AS type UNION ALL SELECT 'p_name', 'string' UNION ALL SELECT 'p_brand', 'string' UNION ALL SELECT 'p_type', 'string' UNION ALL SELECT 'p_size', 'integer' UNION ALL SELECT 'p_retailprice', 'float'")
def infer_types_csv(t):
    return ops.infer_types(_csv(t, "part"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def data_package(t):
    spark, nation = t("nation").sparkSession, t("nation")
    path = shared_folder(spark, "package")
    write_csv(nation, f"{path}/nation.csv")
    fields = [{"name": "n_nationkey", "type": "integer"}, {"name": "n_name", "type": "string"}, {"name": "n_regionkey", "type": "integer"}]
    info = json.dumps({"name": "geo", "resources": [{"name": "nation", "path": "nation.csv", "schema": {"fields": fields}}]})
    spark.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{path}/datapackage.json")
    return aligned(DataPackage(spark, path).get_object("nation"), nation.schema)


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def copy_object(t):
    spark = t("region").sparkSession
    source, target = MemoryStore(spark, {"region": t("region")}), FileSystemStore(spark, shared_folder(spark, "store"))
    stores_copy(source, "region", target, "there", create=True)
    return stores_copy(source, "region", target, "there")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def document_store(t):
    spark, nested = t("supplier").sparkSession, t("supplier").select(F.col("s_suppkey").alias("s.key"), F.col("s_name").alias("s.name.first"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("s.acctbal"))
    store = DocumentStore(spark, shared_folder(spark, "documents"))
    df = store.create("supplier", nested)
    return aligned(df.select(F.col("`s.key`").alias("s_suppkey"), F.col("`s.name.first`").alias("s_name"), F.col("nation").alias("s_nationkey"), F.col("`s.acctbal`").alias("s_acctbal")), t("supplier").schema)


@query("SELECT p_partkey, 'integer' AS size_type, 'float' AS price_type, 'string' AS name_type, CAST(NULL AS VARCHAR) AS no_type FROM part")
def guess_type(t):
    kinds = {"size_type": F.col("p_size").cast("string"), "price_type": F.col("p_retailprice").cast("string"), "name_type": F.col("p_name"), "no_type": F.lit(None).cast("string")}
    return t("part").select("p_partkey", *[scalar.guess_type(c).alias(k) for k, c in kinds.items()])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def expand_collapse_record(t):
    flat = t("orders").select(F.col("o_orderkey").alias("order.key"), F.col("o_custkey").alias("order.customer.key"), F.col("o_totalprice").alias("price"))
    back = scalar.collapse_record(scalar.expand_record(flat))
    return back.select(F.col("`order.key`").alias("o_orderkey"), F.col("`order.customer.key`").alias("o_custkey"), F.col("price").alias("o_totalprice"))


@query("SELECT n_nationkey, n_name FROM nation")
def as_dict(t):
    found = ops.as_dict(t("nation"), "n_nationkey", "n_name")
    return t("nation").sparkSession.createDataFrame(list(found.items()), "n_nationkey int, n_name string")


@query("SELECT * FROM region")
def as_records(t):
    return t("region").sparkSession.createDataFrame([tuple(r.values()) for r in ops.as_records(t("region"))], t("region").schema)


@query("SELECT * FROM region")
def fetch_all(t):
    return t("region").sparkSession.createDataFrame(ops.fetch_all(t("region")), t("region").schema)


@query("SELECT r_regionkey, r_name, 7 AS n_lines FROM region")
def pretty_print(t):
    out = io.StringIO()
    return ops.pretty_print(ops.sort(t("region"), "r_regionkey"), out).withColumn("n_lines", F.lit(out.getvalue().count("\n") - 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(tables(spark, sf_dir))

    return {name: bound(fn) for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
