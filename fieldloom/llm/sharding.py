"""K-d tree sharding: leaves of near equal bytes, split at weighted medians of the widest dimension.

The dimensions are log size, doc_id, and the places of lang and source (by hash, so that equal
values stay together and no dictionary is needed). At each level every node takes the dimension in
which its rows spread furthest, measured against the whole table, and is split where the bytes left
of the cut match the share of leaves on that side. Three aggregates per level find the cut for all
nodes at once: sums by cell of the coordinate, sums by hash range inside the cell the median falls
in, and a running sum over the few rows of the last range. So the cut is exact to one document,
even if a third of all rows share a coordinate, and no task holds a node.

The driver holds one row a node, so it is bounded by the number of shards. Law of the result: ``bytes``.
Documents of equal text get no common shard, as a group of copies may be larger than one; the
order inside a cell is by a hash of id and text, so that a cut through many copies has few rows to sort.

Null texts weigh one byte, null doc_ids, langs and sources have places of their own, rows that
repeat a doc_id are told apart by their text, and full repeats by a running number. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

LAW, LEAVES = "bytes", 8
#: Cells of a coordinate and hash ranges inside a cell; with many nodes fewer, so that a level has at most ``SUMS`` sums.
CELLS, RANGES, SUMS = 4096, 4096, 1 << 24


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _dims(df: DataFrame) -> dict[str, Column]:
    dims = {"__d0": F.log(F.col("size").cast("double")), "__d1": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))}
    for c in ("lang", "source"):
        if c in df.columns:
            dims[f"__d{len(dims)}"] = F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 11).cast("double")
    return dims


def leaves_for(total: int, target: int) -> int:
    """Leaves of at most about ``target`` bytes."""
    return max(1, -(-total // target))


def shards(docs: DataFrame, leaves: int = LEAVES, target_bytes: int | None = None) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot."""
    text = F.col("text")
    crc = F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    had = [c for c in ("lang", "source") if c in docs.columns]
    df = docs.select("doc_id", text_size(text).alias("size"), crc.alias("text_crc32"), *had)
    df = df.select("doc_id", "size", "text_crc32", *[v.alias(k) for k, v in _dims(df).items()])
    df = df.withColumn("__h", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 1)).withColumn("__node", F.lit(0))
    df = shared.stage(df, "shard-rows")
    names = [c for c in df.columns if c.startswith("__d")]
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).first()
    if target_bytes:
        leaves = leaves_for(whole["size"] or 0, target_bytes)
    spread = {c: (whole[f"max{c}"] - whole[f"min{c}"]) or 1.0 for c in names} if whole["n"] else {}
    open_, next_id = {0: leaves}, 1  # node -> leaves below it
    while whole["n"] and any(n > 1 for n in open_.values()):
        df, cut = _split(df, {k: n for k, n in open_.items() if n > 1}, names, spread, next_id)
        after = {k: n for k, n in open_.items() if n == 1}
        for k, (left, right, a, b) in cut.items():
            after[left], after[right] = a, b
        next_id += 2 * len(cut)
        open_ = after
        df = shared.stage(df, "shard-level")
    order = sorted(open_)
    number = shared.small_table(docs.sparkSession, [(k, i) for i, k in enumerate(order)], "__k int, shard int")
    df = df.join(F.broadcast(number), F.col("__node") == F.col("__k")).withColumn("__one", F.lit(1))
    df = shared.prefix_by_hash(df, "shard", "__h", "__one", ["doc_id", "size"], max(256, shared.bins_for(whole["n"] or 0, 20_000)), "slot")
    return df.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def _split(df: DataFrame, nodes: dict[int, int], names: list[str], spread: dict[str, float], next_id: int) -> tuple[DataFrame, dict]:
    """Split each of ``nodes`` (node -> leaves); returns the rows with their new nodes, and the children."""
    spark = df.sparkSession
    found = df.groupBy("__node").agg(F.sum("size").alias("size"), *[f(c).alias(f"{f.__name__}{c}") for c in names for f in (F.min, F.max)]).collect()
    seen = {r["__node"]: r for r in found if r["__node"] in nodes}
    plan, cut, cells_ = [], {}, max(16, min(CELLS, SUMS // max(1, len(nodes))))
    for at, (k, n) in enumerate(sorted(nodes.items())):
        left, right, a = next_id + 2 * at, next_id + 2 * at + 1, (n + 1) // 2
        cut[k] = (left, right, a, n - a)
        if k in seen:
            r = seen[k]
            wide = max(range(len(names)), key=lambda i: ((r[f"max{names[i]}"] - r[f"min{names[i]}"]) / spread[names[i]], -i))
            low, high = r[f"min{names[wide]}"], r[f"max{names[wide]}"]
            plan.append((k, wide, low, cells_ / (high - low) if high > low else 0.0, r["size"] * a // n, left, right))
    table = shared.small_table(spark, plan, "__k int, __wide int, __low double, __scale double, __goal bigint, __left int, __right int")
    rows = df.join(F.broadcast(table), F.col("__node") == F.col("__k"), "left")
    place = F.element_at(F.array(*names), F.col("__wide") + 1)
    rows = rows.withColumn("__cell", F.least(F.floor((place - F.col("__low")) * F.col("__scale")), F.lit(cells_ - 1)).cast("int"))
    rows = rows.withColumn("__range", F.shiftright("__h", 63 - (RANGES.bit_length() - 1)).cast("int"))
    cells = _crossing(rows.filter(F.col("__k").isNotNull()).groupBy("__k", "__cell").agg(F.sum("size").alias("w"), F.first("__goal").alias("goal")), "__cell")
    first = shared.small_table(spark, cells, "__k1 int, __cell1 int, __goal1 bigint")
    rows = rows.join(F.broadcast(first), F.col("__k") == F.col("__k1"), "left")
    in_cell = F.col("__cell") == F.col("__cell1")
    ranges = _crossing(rows.filter(in_cell).groupBy("__k", "__range").agg(F.sum("size").alias("w"), F.first("__goal1").alias("goal")), "__range")
    second = shared.small_table(spark, ranges, "__k2 int, __range2 int, __goal2 bigint")
    rows = rows.join(F.broadcast(second), F.col("__k") == F.col("__k2"), "left")
    last = in_cell & (F.col("__range") == F.col("__range2"))
    tie = ["__h", "doc_id", "size"]
    few = rows.filter(last).withColumn("__run", F.sum("size").over(W.partitionBy("__k", "__range").orderBy(*tie).rowsBetween(W.unboundedPreceding, 0)))
    few = few.withColumn("__goes", F.when(F.col("__run") - F.col("size") / 2 <= F.col("__goal2"), F.col("__left")).otherwise(F.col("__right")))
    side = F.when(F.col("__cell") != F.col("__cell1"), F.col("__cell") < F.col("__cell1")).otherwise(F.col("__range") < F.col("__range2"))
    rest = rows.filter(F.coalesce(~last, F.lit(True))).withColumn("__goes", F.when(F.col("__k").isNull(), F.col("__node")).when(side, F.col("__left")).otherwise(F.col("__right")))
    out = [c for c in df.columns if c != "__node"] + [F.col("__goes").alias("__node")]
    return rest.select(*out).unionAll(few.select(*out)), cut


def _crossing(sums: DataFrame, part: str) -> list[tuple[int, int, int]]:
    """For each node the part in which its running sum meets the goal, and what of the goal is left there."""
    run = W.partitionBy("__k").orderBy(part).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("run", F.sum("w").over(run))
    met = sums.filter(F.col("run") >= F.col("goal")).groupBy("__k").agg(F.min(F.struct(F.col(part).alias("p"), "run", "w", "goal")).alias("x"))
    return [(r["__k"], r["x"]["p"], r["x"]["goal"] - (r["x"]["run"] - r["x"]["w"])) for r in met.collect()]


def op8(docs: DataFrame) -> DataFrame:
    got = shards(docs)
    return got.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
