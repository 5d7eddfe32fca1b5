"""What the operators of this subpackage share: word patterns, staged tables, spans, ranks.

Word patterns are written for Java's regular expressions, where ``(?i)`` folds A-Z alone, so they
need no lower-cased copy of a text.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words parted by ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters, digits and everything beyond ASCII, in a text whose A-Z may be upper-case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the folders that were named inside; a path taken out of the list stays."""
    _scopes.append(paths := [])
    try:
        yield paths
    finally:
        _scopes.remove(paths)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column, pattern: str = SPACED) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case; texts that are all ASCII take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def nothing(kind: str) -> Column:
    return F.array().cast(kind)


SPANS = "array<struct<s:int,e:int,m:string>>"


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost matches of ``pattern`` that do not overlap: start and end in code points, and the match.

    Texts that ``gate`` or the pattern itself rules out build no arrays.
    """
    found = F.zip_with(
        F.split(text, pattern, -1), words(text, pattern), lambda before, hit: F.struct(F.length(before).alias("b"), F.length(hit).alias("n"), hit.alias("m"))
    )
    start = F.struct(F.lit(0).alias("at"), nothing(SPANS).alias("got"))
    placed = F.aggregate(
        F.filter(found, lambda x: x.m.isNotNull()),
        start,
        lambda acc, x: F.struct(
            (acc.at + x.b + x.n).alias("at"),
            F.concat(acc.got, F.array(F.struct((acc.at + x.b).alias("s"), (acc.at + x.b + x.n).alias("e"), x.m.alias("m")))).alias("got"),
        ),
        lambda acc: acc.got,
    )
    test = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(test, placed).otherwise(nothing(SPANS))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of numbers that the driver holds, as a relation inside the JVM; the caller bounds their count."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    if len(rows) > 1000:
        return spark.createDataFrame(rows, schema.replace(", ", ",").replace(" ", ":"))
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    if not rows:
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} WHERE false")
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(names)})")


def bins_for(n_rows: int, per_bin: int, most: int = 1 << 20) -> int:
    """A power of two of bins, with about ``per_bin`` rows in each."""
    bins = 1
    while bins * per_bin < n_rows and bins < most:
        bins *= 2
    return bins


def prefix_by_hash(df: DataFrame, group: str, key: str, weight: str, tie: list[str], bins: int, out: str, spread: int = 1) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of ``group`` that stand before this one by (``key``, ``tie``).

    ``key`` is a hash spread evenly over the non-negative longs, so cutting its range into ``bins``
    equal parts sorts a group by range without sampling: each part is summed beside its rows, and
    only (group, bin) sums are added up across parts. No task holds a group, and equal keys with
    equal ties get some fixed order.
    """
    from pyspark.sql import Window as W

    shift = 63 - (bins.bit_length() - 1)
    binned = df.withColumn("__bin", F.shiftright(key, shift).cast("int") if bins > 1 else F.lit(0))
    sums = binned.groupBy(group, "__bin").agg(F.sum(weight).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.partitionBy(group).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = stage(sums.select(F.col(group).alias("__g"), F.col("__bin").alias("__b"), "__before"), "prefix")
    within = W.partitionBy(group, "__bin").orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    ranked = binned.withColumn("__within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    joined = ranked.join(sums, ranked[group].eqNullSafe(sums["__g"]) & (ranked["__bin"] == sums["__b"]), "left")
    return joined.withColumn(out, F.col("__within") + F.col("__before")).drop("__g", "__b", "__bin", "__within", "__before")


#: Bytes up to which a staged side is broadcast; beyond them the join shuffles.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, width: int) -> bool:
    """Whether a staged table of rows of at most ``width`` bytes may be broadcast; it is counted."""
    return df.count() * width <= BROADCAST_BYTES


def sized(df: DataFrame, width: int = 64) -> DataFrame:
    """A staged table, marked for broadcast only if it was counted and is small."""
    return F.broadcast(df) if is_small(df, width) else df


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for a, b in keys.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def whole_row(df: DataFrame) -> DataFrame:
    """Every column inside one struct ``__row``, so that no name can clash with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])


def settled(df: DataFrame, test: Column) -> DataFrame:
    """``df.filter(test)`` after the columns of ``df`` are computed.

    A filter otherwise moves below the projections it reads and repeats their work, once for each
    mention; a projection that isn't deterministic holds it back.
    """
    return df.withColumn("__here", F.spark_partition_id()).filter(test & (F.col("__here") >= 0)).drop("__here")
