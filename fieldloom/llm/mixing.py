"""Mixing of sources to target weights: hash-random keys, range order in each source, prefix sums, exact cuts.

Every document gets a hash of its id as random key. Sorted by key, a source is one epoch. A
source's budget is so many whole epochs and a rest; documents that the rest reaches are taken once
more, and the one in which it ends is cut at the exact word. The order inside a source comes from
``prefix_by_hash``: sums by hash range, added up across ranges, so no task holds a source.

Null texts have size 0. Rows that repeat a doc_id each count as a document of their own. Null
sources are one source, the last. An empty table gives an empty result. Columns beside doc_id,
text and source are kept by ``mix`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most epochs of a source.
SHARE, EPOCHS = 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.SPACED)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """Non-negative, spread evenly, the same in each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """From (source, source_size): ``target`` words of each source.

    Filling by weight with a cap gives min(epochs * size, level * weight) with one common level.
    Ordered by size over weight, the capped sources come first; the level is the first one that
    the source after them doesn't reach. The windows hold a row for each source, none for documents.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, after, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    reached = F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.row_number().over(by_ratio).alias("rank"), "level"))
    ranked = ranked.withColumn("reached", reached).withColumn("level", F.min("reached").over(everything).getField("level"))
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def _placed(docs: DataFrame, seed: int = 42, rows_per_bin: int = 20_000, **how) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken, and its key, the words before it, the whole epochs of its source and the rest."""
    sized = shared.stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    found = shared.stage(found, "mix-sources")
    targets = shared.stage(source_targets(found.select("source", "source_size"), **how), "mix-targets")
    bins = max(256, shared.bins_for(sized.count(), rows_per_bin))
    keyed = sized.withColumn("__key", random_key(F.col("doc_id"), seed))
    placed = shared.prefix_by_hash(keyed, "source", "__key", "size", ["doc_id", "size"], bins, "__prefix")
    placed = placed.withColumnRenamed("source", "__source").join(targets, F.col("__source").eqNullSafe(F.col("source")), "left").drop("__source")
    budget = F.floor(F.col("target") + F.lit(0.5))
    turns = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - turns * F.col("source_size")
    partly = F.least(F.greatest(rest - F.col("__prefix"), F.lit(0)), F.col("size"))
    return placed.withColumn("taken", (turns * F.col("size") + partly).cast("long")).withColumn("__turns", turns).withColumn("__rest", rest)


def plan_mix(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, taken."""
    return _placed(docs, **how).drop("__key", "__prefix", "__turns", "__rest")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(shared.words(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The mixed corpus: each document as often as taken, the last copy cut at the word; columns of ``docs``.

    A source is cut in one place of its order: what lies before is taken once more, what lies behind
    isn't. So texts meet one row a source, the key where it is cut, and are never shuffled. Only rows
    that share the doc_id of the cut are numbered among themselves.
    """
    plan = shared.stage(_placed(docs, seed, **how).filter("size > 0").select("source", "__key", "size", "__prefix", "__turns", "__rest"), "mix-plan")
    last = F.max(F.when(F.col("__prefix") < F.col("__rest"), F.col("__key")))
    cuts = shared.stage(plan.groupBy("source").agg(F.max("__turns").alias("turns"), F.max("__rest").alias("rest"), last.alias("cut")), "mix-last")
    at = plan.select("source", "__key", "__prefix").join(shared.sized(cuts.select(F.col("source").alias("__s"), "cut"), 256), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("cut")))
    at = at.groupBy(F.col("source").alias("__s")).agg(F.min("__prefix").alias("base"), F.count(F.lit(1)).alias("n"))
    cuts = cuts.join(at, F.col("source").eqNullSafe(F.col("__s")), "left").select(F.col("source").alias("__source"), F.struct("turns", "rest", "cut", "base", "n").alias("__cut"))
    cuts = shared.stage(cuts, "mix-cuts")
    left = shared.whole_row(docs).withColumn("__key", random_key(F.col("__row.doc_id"), seed)).withColumn("__words", word_count(F.col("__row.text")))
    left = left.filter("__words > 0").join(shared.sized(cuts, 256), F.col("__row.source").cast("string").eqNullSafe(F.col("__source")))
    partly = lambda before: F.least(F.greatest(F.col("__cut.rest") - before, F.lit(0)), F.col("__words"))
    rest = F.when(F.col("__key") < F.col("__cut.cut"), F.col("__words")).when(F.col("__key") == F.col("__cut.cut"), partly(F.col("__cut.base"))).otherwise(F.lit(0))
    several = F.coalesce((F.col("__key") == F.col("__cut.cut")) & (F.col("__cut.n") > 1), F.lit(False))
    one = left.filter(~several).withColumn("__rest", rest)
    if not cuts.filter("__cut.n > 1").isEmpty():
        run = W.partitionBy("__source", "__key").orderBy("__words", F.xxhash64("__row.text")).rowsBetween(W.unboundedPreceding, -1)
        before = F.col("__cut.base") + F.coalesce(F.sum("__words").over(run), F.lit(0))
        one = one.unionByName(left.filter(several).withColumn("__rest", partly(before)))
    return _copies(one, docs)


def _copies(left: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each whole epoch, and one for the rest."""
    whole = F.col("__cut.turns") + F.when(F.col("__rest") == F.col("__words"), 1).otherwise(0)
    rest = F.when((F.col("__rest") > 0) & (F.col("__rest") < F.col("__words")), F.array(F.col("__rest").cast("long"))).otherwise(shared.nothing("array<bigint>"))
    out = left.select("__row", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), rest)).alias("__left"))
    text = F.when(F.col("__left") < 0, F.col("__row.text")).otherwise(first_words(F.col("__row.text"), F.col("__left")))
    out = out.withColumn("__text", text)
    made = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
