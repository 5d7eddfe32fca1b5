"""Quality rules: log-likelihood ratio of hashed word n-grams, trusted texts against the whole corpus.

Words and word pairs of a text fall into ``BUCKETS`` buckets by hash. Two smoothed multinomials over
buckets are estimated: one from trusted documents (quality 1, not toxic), one from every document.
A text scores the mean, over its n-grams, of the log ratio of the two. Every document is then held
against one threshold: where the scores of labelled good and bad documents, each taken as normal,
lie equally many deviations away. At least ``FLOOR`` deviations below the good mean are kept, so
that few good documents fall, and without bad labels that floor alone is the threshold.

Labels may be as many as documents, so the ``TRUSTED`` labelled documents with the smallest hashes
are used: the trusted target is counted on one half of them and the threshold is set on the other,
whose words the target hasn't seen, as it hasn't seen those of unlabelled documents. Of that half only texts that
pass the base rules count, as the others are rejected anyway. The corpus multinomial counts every
document. The table of ratios has ``BUCKETS`` numbers, whatever the corpus; it is one row of a staged table and enters
the scoring scan as the value of a scalar subquery: documents are never joined, shuffled or collected. Ratios are
whole multiples of 10^-9, so sums don't depend on their order and verdicts are the same in each run.

Null and blank texts have no words and fail the base rules. Without labels no text can be trusted:
all ratios are 0 and the base rules alone decide. Repeated rows get equal verdicts. A text of one
word has one n-gram. Extra columns are kept by ``keep`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BUCKETS, TRUSTED, FLOOR = 1 << 16, 20_000, 3.0
#: Log ratios are whole parts of this size.
UNIT = 10**9
MIN_WORDS = 50


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column, use) -> Column:
    """``use`` of each hash and the next one; the last has null beside it."""
    return F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), use)


def ngram_hashes(hashes: Column) -> Column:
    """Hashes of all words and of all pairs of neighbours; the last word pairs with null."""
    return F.concat(hashes, _pairs(hashes, lambda a, b: F.xxhash64(a, b)))


def labelled(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """``most`` labelled ids by hash; of ids with several labels the worst one counts."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0))
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(good.alias("__good"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(most).withColumn("__fit", F.xxhash64(F.lit(1), F.col("__id")) % 2 == 0)


def log_ratios(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One staged row with an array: for each bucket log P(bucket | trusted) - log P(bucket | corpus), with add-one smoothing, in ``1 / UNIT``.

    One task gathers ``buckets`` sums, a number that is fixed before any data are read.
    """
    flat = docs.select("doc_id", F.col("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"), "left")
    flat = flat.select(F.when(F.col("__fit"), F.col("__good")).otherwise(0).alias("good"), word_hashes(shared.words(F.col("text"))).alias("h"))
    flat = flat.select("good", ngram_hashes(F.col("h")).alias("g")).select("good", F.explode_outer("g").alias("g")).select("good", F.pmod("g", F.lit(buckets)).cast("int").alias("bucket"))
    counts = shared.stage(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).filter("bucket IS NOT NULL"), "quality-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = lambda c, of: F.log((F.coalesce(c, F.lit(0)) + 1).cast("double")) - math.log(of + buckets)
    ratio = share(F.col("good"), total["good"]) - share(F.col("n"), total["n"]) if total["good"] else F.lit(0.0)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, F.col("b") == F.col("bucket"), "left")
    every = every.select("b", F.round(ratio * UNIT).cast("long").alias("v"))
    return shared.stage(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x.v).alias("ratios")), "quality-ratios")


def score(hashes: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Mean log ratio over words and pairs of neighbours, from the column of word hashes; null without words."""
    at = lambda x: F.get(table, F.pmod(x, F.lit(buckets)).cast("int"))
    each = _pairs(hashes, lambda a, b: at(a) + at(F.xxhash64(a, b)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, x: acc + x) / F.nullif(2.0 * UNIT * F.size(hashes), F.lit(0.0))


def threshold(scored: DataFrame) -> float:
    """From (__good, score) of labelled texts; minus infinity without good ones."""
    by = {r["__good"]: r for r in scored.groupBy("__good").agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("d")).collect()}
    by = {k: r for k, r in by.items() if r["n"]}
    if 1 not in by:
        return float("-inf")
    good, bad = by[1], by.get(0)
    floor = good["m"] - FLOOR * good["d"]
    if bad is None or bad["m"] >= good["m"] or good["d"] + bad["d"] == 0:
        return round(floor, 9)
    return round(min(floor, (good["m"] * bad["d"] + bad["m"] * good["d"]) / (good["d"] + bad["d"])), 9)


def windows(hashes: Column) -> Column:
    """A hash of each 3-word window, in order, from the column of word hashes."""
    return F.slice(F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))), 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def repeated_words(hashes: Column, ordered: Column) -> Column:
    """Words inside windows that a text holds twice or more, from the columns of window hashes, as they stand and sorted.

    Windows are compared by a 64-bit hash within one text. The sorted hashes show which ones repeat;
    texts with few of them look each window up, others sort the windows with their places, so that
    the work is never the square of the text.
    """

    def count(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n"))
        return F.aggregate(F.filter(places, lambda x: x.isNotNull()), start, step, lambda acc: acc.n)

    def looked_up(twice: Column) -> Column:
        return count(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)))

    def sorted_places() -> Column:
        both = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
        kept = shared.let(both, lambda s: F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x.i)))
        return count(F.array_sort(F.filter(kept, lambda x: x.isNotNull())))

    twice = F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1)))
    return shared.let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= 32, looked_up(t)).otherwise(sorted_places()))


def base(text: Column, words: Column, hashes: Column, ordered: Column) -> dict[str, Column]:
    """The base counts, each a long; ``hashes`` and ``ordered`` are the columns of window hashes."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(shared.SPACED))
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
        "n_dup_lines": shared.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(hashes, ordered),
    }
    return {k: v.cast("long") for k, v in made.items()}


def measured(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The columns of ``rows`` but text, beside base counts, score and whether the base rules fail; ``table`` is the row of ratios."""
    names = [c for c in rows.columns if c != "text"]
    df = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", shared.words(F.col("text"))).withColumn("h", word_hashes(F.col("words")))
    df = df.withColumn("w", windows(F.col("h"))).withColumn("s", F.sort_array("w")).withColumn("table", table.scalar())
    counts = base(F.col("text"), F.col("words"), F.col("w"), F.col("s"))
    df = df.select(*names, *[v.alias(k) for k, v in counts.items()], score(F.col("h"), F.col("table")).alias("score"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The row of log ratios, and the threshold."""
    sample = shared.stage(labelled(labels), "quality-sample")
    table = log_ratios(docs, sample)
    held = docs.select("doc_id", "text").join(F.broadcast(sample.filter("NOT __fit")), F.col("doc_id") == F.col("__id")).select("__good", "text")
    held = shared.stage(shared.settled(measured(held, table), F.lit(True)).select("__good", "score", "base_failed"), "quality-held")
    return table, threshold(held.filter("NOT base_failed"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``__row``, beside their base counts, score and verdict."""
    table, least = fitted(docs, labels)
    df = measured(shared.whole_row(docs).withColumn("text", F.col("__row.text")), table)
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(least), F.lit(True)))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    return shared.unpacked(shared.settled(judged(docs, labels), F.col("kept")), docs.columns)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.settled(judged(docs, labels), F.lit(True)).select(F.col("__row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
