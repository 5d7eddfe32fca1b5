"""Benchmark decontamination by winnowing.

Both sides are cut to words; every run of ``K`` words has a hash, and of every ``SPAN - K + 1``
neighbouring hashes the smallest (the first of equals) is a fingerprint. A span of ``SPAN`` words
that both sides share therefore has a fingerprint that both keep. Fingerprints of documents meet
those of the benchmark by hash; each hit is extended to both sides, word by word, and counts if
``SPAN`` words or more agree. So hash collisions drop out, and what is left is every shared window.

Items shorter than ``SPAN`` have no window of that length and are one window each: for each such
length in the benchmark (at most ``SPAN - 1`` of them) the runs of documents are hashed, too.

Documents are screened first: in one scan all their hashes are held against those of the benchmark,
and only documents that have one of them go on. That loses nothing, as every hit needs a common hash,
and it is the same at every size of the benchmark: its hashes are broadcast as far as they fit into
``shared.BROADCAST_BYTES`` and joined by a shuffle of (document, hash) beyond. Items' words are joined
to hits by item, so no broadcast holds a word more than once.

Null and blank texts have no words and are clean. Rows that repeat a doc_id are told apart by their
text, and full repeats are counted. Null item_ids hit words but are named by no digest. Long texts
cost in proportion to their words. An empty table gives no rows, an empty benchmark no hits. Columns
beyond doc_id and text are kept by ``clean`` and otherwise ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

K, SPAN = 5, 13


def _runs(hashes: Column, width: int) -> Column:
    """Hash of each run of ``width`` words."""
    each = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, width)]))
    return F.slice(each, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))


def _chosen(runs: Column, window: int) -> Column:
    """Places of the smallest hash of every window, the first of equals."""
    starts = F.when(F.size(runs) >= window, F.sequence(F.lit(0), F.size(runs) - window)).otherwise(shared.nothing("array<int>"))
    place = lambda i: shared.let(F.slice(runs, i + 1, window), lambda s: (i + F.array_position(s, F.array_min(s)) - 1).cast("int"))
    return F.array_distinct(F.transform(starts, place))


def _words() -> Column:
    return shared.words(shared.ascii_lower(F.col("text")), shared.WORD)


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes of words in lower case, beside the text. Hashes may fold letters beyond ASCII; words themselves are compared later.

    A capital sigma is folded first, as its lower case otherwise depends on what stands behind the word.
    """
    low = F.lower(F.replace("text", F.lit("\u03a3"), F.lit("\u03c3")))
    return df.select(*keys, "text", F.transform(shared.words(low, shared.WORD), lambda x: F.xxhash64(x)).alias("h"))


def fingerprints(df: DataFrame, keys: list[str], k: int = K, span: int = SPAN) -> DataFrame:
    """A row for each fingerprint: keys, words, place and hash, or one row with nulls.

    The outer explode keeps the optimizer from testing arrays for size below the projections that
    build them.
    """
    df = _hashed(df, keys).select(*keys, "text", _runs(F.col("h"), k).alias("g"))
    df = df.select(*keys, _words().alias("w"), "g", _chosen(F.col("g"), span - k + 1).alias("at"))
    return df.select(*keys, "w", "g", F.explode_outer("at").alias("p")).select(*keys, "w", "p", F.get("g", F.col("p")).alias("f"))


def all_runs(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """A row for each run of ``width`` words."""
    df = _hashed(df, keys).select(*keys, _words().alias("w"), _runs(F.col("h"), width).alias("g"))
    return df.select(*keys, "w", F.posexplode_outer("g").alias("p", "f"))


def screened(docs: DataFrame, keys: list[str], hashes: DataFrame, widths: list[int]) -> DataFrame:
    """A staged row for each (keys): n_words, how many rows have them, and whether a run of one of ``widths`` words has one of the staged ``hashes`` (__f)."""
    df = _hashed(docs, keys).select(*keys, F.greatest(F.coalesce(F.size("h"), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.concat(*[_runs(F.col("h"), n) for n in widths]).alias("g"))
    df = df.select(*keys, "n", F.posexplode_outer("g").alias("p", "f"))
    df = df.join(shared.sized(hashes), F.col("f") == F.col("__f"), "left")
    made = [F.max("n").alias("n_words"), F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("rows"), (F.count("__f") > 0).alias("hit")]
    return shared.stage(df.groupBy(*keys).agg(*made), "bench-screened")


def _agree(step: int, most: int, p: Column, q: Column) -> Column:
    """Neighbouring words that agree, from the places p and q on, in one direction."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, t: F.when((n == t - 1) & F.coalesce(F.get("w", p + step * t) == F.get("__w", q + step * t), F.lit(False)), t).otherwise(n)
    )


def extended(hits: DataFrame, keys: list[str], k: int = K, span: int = SPAN) -> DataFrame:
    """Hits as (keys, item, s, e): the words from s up to e agree, and they are ``span`` or more."""
    p, q = F.col("p"), F.col("__q")
    hits = hits.filter(F.slice("w", p + 1, k) == F.slice("__w", q + 1, k))
    hits = hits.select(*keys, "__item", (p - _agree(-1, span - k, p, q)).alias("s"), (p + k + _agree(1, span - k, p + (k - 1), q + (k - 1))).alias("e"))
    return hits.filter(F.col("e") - F.col("s") >= span)


def _equal(keys: list[str], other: str = "__") -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])


def _met(found: DataFrame, prints: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, w, p, f) of documents that share a hash with the staged ``prints``, with the place there and the item's words.

    Null hashes meet nothing. They aren't filtered: from such a filter the optimizer infers one on the arrays
    below, and works these out anew for each element.
    """
    met = found.join(shared.sized(prints), F.col("f") == F.col("__f"))
    size = items.agg(F.sum(F.octet_length("text") * 3 + 64).alias("n")).first()["n"] or 0  # words as an array take some bytes each
    words = items.select(F.col("__n").alias("__m"), "__item", _words().alias("__w"))
    return met.join(F.broadcast(words) if size <= shared.BROADCAST_BYTES else words, F.col("__n") == F.col("__m"))


def hits(docs: DataFrame, benchmark: DataFrame, k: int = K, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Of all documents (doc_id, __t, n_words, rows); of those with hits (doc_id, __t, n_hit, n_items, items_sha256, whole), where ``whole`` says that ``span`` words in a row are hit.

    ``__t`` is a hash of the text; a row stands for ``rows`` equal ones.
    """
    keys = ["doc_id", "__t"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("__t"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("__item"), F.col("text").cast("string").alias("text")).filter(F.size(_words()) > 0)
    items = shared.stage(items.withColumn("__n", F.xxhash64("__item", "text")), "bench-items")
    narrow = lambda df, p: df.select("__n", p.alias("__q"), F.col("f").alias("__f")).distinct()
    sizes = sorted(r["n"] for r in items.select(F.size(_words()).alias("n")).filter(F.col("n") < span).distinct().collect())
    prints = {span: shared.stage(narrow(fingerprints(items, ["__n"], k, span), F.col("p")), "bench-prints")}
    for n in sizes:
        prints[n] = shared.stage(narrow(all_runs(items, ["__n"], n).filter(F.size("w") == n), F.lit(0)), "bench-short")
    hashes = shared.stage(reduce(DataFrame.unionAll, [x.select("__f") for x in prints.values()]).distinct(), "bench-hashes")
    every = screened(docs, keys, hashes, [k, *sizes])
    some = shared.stage(every.filter("hit").select(*[F.col(c).alias(f"__{c}") for c in keys]), "bench-some")
    some = docs.join(shared.sized(some), _equal(keys), "left_semi").dropDuplicates(keys) if _repeated(every) else docs.join(shared.sized(some), _equal(keys), "left_semi")
    some = shared.stage(some, "bench-texts")
    parts = [extended(_met(fingerprints(some, keys, k, span), prints[span], items, keys), keys, k, span)]
    for n in sizes:
        met = _met(all_runs(some, keys, n), prints[n], items, keys)
        parts.append(met.filter(F.slice("w", F.col("p") + 1, n) == F.col("__w")).select(*keys, "__item", F.col("p").alias("s"), (F.col("p") + n).alias("e")))
    found = reduce(DataFrame.unionAll, parts)
    by = found.groupBy(*keys).agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.array_sort(F.collect_set("__item")).alias("items"), F.max(F.col("e") - F.col("s") >= span).alias("whole"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc.to, x.e).alias("to"), (acc.n + F.greatest(x.e - F.greatest(x.s, acc.to), F.lit(0))).alias("n"))
    n_hit = F.aggregate(F.array_sort("spans"), start, step, lambda acc: acc.n)
    by = by.select(*keys, n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "whole")
    return every.select(*keys, "n_words", "rows"), shared.stage(by, "bench-hits")


def _repeated(every: DataFrame) -> bool:
    return not every.filter("hit AND rows > 1").isEmpty()


def _is_bad() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    every, found = hits(docs, benchmark)
    found = found.withColumnsRenamed({"doc_id": "__doc_id", "__t": "____t"})
    df = every.join(shared.sized(found, 160), _equal(["doc_id", "__t"]), "left")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    df = df.withColumns({k: F.coalesce(k, v) for k, v in none.items()}).withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return df.select("doc_id", "n_words", *none, _is_bad().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without hits of ``SPAN`` words in a row, however long they are, and with less than 5 % of their words in hits of short items."""
    every, found = hits(docs, benchmark)
    found = found.withColumnsRenamed({"doc_id": "__doc_id", "__t": "____t"})
    bad = every.join(shared.sized(found, 160), _equal(["doc_id", "__t"])).filter(_is_bad() | F.col("whole"))
    bad = shared.stage(bad.select(F.col("doc_id").alias("__doc_id"), F.col("__t").alias("____t")), "bench-bad")
    rows = shared.whole_row(docs).select("__row", F.col("__row.doc_id").alias("doc_id"), F.xxhash64("__row.text").alias("__t"))
    return shared.unpacked(rows.join(shared.sized(bad), _equal(["doc_id", "__t"]), "left_anti"), docs.columns)


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark)
