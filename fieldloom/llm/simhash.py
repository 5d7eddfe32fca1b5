"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed in Arrow batches: the XXH64 values of a text's shingles, and of each bit
whether more than half of them set it.

Two fingerprints link if at most ``RADIUS`` (4) of 64 bits differ. Then at most two differ in one of
the halves, and the balls of one bit around both halves meet: each distinct fingerprint is listed
under every value within one bit of its high half, and of its low half, 33 keys each. Keys are 32
bits wide, so a table of a billion fingerprints still meets few strangers, and complete distances
settle the rest. Members of one key are searched for links inside a task, which writes a spanning
forest of them, never all pairs.

A key with more than ``CROWD`` members would make that search long. Fingerprints of such keys are
listed again under all 2081 values within two bits of the whole; any two that share one differ in 4
bits at most, and any two that differ in 4 share one. So there each key is a star of links, without
any search, in work proportional to the fingerprints.

Components come from rounds of label exchange and pointer jumps over staged tables; the driver sees
counts alone. Null and blank texts have fingerprint zero, which links like any other. Copies share
a fingerprint, so groups of copies collapse before anything is compared. Rows may repeat. Extra
columns are ignored by ``components`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SHINGLE, SEED, RADIUS, CROWD = 4, 42, 4, 512
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | bytes | None) -> int:
    """As a signed long."""
    data = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not data:
        return 0
    n = max(1, len(data) - SHINGLE + 1)
    line, ends = b" ".join(data), np.cumsum(np.fromiter((len(w) + 1 for w in data), np.int64, len(data)))
    starts = np.concatenate([[0], ends[:-1]])
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, ``f`` and the longs of ``more``."""
    names = ["doc_id", "f", *more]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = pa.array((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), found, *b.columns[2:]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    also = [v.alias(k) for k, v in more.items()]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *also).mapInArrow(batches, ", ".join([f"doc_id {kind}, f bigint", *[f"{k} bigint" for k in more]]))


def _half_keys(prints: DataFrame) -> DataFrame:
    """(key, f): 33 values around each half; the low half's keys are marked by a sign that high halves never have."""
    near = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    df = prints.select("f", F.explode(F.lit([0, 1]).cast("array<int>")).alias("half"))
    df = df.select("f", F.when(F.col("half") == 0, F.shiftrightunsigned("f", 32)).otherwise(F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))).alias("v"), "half")
    df = df.select("f", "half", "v", F.explode(near).alias("x"))
    return df.select(F.when(F.col("half") == 0, F.col("v").bitwiseXOR(F.col("x"))).otherwise(-1 - F.col("v").bitwiseXOR(F.col("x"))).alias("key"), "f")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of ``values`` under the radius."""
    values, links = np.unique(values), []
    left, front = values, values[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        apart = np.bitwise_count((left[:, None] ^ front[None, :]).view(np.uint64)) <= RADIUS
        hit = apart.any(axis=1)
        links += zip(left[hit].tolist(), front[apart[hit].argmax(axis=1)].tolist(), strict=True)
        front, left = left[hit], left[~hit]
    return links


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: links that connect what is linked, from a staged table of distinct ``f``."""
    keys = _half_keys(prints)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("low"), F.max("f").alias("high")).filter("n > 1")
    met = shared.stage(sizes, "simhash-keys")
    few = met.filter(F.col("n") == 2).select(F.col("low").alias("a"), F.col("high").alias("b"))
    few = few.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    more = met.filter(F.col("n") > 2).select(F.col("key").alias("__key"), "n")
    members = shared.stage(keys.join(shared.sized(more), F.col("key") == F.col("__key")).select("key", "n", "f"), "simhash-members")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [x for v in b.column(0) for x in forest(v.values.to_numpy())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    small = members.filter(F.col("n") <= CROWD).groupBy("key").agg(F.collect_list("f").alias("all")).select("all").mapInArrow(search, "a bigint, b bigint")
    crowd = members.filter(F.col("n") > CROWD).select("f").distinct()
    masks = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i in range(64) for j in range(i)]]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    around = crowd.select("f", F.explode(F.from_json(F.lit(str(signed)), "array<bigint>")).alias("x")).select("f", F.col("f").bitwiseXOR(F.col("x")).alias("key"))
    star = around.groupBy("key").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a")
    star = around.join(star, "key").select("a", F.col("f").alias("b"))
    both = few.unionAll(small).unionAll(star).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(f, root): the smallest member of each component, of every value that ``edges`` (a, b) name.

    A round gives each value the smallest label among its neighbours and its own, then the label of
    that label. Labels only sink; a round that changes none is the last.
    """
    edges = shared.stage(edges.select("a", "b"), "links")
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = shared.stage(both.groupBy(F.col("a").alias("f")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    for _ in range(rounds):
        other = labels.withColumnsRenamed({"f": "v", "root": "r"})
        seen = both.join(other, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("r").alias("r"))
        low = labels.join(seen, F.col("f") == F.col("v")).select("f", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        low = shared.stage(low, "labels")
        jump = low.select(F.col("f").alias("v"), F.col("root").alias("r"))
        new = low.join(jump, F.col("root") == F.col("v"), "left").select("f", "old", F.least("root", F.coalesce("r", "root")).alias("root"))
        new = shared.stage(new, "labels")
        labels = new.select("f", "root")
        if new.filter("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, f, ``more``), and staged (f, component, root): the smallest doc_id and fingerprint that each one reaches."""
    rows = shared.stage(fingerprints(docs, **more), "simhash")
    prints = shared.stage(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = shared.stage(links(prints.select("f")), "simhash-links")
    if found.isEmpty():
        return rows, shared.stage(prints.select(F.col("f").alias("__f"), F.col("first").alias("component_id"), F.col("f").alias("root")), "simhash-classes")
    roots = connected(found).withColumnsRenamed({"f": "v"})
    placed = shared.stage(prints.join(roots, F.col("f") == F.col("v"), "left").select("f", "first", F.coalesce("root", "f").alias("root")), "simhash-roots")
    lowest = shared.stage(placed.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r"), "simhash-lowest")
    return rows, shared.stage(placed.join(lowest, F.col("root") == F.col("r")).select(F.col("f").alias("__f"), "component_id", "root"), "simhash-classes")


def components(docs: DataFrame) -> DataFrame:
    rows, placed = classes(docs)
    return rows.join(placed, F.col("f") == F.col("__f")).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """A row of each component with its smallest doc_id, with its columns. Null doc_ids stay.

    Where rows of one component share that doc_id, the text and then the row with the smallest hash
    stays; a doc_id is kept twice where its texts belong to two components.
    """
    found, placed = classes(docs.filter("doc_id IS NOT NULL"), h=F.xxhash64("text"))
    first = found.join(placed, (F.col("f") == F.col("__f")) & (F.col("doc_id") == F.col("component_id")))
    first = first.groupBy(F.col("doc_id").alias("__id"), "root", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("__id", "root").agg(F.min(F.struct("h", "n")).alias("x"))
    first = shared.stage(first.select("__id", F.col("x.h").alias("__h"), F.col("x.n").alias("__n")), "simhash-first")
    rows = shared.whole_row(docs).withColumn("__key", F.col("__row.doc_id")).withColumn("__text", F.xxhash64("__row.text"))
    kept = rows.join(shared.sized(first, 96), (F.col("__key") == F.col("__id")) & (F.col("__text") == F.col("__h")))
    if not first.filter("__n > 1").isEmpty():  # rows with one text and one id: these alone meet in a shuffle
        again = kept.filter("__n > 1").groupBy("__key", "__text").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
        kept = kept.filter("__n = 1").select("__row").unionAll(again.select("__row"))
    return shared.unpacked(kept.select("__row").unionAll(rows.filter("__key IS NULL").select("__row")), docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    return components(docs)
