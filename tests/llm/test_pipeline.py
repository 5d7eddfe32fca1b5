"""The stages of the pipeline, each on what the one before kept, against the operators that tests hold against brute force."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import decontaminate, mixing, quality, sharding, shared, simhash

SPACED = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    """With nulls, repeated rows, repeated ids, a benchmark passage in a long text, a very long text, and columns whose names stages use."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = [r["text"] for r in df.filter("lang = 'en' AND n_chars > 2000").orderBy("doc_id").limit(3).collect()]
    extra = [(None, None, None, None, None), (None, clean[0], "en", None, 1), (800001, None, None, None, 0), (800002, "", "en", "s", 0), (800003, clean[1], "en", "s", 1), (800003, clean[1], "en", "s", 1), (800003, clean[2], "en", "t", 2)]
    extra += [(800004, clean[2] + " " + passage + " " + clean[0], "en", "s", 3), (800005, " ".join(clean * 60), "en", None, 4)]
    df = df.unionAll(spark.createDataFrame(extra, df.schema))
    return df.withColumns({"score": F.lit("x"), "f": F.lit(0), "__t": F.lit(1), "size": F.lit(2), "__row": F.lit(3), "kept": F.lit(True)}).repartition(4).cache()


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def lowest_ids(prints):
    """The smallest doc_id of each component of (doc_id, fingerprint), from all pairs of fingerprints."""
    lowest, root = {}, {}
    for i, f in prints:
        lowest[f] = min(i, lowest.get(f, i))
        root[f] = f

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(lowest, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    by = {}
    for f, i in lowest.items():
        by[find(f)] = min(i, by.get(find(f), i))
    return Counter(by.values())


def test_stages(spark, sf, docs):
    stages, columns = [f for _, f in corpus_pipeline.STAGES], docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")

    def run(k, df):
        out = shared.stage(stages[k](spark, df, sf), "test")
        assert k == 4 or out.columns == columns
        return out

    good = run(0, docs)
    assert ids(good) == ids(quality.op3(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept"))
    single = run(1, good)
    named = good.filter("doc_id IS NOT NULL")
    assert ids(single) == lowest_ids([(r["doc_id"], int(r["fingerprint"], 16)) for r in simhash.op4(named).collect()]) + Counter([None] * ids(good)[None])
    assert len([1 for r in single.collect() if r["doc_id"] == 800003]) <= 2
    clean = run(2, single)
    hit = {r["doc_id"] for r in decontaminate.op10(single, bench).filter("n_hit > 0").collect()}
    assert ids(clean) == Counter({i: n for i, n in ids(single).items() if i not in hit}) and 800004 not in ids(clean)
    mixed = run(3, clean)
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(SPACED, r["text"]))
    want = Counter()
    for r in mixing.op6(clean).collect():
        want[r["doc_id"]] += r["taken"]
    assert words == +want
    last = run(4, mixed)
    assert ids(last) == ids(mixed) and sorted(map(tuple, last.collect()), key=repr) == sorted(map(tuple, sharding.op8(mixed).collect()), key=repr)


def test_run_leaves_only_its_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {r["shard"] for r in got.collect()} == set(range(8))


def test_empty_table(spark, sf, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
        assert none.count() == 0
        if "shard" in none.columns:
            break
