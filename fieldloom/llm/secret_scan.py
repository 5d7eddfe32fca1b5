"""Secret scans over an incremental blob ledger.

A version of a file is addressed by the SHA-256 of its content. The ledger holds, for each blob and
rule version, what was found (nothing, too). A scan keeps one text of each blob, drops the pairs
that the ledger has, runs the rules over the rest alone, appends them to the ledger, and joins
findings back to every path by blob. A second scan with the same rules reads no unseen text.

One text per blob comes from a map-side aggregate, so thousands of copies leave each task once. The
join back carries hashes and digests, no texts; its two sides are plain tables, so that a blob with
a third of all paths is split.

Null texts are the empty blob. Paths may repeat. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: expression, gate, and the test of a match.
BASE = {
    "assign": (ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    "access": (r"AKIA[A-Z0-9]+", None, lambda m: F.length(m) >= 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", None, None),
}
#: Kinds that the rules add.
MORE = {
    "github": (r"\bgh[pousr]_[A-Za-z0-9]{36,}+", None, None),
    "slack": (r"\bxox[abeprs]-[A-Za-z0-9-]{10,}+", None, None),
    "google": (r"\bAIza[A-Za-z0-9_-]{35}", None, None),
    "stripe": (r"\b[rs]k_live_[A-Za-z0-9]{16,}+", None, None),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", None, None),
    "pem": (r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----", None, None),
    "userinfo": (r"\b[a-z]{3,10}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", None, None),
}


#: Changes with the rules, so that a ledger of other rules is never taken for one of these.
RULE_VERSION = hashlib.sha256(repr([(k, r[0], r[1], inspect.getsource(r[2]) if r[2] else None) for k, r in {**BASE, **MORE}.items()]).encode()).hexdigest()[:16]


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def kept_spans(text: Column, rule: tuple, kind: str, rank: int) -> Column:
    pattern, gate, test = rule
    found = shared.spans(text, pattern, None if gate is None else text.rlike(gate))
    if test is not None:
        found = F.filter(found, lambda x: test(x.m))
    return F.transform(found, lambda x: F.struct(x.s.alias("s"), F.lit(rank).alias("k"), x.e.alias("e"), F.lit(kind).alias("kind")))


def joined(found: Column) -> Column:
    """kind:start:end, by start, then kind."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def search(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text)."""
    kinds = {**BASE, **MORE}
    df = blobs.select("blob", *[kept_spans(F.col("text"), rule, kind, i).alias(f"__{kind}") for i, (kind, rule) in enumerate(kinds.items())])
    base = F.concat(*[F.col(f"__{k}") for k in BASE])
    every = F.concat(*[F.col(f"__{k}") for k in kinds])
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("blob", F.lit(RULE_VERSION).alias("rule_version"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))


LEDGER = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def read_ledger(spark, path: str) -> DataFrame | None:
    """A row for each blob that these rules have seen. Scans that overlap may both write a blob; their rows are equal and one is read."""
    try:
        return spark.read.schema(LEDGER).parquet(path).filter(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update(versions: DataFrame, ledger_path: str) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the ledger of these rules."""
    spark, known = versions.sparkSession, read_ledger(versions.sparkSession, ledger_path)
    texts = versions.select(blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if known is not None:
        texts = texts.join(known.select("blob"), "blob", "left_anti")
    search(texts.groupBy("blob").agg(F.first("text").alias("text"))).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def scan(versions: DataFrame, path: str, ledger_path: str | None = None) -> DataFrame:
    """Findings of every row of ``versions``, named by its column ``path``; a new ledger if none is given."""
    ledger = shared.stage(update(versions, ledger_path or shared.fresh_path(versions.sparkSession, "ledger")), "ledger-rows")
    paths = versions.select(path, blob(F.col("text")).alias("blob"))
    return paths.join(ledger, "blob").select(path, "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs, "doc_id")
