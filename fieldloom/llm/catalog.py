"""Queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, license_scan, mixing, pii, quality, secret_scan, sharding, simhash, suffix_dedup, warc

#: name: (operator, its tables)
OPERATORS = {
    "op1_suffix_array_dedup": (suffix_dedup.op1, ("documents",)),
    "op2_license_scan": (license_scan.op2, ("documents",)),
    "op3_quality_rules": (quality.op3, ("documents", "labels")),
    "op4_simhash_near_dedup": (simhash.op4, ("documents",)),
    "op5_warc": (warc.op5, ("pages",)),
    "op6_source_mixing": (mixing.op6, ("documents",)),
    "op7_pii": (pii.op7, ("documents",)),
    "op8_kd_tree_sharding": (sharding.op8, ("documents",)),
    "op9_secret_scan": (secret_scan.op9, ("documents",)),
    "op10_benchmark_decontamination": (decontaminate.op10, ("documents", "benchmark")),
}


def _query(operator: Callable[..., DataFrame], tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*how) for name, how in OPERATORS.items()}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, dg.n AS n FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN w USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """For the operators whose every column SQL can state; tests hold the others against brute force."""
    return {"op5_warc": WARC_SQL, "op10_benchmark_decontamination": DECONTAMINATION_SQL}
