"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelode.operators.integrity import orphan_counts, orphans
from codelode.plans.registry import CORE
from codelode.session import table

_ORPHANS = r"""
WITH refs AS (
  SELECT edge_id, repo, coalesce(sent_at, TIMESTAMP '9999-12-31') AS moment,
    CASE WHEN starts_with(sym, repo || ':') THEN sym
         WHEN edge_type = 'CROSS_REPO_API' THEN repo || ':endpoint:' || sym
         ELSE repo || ':' || file || ':' || sym END AS key
  FROM (SELECT edge_id, edge_type, indexed_at AS sent_at,
      coalesce(regexp_replace(target_repo, '^\s+|\s+$', '', 'g'), '') AS repo,
      coalesce(regexp_replace(target_file, '^\s+|\s+$', '', 'g'), '') AS file,
      coalesce(regexp_replace(target_symbol, '^\s+|\s+$', '', 'g'), '') AS sym FROM call_edges)
  WHERE repo <> ''
), sent AS (
  SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY moment, repo, key) = 1
), states AS (
  SELECT symbol_id AS key, min(coalesce(indexed_at, TIMESTAMP '0001-01-01')) AS since,
    max({'moment': coalesce(indexed_at, TIMESTAMP '0001-01-01'), 'gone': removed_at IS NOT NULL}).gone AS removed
  FROM symbols GROUP BY symbol_id
), judged AS (
  SELECT edge_id, strftime(moment, '%Y-%m') AS month,
    CASE WHEN r.repo_id IS NULL THEN 'repositories' ELSE 'symbols' END AS ref_table,
    CASE WHEN r.repo_id IS NULL OR s.key IS NULL THEN 'missing' WHEN s.removed THEN 'deleted' WHEN s.since > e.moment THEN 'late' END AS state
  FROM sent e LEFT JOIN (SELECT DISTINCT repo_id FROM repositories) r ON r.repo_id = e.repo LEFT JOIN states s ON s.key = e.key
)
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "call_edges", "edge_id", "target_repo", "target_file", "target_symbol", "edge_type", "indexed_at"),
        table(spark, sf_dir, "symbols", "symbol_id", "removed_at", "indexed_at"),
        table(spark, sf_dir, "repositories", "repo_id"),
    )


@CORE.add("p5_found", _ORPHANS + "SELECT edge_id, ref_table, state FROM judged WHERE state IS NOT NULL")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*_tables(spark, sf_dir)).select("edge_id", "ref_table", "state")


@CORE.add("p5_report", _ORPHANS + "SELECT ref_table, state, month, count(*) AS orphans FROM judged WHERE state IS NOT NULL GROUP BY ALL")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(*_tables(spark, sf_dir))
