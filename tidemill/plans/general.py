"""The core training-data queries: hot keys (3) and the change feed (6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.change_feed import apply_changes, publish, read_current
from tidemill.operators.hot_keys import endpoint_totals, hot_nodes
from tidemill.session import scratch_path, table


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoint_totals(table(spark, sf_dir, "graph_edges"), "src_id", "dst_id", "weight")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in at least 2 percent of all rows."""
    return hot_nodes(p3_totals(spark, sf_dir), table(spark, sf_dir, "graph_edges").count(), 0.02).select("node_id")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published current rows with the change each stems from."""
    root = scratch_path(spark, "change-feed")
    publish(apply_changes(table(spark, sf_dir, "vectorizer_queue"), "vectorizer_id", "source_pk", "op", "job_id", "body"), root)
    return read_current(spark, root).where("not deleted").select(F.col("owner").cast("int").alias("vectorizer_id"), F.col("pk").alias("source_pk"), F.col("seq").alias("job_id"), F.col("payload").alias("body"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_rows(spark, sf_dir).select("vectorizer_id", "source_pk", "job_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p3_totals": p3_totals, "p6_found": p6_found, "p6_rows": p6_rows}


ENDS = "SELECT src_id AS node, weight FROM graph_edges WHERE src_id IS NOT NULL UNION ALL SELECT dst_id, weight FROM graph_edges WHERE dst_id IS NOT NULL AND dst_id IS DISTINCT FROM src_id"
TOTALS = f"SELECT node AS node_id, count(*) AS n_edges, CAST(coalesce(sum(weight), 0) AS BIGINT) AS sum_weight FROM ({ENDS}) GROUP BY node"
LATEST = """SELECT vectorizer_id, pk AS source_pk, job_id, body FROM (
  SELECT vectorizer_id, regexp_replace(source_pk, '^\\s+|\\s+$', '', 'g') AS pk, job_id, body, lower(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) AS kind FROM vectorizer_queue)
WHERE kind IN ('insert', 'update', 'upsert', 'delete') AND pk IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY vectorizer_id, pk ORDER BY job_id DESC) = 1 AND kind <> 'delete'"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"SELECT node_id FROM ({TOTALS}) WHERE n_edges * 50 >= (SELECT count(*) FROM graph_edges)",
        "p3_totals": TOTALS,
        "p6_found": f"SELECT vectorizer_id, source_pk, job_id FROM ({LATEST})",
        "p6_rows": LATEST,
    }
