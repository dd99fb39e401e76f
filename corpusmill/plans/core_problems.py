"""Queries of the general problems: hierarchies (6) and incremental processing (7), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import changelog, hierarchy
from corpusmill.runtime import scratch_path, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestors(table(spark, sf_dir, "links")).select("source", "artifact_id", "ancestor_id")


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pending(spark, sf_dir).select("source", "artifact_id")


def p7_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = changelog.ChangeCapture(spark, scratch_path(spark, "changes"))
    names = ("artifacts", "ledger", "runs", "corpora")
    _, rows = changelog.next_run(capture, *(table(spark, sf_dir, n) for n in names))
    return rows.select("source", "artifact_id", "current_version", "reason")


QUERIES = {"p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p7_found": p7_found, "p7_pending": p7_pending}

_PARENTS = """
edge AS (SELECT source, artifact_id, target_id, written_at FROM links
         WHERE edge_type = 'PARENT' AND target_id <> '' AND artifact_id <> '' AND source IS NOT NULL),
parent AS (SELECT source, artifact_id, target_id AS parent_id FROM edge
           QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY written_at DESC NULLS LAST, target_id DESC) = 1)"""
_CLOSURE = """
up AS (SELECT source, artifact_id, parent_id AS ancestor_id FROM parent
       UNION
       SELECT up.source, up.artifact_id, p.parent_id FROM up JOIN parent p ON p.source = up.source AND p.artifact_id = up.ancestor_id)"""

_PENDING = """
WITH now AS (SELECT source, artifact_id, sha256(raw) AS current_version FROM artifacts
             QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY modified_at DESC NULLS LAST) = 1),
good AS (SELECT l.* FROM ledger l JOIN runs r ON r.run_id = l.run_id AND r.source = l.source WHERE r.status = 'ok'
         QUALIFY row_number() OVER (PARTITION BY l.source, l.artifact_id ORDER BY l.run_id DESC, l.written_at DESC) = 1)
SELECT n.source, n.artifact_id, n.current_version,
       CASE WHEN g.source IS NULL THEN 'new'
            WHEN g.version IS DISTINCT FROM n.current_version THEN 'content'
            WHEN g.embedder_id IS DISTINCT FROM c.embedder_id THEN 'embedder'
            ELSE 'strategy' END AS reason
FROM now n LEFT JOIN good g ON g.source = n.source AND g.artifact_id = n.artifact_id
           LEFT JOIN corpora c ON c.source = n.source
WHERE n.current_version IS NOT NULL
  AND (g.source IS NULL OR g.version IS DISTINCT FROM n.current_version
       OR g.embedder_id IS DISTINCT FROM c.embedder_id OR g.strategy_id IS DISTINCT FROM c.strategy_id)"""

ORACLE_SQL = {
    "p6_found": f"WITH RECURSIVE {_PARENTS}, {_CLOSURE} SELECT source, artifact_id, ancestor_id FROM up",
    "p7_found": f"SELECT source, artifact_id FROM ({_PENDING})",
    "p7_pending": _PENDING,
    "p6_hierarchy": f"""
WITH RECURSIVE {_PARENTS}, {_CLOSURE},
ringed AS (SELECT DISTINCT source, artifact_id FROM up WHERE artifact_id = ancestor_id),
bad AS (SELECT source, artifact_id FROM ringed UNION
        SELECT u.source, u.artifact_id FROM up u JOIN ringed r ON r.source = u.source AND r.artifact_id = u.ancestor_id),
trail AS (SELECT source, artifact_id, artifact_id AS tip, artifact_id AS path, 0 AS depth FROM (
              SELECT source, artifact_id FROM artifacts WHERE source IS NOT NULL AND artifact_id <> ''
              UNION SELECT source, artifact_id FROM up UNION SELECT source, ancestor_id FROM up)
          UNION ALL
          SELECT t.source, t.artifact_id, p.parent_id, p.parent_id || ' > ' || t.path, t.depth + 1
          FROM trail t JOIN parent p ON p.source = t.source AND p.artifact_id = t.tip
          WHERE NOT contains(' > ' || t.path || ' > ', ' > ' || p.parent_id || ' > ')),
longest AS (SELECT * FROM trail QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY depth DESC) = 1),
below AS (SELECT source, ancestor_id, count(*) AS n FROM up GROUP BY ALL)
SELECT l.source, l.artifact_id,
       CASE WHEN r.source IS NOT NULL THEN l.artifact_id || ' > ' ELSE '' END || l.path AS path,
       CASE WHEN b.source IS NULL THEN l.depth END AS depth,
       CASE WHEN b.source IS NULL THEN l.tip END AS root,
       coalesce(w.n, 0)::BIGINT AS n_descendants, b.source IS NOT NULL AS cyclic
FROM longest l LEFT JOIN ringed r ON r.source = l.source AND r.artifact_id = l.artifact_id
     LEFT JOIN bad b ON b.source = l.source AND b.artifact_id = l.artifact_id
     LEFT JOIN below w ON w.source = l.source AND w.ancestor_id = l.artifact_id""",
}
