"""The queries of problems 4, 5 and 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changes, containment, orphans
from codeloom.plans.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return containment.hierarchy(table(spark, d, "edges")).select("id", "root", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return containment.paths(table(spark, d, "edges"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return containment.descendants(table(spark, d, "edges"))


def p4_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p4_descendants and those on and below circles."""
    return containment.all_descendants(table(spark, d, "edges"))


def p4_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Ids with more than one parent; the hierarchy keeps the smallest."""
    return containment.several_parents(table(spark, d, "edges"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    logs = {"file_hashes": changes.file_log(table(spark, d, "file_hashes")), "nodes": changes.node_log(table(spark, d, "nodes"))}
    return changes.changes_by_run(table(spark, d, "index_runs"), logs).select("run_id", "tbl", "rec")


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """What each successful run takes over, as counts."""
    logs = {"file_hashes": changes.file_log(table(spark, d, "file_hashes")), "nodes": changes.node_log(table(spark, d, "nodes"))}
    rows = changes.changes_by_run(table(spark, d, "index_runs"), logs)
    return rows.groupBy("run_id", "tbl").agg(F.count(F.lit(1)).alias("changed"), F.sum(F.col("state").isNull().cast("long")).alias("gone"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "boundary")).select("src", "dst", "relation", "side")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "boundary"))


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p4_all_descendants, p4_conflicts, p5_found, p5_batches, p6_found, p6_report)}

_PAD = "' ' || chr(9) || chr(13) || chr(10)"


def _id(c: str) -> str:
    return f"lower(trim({c}, {_PAD}))"


_LINKS = f"""links AS (
  SELECT {_id("dst")} AS id, min({_id("src")}) AS parent FROM edges
  WHERE upper(trim(relation, {_PAD})) = 'DEFINES' AND trim(src, {_PAD}) <> '' AND trim(dst, {_PAD}) <> ''
  GROUP BY 1)"""
_DOWN = f"""{_LINKS}, heads AS (
  SELECT DISTINCT parent AS id FROM links WHERE parent NOT IN (SELECT id FROM links)), walk AS (
  SELECT id, id AS root, 0 AS depth, id AS path, [id] AS chain FROM heads
  UNION ALL
  SELECT l.id, w.root, w.depth + 1, w.path || '/' || l.id, list_append(w.chain, l.id) FROM walk w JOIN links l ON l.parent = w.id),
ups AS (
  SELECT id, parent AS up FROM links WHERE id NOT IN (SELECT id FROM walk)
  UNION
  SELECT u.id, l.parent FROM ups u JOIN links l ON l.id = u.up),
circle AS (SELECT DISTINCT id FROM ups WHERE id = up),
round AS (SELECT u.id, min(u.up) AS root FROM ups u JOIN circle c ON c.id = u.up GROUP BY 1),
whole AS (
  SELECT id, root, depth, path FROM walk
  UNION ALL
  SELECT id, root, -1, NULL FROM round)"""
_CURRENT_STATE = f"""state AS (
  SELECT {_id("id")} AS id, arg_max(removed_at IS NULL, (indexed_at, landed_at)) AS alive, min(coalesce(landed_at, TIMESTAMP '9999-01-01')) AS first
  FROM nodes WHERE id IS NOT NULL GROUP BY 1)"""
_ORPHANS = f"""WITH {_CURRENT_STATE}, e AS (
  SELECT {_id("src")} AS src, {_id("dst")} AS dst, upper(trim(relation, {_PAD})) AS relation, min(landed_at) AS landed_at
  FROM edges WHERE trim(src, {_PAD}) <> '' AND trim(dst, {_PAD}) <> '' GROUP BY 1, 2, 3),
ends AS (SELECT *, 'src' AS side, src AS key FROM e UNION ALL SELECT *, 'dst' AS side, dst AS key FROM e),
found AS (
  SELECT ends.*, CASE WHEN s.id IS NULL THEN 'missing' WHEN NOT s.alive THEN 'removed' ELSE 'late' END AS reason
  FROM ends LEFT JOIN state s ON s.id = ends.key
  WHERE key NOT IN (SELECT {_id("node_id")} FROM boundary WHERE node_id IS NOT NULL)
    AND (s.id IS NULL OR NOT s.alive OR s.first > ends.landed_at))"""
_CHANGES = f"""WITH runs AS (
  SELECT run_id, min(started_at) AS began FROM index_runs WHERE run_id IS NOT NULL
  GROUP BY 1 HAVING bool_or(lower(trim(status, {_PAD})) = 'succeeded') AND min(started_at) IS NOT NULL),
log AS (
  SELECT 'file_hashes' AS tbl, file AS rec, indexed_at AS version, lower(trim(hash, {_PAD})) AS state, landed_at FROM file_hashes
  WHERE trim(file, {_PAD}) <> '' AND landed_at IS NOT NULL
  UNION ALL
  SELECT 'nodes', {_id("id")}, indexed_at, CAST(indexed_at AS VARCHAR), landed_at FROM nodes
  WHERE trim(id, {_PAD}) <> '' AND landed_at IS NOT NULL),
seen AS (
  SELECT run_id, began, tbl, rec, max(struct_pack(v := coalesce(version, TIMESTAMP '0001-01-01'), l := landed_at, s := coalesce(state, ''), n := state)).n AS state
  FROM runs JOIN log ON landed_at <= began GROUP BY ALL),
step AS (
  SELECT *, lag(state) OVER (PARTITION BY tbl, rec ORDER BY began, run_id) AS was FROM seen),
changed AS (SELECT run_id, tbl, rec, state FROM step WHERE state IS DISTINCT FROM was)"""

SQL = {
    "p4_found": f"WITH RECURSIVE {_DOWN} SELECT id, root, CAST(depth AS INTEGER) AS depth FROM whole",
    "p4_paths": f"WITH RECURSIVE {_DOWN} SELECT id, root, CAST(depth AS INTEGER) AS depth, path FROM whole",
    "p4_descendants": f"WITH RECURSIVE {_DOWN}, pairs AS (SELECT id AS descendant, depth, unnest(chain) AS id, unnest(range(len(chain))) AS pos FROM walk) SELECT id, descendant, CAST(depth - pos AS INTEGER) AS distance FROM pairs WHERE id <> descendant",
    "p4_all_descendants": f"""WITH RECURSIVE {_DOWN}, pairs AS (SELECT id AS descendant, depth, unnest(chain) AS id, unnest(range(len(chain))) AS pos FROM walk),
      climb AS (
        SELECT id AS descendant, parent AS id, 1 AS distance, [id, parent] AS way FROM links WHERE id NOT IN (SELECT id FROM walk)
        UNION ALL
        SELECT c.descendant, l.parent, c.distance + 1, list_append(c.way, l.parent) FROM climb c JOIN links l ON l.id = c.id WHERE NOT list_contains(c.way, l.parent))
      SELECT id, descendant, CAST(depth - pos AS INTEGER) AS distance FROM pairs WHERE id <> descendant
      UNION ALL
      SELECT id, descendant, CAST(distance AS INTEGER) FROM climb WHERE id <> descendant""",
    "p4_conflicts": f"SELECT {_id('dst')} AS id, count(DISTINCT {_id('src')}) AS parents FROM edges WHERE upper(trim(relation, {_PAD})) = 'DEFINES' AND trim(src, {_PAD}) <> '' AND trim(dst, {_PAD}) <> '' GROUP BY 1 HAVING count(DISTINCT {_id('src')}) > 1",
    "p5_found": f"{_CHANGES} SELECT run_id, tbl, rec FROM changed",
    "p5_batches": f"{_CHANGES} SELECT run_id, tbl, count(*) AS changed, count(*) FILTER (WHERE state IS NULL) AS gone FROM changed GROUP BY 1, 2",
    "p6_found": f"{_ORPHANS} SELECT src, dst, relation, side FROM found",
    "p6_report": f"{_ORPHANS} SELECT relation, side, CASE WHEN reason = 'missing' THEN 'none' ELSE 'nodes' END AS tbl, reason, strftime(landed_at, '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY 1, 2, 3, 4, 5",
}
