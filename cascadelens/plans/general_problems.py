"""Queries of the general training-data problems: 1, 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cascadelens.operators import hierarchy, nested, orphans, timestamps
from cascadelens.plans import instants_sql
from cascadelens.tables import table


def _dated_records(spark: SparkSession, folder: str) -> DataFrame:
    def part(name: str, row: str, text: str) -> DataFrame:
        return table(spark, folder, name).select(F.lit(name).alias("tab"), F.col(row).alias("row_id"), F.col(text).alias("text"), "collector", "loaded_at")

    return part("lib_version", "lv_id", "commit_date").unionByName(part("patch", "patch_id", "commit_date")).unionByName(part("cve", "cve_row", "published_date"))


def p1_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every dated record with its instant and how sure it is."""
    return timestamps.normalise(_dated_records(spark, folder), table(spark, folder, "zone_ref"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text denotes exactly one instant."""
    return p1_normalised(spark, folder).where(F.col("status") == "exact").select("tab", "row_id", "utc_us")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of a cpe_match with its node's path and its place."""
    return nested.configuration_matches(table(spark, folder, "nvd_raw"), "raw_id", "doc", with_values=False)


def p3_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The match table with its own columns."""
    return nested.configuration_matches(table(spark, folder, "nvd_raw"), "raw_id", "doc")


def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table with parent links."""
    return nested.configuration_nodes(table(spark, folder, "nvd_raw"), "raw_id", "doc")


def p3_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of elements below `configurations`."""
    return nested.schema_graph(table(spark, folder, "nvd_raw"), "doc", nested.CONFIGURATIONS)


def _places(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.decompose(table(spark, folder, "reuses").select("src_id", "dst_id"), "src_id", "dst_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every linked id."""
    return _places(spark, folder)[0].select("unique_id", "root_id", "depth")


def p4_places(spark: SparkSession, folder: str) -> DataFrame:
    """Parent, size of the subtree and interval of descendants of every linked id."""
    return _places(spark, folder)[0].select("unique_id", "parent_id", "root_id", "depth", "n_descendants", "first_pos", "last_pos")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The full path of every linked id."""
    return hierarchy.full_paths(_places(spark, folder)[0])


def p4_loops(spark: SparkSession, folder: str) -> DataFrame:
    """The loops and what hangs below them."""
    return hierarchy.loops(_places(spark, folder)[1])


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(*[table(spark, folder, t) for t in ("patch", "reuses", "cve", "commit_log", "software")])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """References without a valid target."""
    return _orphans(spark, folder).select("ref_tab", "ref_field", "row_id", "kind")


def p5_months(spark: SparkSession, folder: str) -> DataFrame:
    """Their number by table, field, month of loading and kind."""
    return orphans.per_month(_orphans(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_normalised, p3_found, p3_matches, p3_nodes, p3_schema, p4_found, p4_places, p4_paths, p4_loops, p5_found, p5_months)
}

_JSON_NODES = """
WITH RECURSIVE docs AS (
  SELECT raw_id, CASE WHEN json_valid(doc) THEN json(doc) END AS j FROM nvd_raw
), conf AS (
  SELECT raw_id, CASE WHEN json_type(c) = 'VARCHAR'
                      THEN CASE WHEN json_valid(c ->> '$') THEN json(c ->> '$') END ELSE c END AS c
  FROM (SELECT raw_id, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$.configurations') END AS c FROM docs)
), tops AS (
  SELECT raw_id, CASE json_type(n) WHEN 'ARRAY' THEN n WHEN 'OBJECT' THEN json_array(n) END AS list
  FROM (SELECT raw_id, json_extract(c, '$.nodes') AS n FROM conf WHERE json_type(c) = 'OBJECT')
), node AS (
  SELECT raw_id, CAST(i AS VARCHAR) AS node_path, CAST(NULL AS VARCHAR) AS parent_path, CAST(0 AS BIGINT) AS depth, json_extract(list, '$[' || i || ']') AS n
  FROM (SELECT raw_id, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i FROM tops WHERE list IS NOT NULL)
  UNION ALL
  SELECT raw_id, node_path || '.' || i, node_path, depth + 1, json_extract(list, '$[' || i || ']')
  FROM (SELECT raw_id, node_path, depth, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i
        FROM (SELECT raw_id, node_path, depth, CASE json_type(k) WHEN 'ARRAY' THEN k WHEN 'OBJECT' THEN json_array(k) END AS list
              FROM (SELECT raw_id, node_path, depth, json_extract(n, '$.children') AS k FROM node WHERE json_type(n) = 'OBJECT'))
        WHERE list IS NOT NULL)
), hit AS (
  SELECT raw_id, node_path, i AS match_pos, json_extract(list, '$[' || i || ']') AS m
  FROM (SELECT raw_id, node_path, list, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i
        FROM (SELECT raw_id, node_path, CASE json_type(k) WHEN 'ARRAY' THEN k WHEN 'OBJECT' THEN json_array(k) END AS list
              FROM (SELECT raw_id, node_path, json_extract(n, '$.cpe_match') AS k FROM node WHERE json_type(n) = 'OBJECT'))
        WHERE list IS NOT NULL)
)
"""

_FOREST = """
WITH RECURSIVE pairs AS (
  SELECT dst_id AS id, src_id AS up FROM reuses WHERE dst_id IS NOT NULL
  UNION SELECT src_id, NULL FROM reuses WHERE src_id IS NOT NULL
), node AS (SELECT id, min(up) AS up FROM pairs GROUP BY id),
walk AS (
  SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM node WHERE up IS NULL
  UNION ALL
  SELECT n.id, w.root_id, w.depth + 1, w.path || ' > ' || n.id FROM node n JOIN walk w ON n.up = w.id
)
"""

_TIDY = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_ORPHANS = f"""
WITH p AS (
  SELECT patch_id AS row_id, {_TIDY.format("cve_id")} AS cve_key, {_TIDY.format("commit_id")} AS commit_key,
         repo_owner || '%' || repo_name AS repo, loaded_at FROM patch
), vc AS (SELECT {_TIDY.format("cve_id")} AS k, min(loaded_at) AS t, arg_max(op, loaded_at) = 'delete' AS gone FROM cve GROUP BY 1),
vl AS (SELECT {_TIDY.format("commit_id")} AS k, min(loaded_at) AS t, arg_max(op, loaded_at) = 'delete' AS gone FROM commit_log GROUP BY 1),
vr AS (SELECT repo, {_TIDY.format("commit_id")} AS k, min(loaded_at) AS t, arg_max(op, loaded_at) = 'delete' AS gone FROM commit_log GROUP BY 1, 2),
vs AS (SELECT unique_id AS k, min(loaded_at) AS t, arg_max(op, loaded_at) = 'delete' AS gone FROM software GROUP BY 1),
judged AS (
  SELECT 'patch' AS ref_tab, 'cve_id' AS ref_field, row_id, loaded_at,
         CASE WHEN t IS NULL THEN 3 WHEN gone THEN 2 WHEN t > loaded_at THEN 1 ELSE 0 END AS r
  FROM p LEFT JOIN vc ON cve_key = k WHERE cve_key IS NOT NULL
  UNION ALL
  SELECT 'patch', 'commit_id', row_id, loaded_at, CASE WHEN t IS NULL THEN 3 WHEN gone THEN 2 WHEN t > loaded_at THEN 1 ELSE 0 END
  FROM p LEFT JOIN vl ON commit_key = k WHERE length(commit_key) >= 40
  UNION ALL
  SELECT 'patch', 'commit_id', row_id, any_value(p.loaded_at), min(CASE WHEN t IS NULL THEN 3 WHEN gone THEN 2 WHEN t > p.loaded_at THEN 1 ELSE 0 END)
  FROM p LEFT JOIN vr ON p.repo = vr.repo AND starts_with(k, commit_key) WHERE length(commit_key) < 40 GROUP BY row_id
  UNION ALL
  SELECT 'reuses', 'src_id', reuse_id, loaded_at, CASE WHEN t IS NULL THEN 3 WHEN gone THEN 2 WHEN t > loaded_at THEN 1 ELSE 0 END
  FROM reuses LEFT JOIN vs ON src_id = k WHERE src_id IS NOT NULL
  UNION ALL
  SELECT 'reuses', 'dst_id', reuse_id, loaded_at, CASE WHEN t IS NULL THEN 3 WHEN gone THEN 2 WHEN t > loaded_at THEN 1 ELSE 0 END
  FROM reuses LEFT JOIN vs ON dst_id = k WHERE dst_id IS NOT NULL
), found AS (SELECT *, CASE r WHEN 3 THEN 'missing' WHEN 2 THEN 'deleted' ELSE 'late' END AS kind FROM judged WHERE r > 0)
"""

_LOOPS = _FOREST.rstrip() + """,
lost AS (SELECT id, up FROM node WHERE id NOT IN (SELECT id FROM walk)),
climb AS (SELECT id, up AS spot FROM lost UNION SELECT c.id, l.up FROM climb c JOIN lost l ON l.id = c.spot),
ring AS (SELECT id FROM climb WHERE id = spot)
SELECT min(spot) AS loop_id, id AS unique_id, id IN (SELECT id FROM ring) AS on_loop FROM climb WHERE spot IN (SELECT id FROM ring) GROUP BY id"""

_SCHEMA = _JSON_NODES.split(", tops AS")[0].rstrip() + """,
item AS (SELECT 'configurations' AS name, c AS v FROM conf WHERE c IS NOT NULL
  UNION ALL SELECT CASE WHEN key IS NULL THEN name ELSE key END, CASE WHEN key IS NULL THEN json_extract(v, '$[' || i || ']') ELSE json_extract(v, '$."' || key || '"') END FROM (
    SELECT name, v, CAST(NULL AS VARCHAR) AS key, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM item WHERE json_type(v) = 'ARRAY'
    UNION ALL SELECT name, v, unnest(json_keys(v)), 0 FROM item WHERE json_type(v) = 'OBJECT'))
SELECT DISTINCT name AS parent, key AS child, CASE json_type(json_extract(v, '$."' || key || '"')) WHEN 'ARRAY' THEN 'many' WHEN 'OBJECT' THEN 'object' ELSE 'value' END AS kind
FROM (SELECT name, v, unnest(json_keys(v)) AS key FROM item WHERE json_type(v) = 'OBJECT')"""

ORACLE = {
    "p4_loops": _LOOPS,
    "p3_schema": _SCHEMA,
    "p1_found": instants_sql.FOUND,
    "p3_found": _JSON_NODES + "SELECT raw_id, node_path, match_pos FROM hit",
    "p3_matches": _JSON_NODES
    + """SELECT raw_id, node_path, match_pos, coalesce(m ->> '$.vulnerable' = 'true', false) AS vulnerable, m ->> '$.cpe23Uri' AS cpe23uri,
    m ->> '$.versionStartIncluding' AS versionStartIncluding, m ->> '$.versionStartExcluding' AS versionStartExcluding,
    m ->> '$.versionEndIncluding' AS versionEndIncluding, m ->> '$.versionEndExcluding' AS versionEndExcluding FROM hit""",
    "p3_nodes": _JSON_NODES + "SELECT raw_id, node_path, parent_path, depth, n ->> '$.operator' AS operator, coalesce(n ->> '$.negate' = 'true', false) AS negate FROM node",
    "p4_found": _FOREST + "SELECT n.id AS unique_id, coalesce(root_id, 'CYCLE') AS root_id, coalesce(depth, -1) AS depth FROM node n LEFT JOIN walk w ON n.id = w.id",
    "p4_paths": _FOREST + "SELECT n.id AS unique_id, path FROM node n LEFT JOIN walk w ON n.id = w.id",
    "p5_found": _ORPHANS + "SELECT ref_tab, ref_field, row_id, kind FROM found",
    "p5_months": _ORPHANS + "SELECT ref_tab, ref_field, strftime(loaded_at, '%Y-%m') AS month, kind, count(*) AS n FROM found GROUP BY ALL",
}
