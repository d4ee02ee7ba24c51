"""The general problems' queries (p1 to p5) and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialforge.functions.lineage import materialize
from trialforge.functions.text import folded, present, sql_folded
from trialforge.operators import hierarchy, history, nested, orphans, topn
from trialforge.sources.tables import table

#: Attributes by how often they change: the status at nearly every row, the scores now and then, the description hardly ever.
SATELLITES = {
    "status": ("status",),
    "scores": ("search_eval", "selection_eval", "final_eval"),
    "description": ("family", "operator_type", "resource_class"),
}


def _dated(candidates: DataFrame) -> DataFrame:
    return candidates.where(present("candidate_id") & (F.col("updated_at") >= F.col("created_at")))


def _attribute(name: str):
    return F.col(name) if name.endswith("_eval") else folded(name)


def _versions(candidates: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    sat, hot = history.satellite(candidates, folded("candidate_id"), F.unix_micros("updated_at"), F.col("seq"), {a: _attribute(a) for a in attributes})
    return history.end_dated(sat, hot).withColumnsRenamed({"key": "candidate_id", "at_us": "valid_from_us", "until_us": "valid_to_us"}).drop("hash_diff")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every status version of every candidate."""
    rows = _dated(table(spark, d, "candidates")).where(present("status"))
    return _versions(rows, SATELLITES["status"]).select("candidate_id", "status", "valid_from_us", "valid_to_us")


def p1_appended(spark: SparkSession, d: str) -> DataFrame:
    """The status versions again, from a store that is only ever appended to: a first load of the rows that arrived in the first half of the
    log, then a batch with the rest, late rows among them."""
    rows = _dated(table(spark, d, "candidates")).where(present("status"))
    key, at, order, attributes = folded("candidate_id"), F.unix_micros("updated_at"), F.col("seq"), {"status": folded("status")}
    half = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    late = F.col("seq") > F.lit(half) if half is not None else F.lit(False)
    sat, _ = history.satellite(rows.where(~F.coalesce(late, F.lit(False))), key, at, order, attributes)
    stored, _ = materialize(sat.select("key", "at_us", "hash_diff", F.lit(1).alias("load"), *attributes), "satellite")
    added = history.appended(stored, rows.where(late), rows, key, at, order, attributes, 2)
    out = history.versions(stored.unionByName(added), attributes)
    return out.select(F.col("key").alias("candidate_id"), "status", F.col("at_us").alias("valid_from_us"), F.col("until_us").alias("valid_to_us"))


def p1_score_versions(spark: SparkSession, d: str) -> DataFrame:
    """The satellite of the scores, with the times of its versions."""
    return _versions(_dated(table(spark, d, "candidates")), SATELLITES["scores"])


def p1_description_versions(spark: SparkSession, d: str) -> DataFrame:
    """The satellite of the attributes that hardly ever change."""
    return _versions(_dated(table(spark, d, "candidates")), SATELLITES["description"])


def p1_change_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each attribute changes from row to row."""
    names = [a for group in SATELLITES.values() for a in group]
    return history.change_rates(_dated(table(spark, d, "candidates")), folded("candidate_id"), F.unix_micros("updated_at"), F.col("seq"), {a: _attribute(a) for a in names})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of the nested documents."""
    return nested.lab_relations(table(spark, d, "candidates"), table(spark, d, "frontier"))


def _stores(spark: SparkSession, d: str) -> tuple[nested.Documents, nested.Documents]:
    return nested.lab_documents(table(spark, d, "candidates"), table(spark, d, "frontier"))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct object, list and scalar of all documents once, with the documents that open with it and the places that it is in."""
    patches, fronts = _stores(spark, d)
    both = patches.nodes().unionByName(fronts.nodes()).groupBy("node").agg(F.first(F.struct("kind", "children", "value")).alias("x"), F.sum("n_documents").alias("n_documents"), F.sum("n_places").alias("n_places"))
    return both.select("node", "x.*", "n_documents", "n_places")


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The members of each distinct object and list, with place and ordinal."""
    patches, fronts = _stores(spark, d)
    names = ["parent", "ordinal", "place", "node", "kind"]
    return patches.bridge.select(names).unionByName(fronts.bridge.select(names)).distinct()


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """The root of each document: where the walks along the bridge start."""
    patches, fronts = _stores(spark, d)
    return patches.roots.select("column", "doc_key", "node").unionByName(fronts.roots.select("column", "doc_key", "node")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a candidate that doesn't hold."""
    return orphans.lab_orphans(*(table(spark, d, t) for t in ("candidates", "evaluations", "workers", "removals")))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans for each table, kind and month."""
    return orphans.orphan_counts(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, number of descendants and rings."""
    return hierarchy.hierarchy(hierarchy.first_parents(table(spark, d, "candidates")))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of each candidate that runs into no ring."""
    return hierarchy.full_paths(hierarchy.first_parents(table(spark, d, "candidates")))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate with all its descendants, also below rings; only candidates on a ring are left out as ancestors."""
    return hierarchy.closure(*hierarchy.ancestor_paths(hierarchy.first_parents(table(spark, d, "candidates")), below_rings=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best candidates of every family."""
    return topn.lab_top(table(spark, d, "candidates"))


QUERIES = {f.__name__: f for f in (p1_found, p1_appended, p1_score_versions, p1_description_versions, p1_change_rates, p2_found, p2_nodes, p2_bridge, p2_documents, p3_found, p3_counts, p4_found, p4_paths, p4_descendants, p5_found)}

_ID, _STATUS, _FAMILY = sql_folded("candidate_id"), sql_folded("status"), sql_folded("family")
_DATED = f"coalesce({_ID}, '') <> '' AND updated_at IS NOT NULL AND created_at IS NOT NULL AND updated_at >= created_at"


def _versions_sql(columns: dict[str, str], where: str = "true") -> str:
    names = ", ".join(columns)
    made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    changed = " OR ".join(f"{n} IS DISTINCT FROM lag({n}) OVER w" for n in columns)
    return f"""
WITH one AS (
  SELECT candidate_id, at_us, {names} FROM (
    SELECT {_ID} AS candidate_id, epoch_us(updated_at) AS at_us, {made},
           row_number() OVER (PARTITION BY {_ID}, updated_at ORDER BY seq DESC) AS n
    FROM candidates WHERE {_DATED} AND {where}) WHERE n = 1),
marked AS (SELECT *, row_number() OVER w = 1 OR {changed} AS starts FROM one WINDOW w AS (PARTITION BY candidate_id ORDER BY at_us))
SELECT candidate_id, {names}, at_us AS valid_from_us,
       coalesce(lead(at_us) OVER (PARTITION BY candidate_id ORDER BY at_us), -1) AS valid_to_us
FROM marked WHERE starts"""


_ONE_SCORES = {a: a for a in SATELLITES["scores"]}
_ONE_TEXTS = {a: sql_folded(a) for a in SATELLITES["description"]}
_ALL = {"status": _STATUS} | _ONE_SCORES | _ONE_TEXTS
_CHANGE_RATES = f"""
WITH one AS (
  SELECT * FROM (
    SELECT {_ID} AS candidate_id, epoch_us(updated_at) AS at_us, {', '.join(f'{e} AS {n}' for n, e in _ALL.items())},
           row_number() OVER (PARTITION BY {_ID}, updated_at ORDER BY seq DESC) AS n
    FROM candidates WHERE {_DATED}) WHERE n = 1),
seen AS (SELECT row_number() OVER w AS k, {', '.join(f'{n} IS DISTINCT FROM lag({n}) OVER w AS {n}' for n in _ALL)}
         FROM one WINDOW w AS (PARTITION BY candidate_id ORDER BY at_us))
""" + " UNION ALL ".join(f"SELECT '{n}' AS attribute, count(*) AS pairs, count(*) FILTER (WHERE {n}) AS changes FROM seen WHERE k > 1" for n in _ALL)

_REFS = f"""
dim AS (
  SELECT c.id, c.first_seen, r.first_removed FROM
    (SELECT {_ID} AS id, min(recorded_at) AS first_seen FROM candidates WHERE coalesce({_ID}, '') <> '' GROUP BY 1) c
    LEFT JOIN (SELECT {_ID} AS id, min(removed_at) AS first_removed FROM removals GROUP BY 1) r ON c.id = r.id),
refs AS (
  SELECT 'evaluations' AS src, CAST(attempt AS VARCHAR) AS src_key, {_ID} AS ref_id, evaluated_at AS ref_at FROM evaluations
  UNION ALL
  SELECT 'candidates', c, {sql_folded('p')}, created_at
  FROM (SELECT {_ID} AS c, unnest(parent_ids) AS p, created_at FROM candidates) WHERE c IS DISTINCT FROM {sql_folded('p')}
  UNION ALL
  SELECT 'workers', snapshot_id || ':' || e.key, {sql_folded('e.value.current_candidate_id')}, e.value.leased_at
  FROM (SELECT snapshot_id, unnest(map_entries(workers)) AS e FROM workers)),
found AS (
  SELECT DISTINCT src, src_key, ref_id,
    CASE WHEN id IS NULL THEN 'missing' WHEN first_removed <= ref_at THEN 'deleted' WHEN first_seen > ref_at THEN 'late' END AS kind,
    coalesce(strftime(ref_at AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS ref_month
  FROM refs LEFT JOIN dim ON ref_id = id WHERE coalesce(ref_id, '') <> '')"""

def _decoded(j: str) -> str:
    """The JSON that a JSON text holds, where it holds some."""
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND json_valid({j} ->> '$') THEN CAST({j} ->> '$' AS JSON) ELSE {j} END"


_NESTED = f"""
WITH whole AS (
  SELECT 'config_patch' AS col, seq AS k, config_patch AS t FROM candidates UNION ALL SELECT 'family_champions', snapshot_id, family_champions FROM frontier
  UNION ALL SELECT 'elite_archive', snapshot_id, elite_archive FROM frontier),
docs AS (SELECT DISTINCT col, k, {_decoded("j")} AS j FROM (SELECT col, k, CAST(t AS JSON) AS j FROM whole WHERE t <> '' AND json_valid(t))),
models AS (SELECT k, {_decoded("j")} AS m FROM (SELECT k, json_extract(j, '$.model') AS j FROM docs WHERE col = 'config_patch' AND json_type(j) = 'OBJECT')),
patched AS (
  SELECT k, '0' AS child, json_extract(m, '$.type') AS v FROM models WHERE json_type(m) = 'OBJECT'
  UNION ALL SELECT k, key, json_extract({_decoded("j")}, '$.type') FROM (SELECT k, e.key, e.value AS j FROM models, json_each(m) e WHERE json_type(m) = 'ARRAY')
  UNION ALL SELECT k, '0', json_extract(j, '$."model.type"') FROM docs WHERE col = 'config_patch' AND json_type(j) = 'OBJECT'),
champions AS (
  SELECT k, e.key AS family, json_extract(e.value, '$.candidate_id') AS v FROM docs, json_each(j) e WHERE col = 'family_champions' AND json_type(j) = 'OBJECT'
  UNION ALL SELECT k, e.value ->> '$.family', json_extract(e.value, '$.candidate_id') FROM docs, json_each(j) e WHERE col = 'family_champions' AND json_type(j) = 'ARRAY'),
lists AS (
  SELECT k, 'global' AS place, json_extract(j, '$.global') AS l FROM docs WHERE col = 'elite_archive' AND json_type(j) = 'OBJECT'
  UNION ALL SELECT k, 'families/' || e.key, e.value FROM (SELECT k, json_extract(j, '$.families') AS f FROM docs WHERE col = 'elite_archive' AND json_type(j) = 'OBJECT'), json_each(f) e WHERE json_type(f) = 'OBJECT'),
entries AS (SELECT k, place || '/' || e.key AS child, e.value AS e FROM lists, json_each(l) e WHERE json_type(l) = 'ARRAY'),
tests AS (SELECT k, child, t.key AS test, json_extract(t.value, '$.decisive') AS v FROM (SELECT k, child, json_extract(e, '$.prediction_scores') AS s FROM entries), json_each(s) t WHERE json_type(s) = 'OBJECT')
SELECT 'model' AS rel, CAST(k AS VARCHAR) AS parent_key, CAST(child AS VARCHAR) AS child_key, v ->> '$' AS found_text FROM patched WHERE json_type(v) = 'VARCHAR'
UNION SELECT 'stability', CAST(seq AS VARCHAR), 'runs', CAST(stability.runs AS VARCHAR) FROM candidates WHERE stability.runs IS NOT NULL
UNION SELECT 'family_champion', CAST(k AS VARCHAR), family, v ->> '$' FROM champions WHERE json_type(v) = 'VARCHAR' AND family IS NOT NULL
UNION SELECT 'elite', CAST(k AS VARCHAR), child, json_extract_string(e, '$.candidate_id') FROM entries WHERE json_type(json_extract(e, '$.candidate_id')) = 'VARCHAR'
UNION SELECT 'elite_test', k || '/' || child, test, CASE WHEN json_type(v) = 'BOOLEAN' THEN v ->> '$' ELSE '' END FROM tests"""

_TREE = f"""
WITH RECURSIVE link AS (
  SELECT {_ID} AS id, max({sql_folded("list_filter(parent_ids, lambda p: coalesce(" + sql_folded('p') + ", '') <> '')[1]")}) AS p
  FROM candidates WHERE coalesce({_ID}, '') <> '' GROUP BY 1),
edge AS (SELECT a.id, b.id AS up FROM link a LEFT JOIN link b ON a.p = b.id),
down AS (
  SELECT id, id AS root_id, 0 AS node_depth, id AS node_path FROM edge WHERE up IS NULL
  UNION ALL
  SELECT e.id, d.root_id, d.node_depth + 1, d.node_path || '/' || e.id FROM edge e JOIN down d ON e.up = d.id)"""
_PAIRS = """,
pairs AS (SELECT node_depth, id, unnest(string_split(node_path, '/')) AS above, unnest(range(node_depth + 1)) AS pos FROM down)"""

ORACLE = {
    "p1_found": _versions_sql({"status": _STATUS}, f"coalesce({_STATUS}, '') <> ''"),
    "p1_appended": _versions_sql({"status": _STATUS}, f"coalesce({_STATUS}, '') <> ''"),
    "p1_score_versions": _versions_sql(_ONE_SCORES),
    "p1_description_versions": _versions_sql(_ONE_TEXTS),
    "p1_change_rates": _CHANGE_RATES,
    "p2_found": _NESTED,
    "p3_found": f"WITH {_REFS} SELECT src, src_key, ref_id, kind, ref_month FROM found WHERE kind IS NOT NULL",
    "p3_counts": f"WITH {_REFS} SELECT src, kind, ref_month, count(*) AS n_orphans FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": f"""{_TREE}{_PAIRS},
below AS (SELECT above AS id, count(*) - 1 AS n FROM pairs GROUP BY 1),
loose AS (SELECT * FROM edge WHERE id NOT IN (SELECT id FROM down)),
reach AS (SELECT id, up FROM loose UNION SELECT r.id, l.up FROM reach r JOIN loose l ON r.up = l.id),
under AS (SELECT up AS id, count(DISTINCT id) AS n FROM reach GROUP BY 1)
SELECT id AS candidate_id, root_id, CAST(node_depth AS BIGINT) AS node_depth, CAST(n AS BIGINT) AS n_descendants, CAST(0 AS BIGINT) AS cycle_state
FROM down JOIN below USING (id)
UNION ALL
SELECT id, '', -1, CASE WHEN id IN (SELECT id FROM reach WHERE id = up) THEN -1 ELSE coalesce(n, 0) END,
       CASE WHEN id IN (SELECT id FROM reach WHERE id = up) THEN 1 ELSE 2 END
FROM loose LEFT JOIN under USING (id)""",
    "p4_paths": f"{_TREE} SELECT id AS candidate_id, CAST(node_depth AS BIGINT) AS node_depth, node_path FROM down",
    "p4_descendants": f"""{_TREE},
loose AS (SELECT * FROM edge WHERE id NOT IN (SELECT id FROM down)),
reach AS (SELECT id, up FROM loose UNION SELECT r.id, l.up FROM reach r JOIN loose l ON r.up = l.id),
ring AS (SELECT DISTINCT id FROM reach WHERE id = up),
above AS (
  SELECT id, up, 1 AS distance FROM edge WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM ring)
  UNION ALL
  SELECT a.id, e.up, distance + 1 FROM above a JOIN edge e ON e.id = a.up WHERE e.up IS NOT NULL AND e.up NOT IN (SELECT id FROM ring))
SELECT up AS ancestor_id, id AS candidate_id, CAST(distance AS BIGINT) AS distance FROM above""",
    "p5_found": f"""
WITH cur AS (
  SELECT candidate_id, family, selection_eval FROM (
    SELECT {_ID} AS candidate_id, {_FAMILY} AS family, selection_eval, row_number() OVER (PARTITION BY {_ID} ORDER BY updated_at DESC, seq DESC) AS n
    FROM candidates WHERE {_DATED}) WHERE n = 1)
SELECT family, rank_no, candidate_id FROM (
  SELECT family, candidate_id, row_number() OVER (PARTITION BY family ORDER BY selection_eval DESC, candidate_id) AS rank_no
  FROM cur WHERE coalesce(family, '') <> '' AND isfinite(selection_eval)) WHERE rank_no <= 3""",
}
