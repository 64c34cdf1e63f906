"""The engine's own operators bound to the project's tables, and the SQL that states the same.

PageRank runs to convergence; its SQL unrolls more rounds than that takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalar, vectors
from codeloom.functions.normal import filled, norm_id, norm_upper
from codeloom.operators import context, drift, federation, graph, impact, lookup, memory, resolve, rollup, store, temporal
from codeloom.plans.tables import table
from codeloom.session import materialize

ROUNDS = 60  # of PageRank that the SQL unrolls; all that is compared converges before
QUERIES: dict = {}
SQL: dict[str, str] = {}

_PAD = "' ' || chr(9) || chr(13) || chr(10)"
_CUR = f"""cur AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT lower(trim(id, {_PAD})) AS id, lower(trim(type, {_PAD})) AS type, name, file, signature, docstring, line_start, line_end, raw_text, embedding, calls, ordinal, repo_id, indexed_at, removed_at,
      row_number() OVER (PARTITION BY lower(trim(id, {_PAD})) ORDER BY indexed_at DESC NULLS LAST, landed_at DESC NULLS LAST) AS rn
    FROM nodes WHERE trim(id, {_PAD}) <> '')
  WHERE rn = 1 AND removed_at IS NULL)"""
_EDGES = f"""edge AS MATERIALIZED (
  SELECT DISTINCT lower(trim(src, {_PAD})) AS src, lower(trim(dst, {_PAD})) AS dst, upper(trim(relation, {_PAD})) AS relation
  FROM edges WHERE trim(src, {_PAD}) <> '' AND trim(dst, {_PAD}) <> '')"""
_CALLS = f"{_CUR}, {_EDGES}, call AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge WHERE relation = 'CALLS' AND src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur))"
_LINKS = f"{_CALLS}, link AS MATERIALIZED (SELECT src, dst FROM call UNION SELECT dst, src FROM call)"
_TOP = "(SELECT dst AS id FROM call GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n})"
_OK = "(len({v}) = 64 AND len(list_filter({v}, lambda x: coalesce(NOT isfinite(x), true))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"

_SHORT = ("name", "type", "file", "signature", "docstring", "line_start", "line_end", "repo_id", "calls", "ordinal")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def cur(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return store.current_nodes(table(spark, d, "nodes"), *(columns or _SHORT))


def edges(spark: SparkSession, d: str, relation: str | None = None) -> DataFrame:
    return store.current_edges(table(spark, d, "edges"), relation)


def most_called(nodes: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    return graph.existing_edges(nodes, calls).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


# ---------------------------------------------------------------- store and look-ups


@query(f"WITH {_CUR}, {_EDGES} SELECT (SELECT count(*) FROM cur) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM (SELECT file, arg_max(coalesce(lower(trim(hash, {_PAD})), '-'), (indexed_at, landed_at)) AS h FROM file_hashes WHERE trim(file, {_PAD}) <> '' GROUP BY 1) WHERE h <> '-') AS files_indexed")
def index_status(spark, d):
    return store.stats(cur(spark, d, "type"), edges(spark, d), store.current_hashes(table(spark, d, "file_hashes")))


@query(f"WITH {_CUR} SELECT id, type, name, file, line_start, indexed_at FROM cur")
def current_symbols(spark, d):
    return cur(spark, d, "type", "name", "file", "line_start", "indexed_at")


@query(f"WITH {_EDGES} SELECT * FROM edge")
def current_links(spark, d):
    return edges(spark, d)


@query(f"SELECT file, h AS hash FROM (SELECT file, arg_max(coalesce(lower(trim(hash, {_PAD})), '-'), (indexed_at, landed_at)) AS h FROM file_hashes WHERE trim(file, {_PAD}) <> '' GROUP BY 1) WHERE h <> '-'")
def current_hashes(spark, d):
    return store.current_hashes(table(spark, d, "file_hashes"))


@query(f"WITH {_CALLS} SELECT id, type, name, file, signature, line_start, line_end FROM cur WHERE id IN {_TOP.format(n=1)}")
def get_node(spark, d):
    n = cur(spark, d)
    return n.join(most_called(n, edges(spark, d, "CALLS"), 1), "id", "left_semi").select("id", "type", "name", "file", "signature", "line_start", "line_end")


@query(f"WITH {_CUR} SELECT id, type, name, file, line_start FROM cur WHERE name = 'get_value'")
def nodes_by_name(spark, d):
    return cur(spark, d).where("name = 'get_value'").select("id", "type", "name", "file", "line_start")


@query(f"WITH {_CUR} SELECT id, type, name, file, line_start FROM cur WHERE file = (SELECT file FROM cur WHERE file IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
def nodes_by_file(spark, d):
    n = cur(spark, d)
    most = n.where("file is not null").groupBy("file").count().orderBy(F.desc("count"), "file").limit(1).select("file")
    return n.join(most, "file", "left_semi").select("id", "type", "name", "file", "line_start")


@query(f"WITH {_CUR} SELECT name, count(*) AS symbols, min(id) AS first_id, count(DISTINCT file) AS files FROM cur WHERE type <> 'file' AND name IS NOT NULL GROUP BY 1")
def name_to_ids(spark, d):
    return lookup.names_to_ids(cur(spark, d))


@query(f"WITH {_CUR} SELECT name, id, file FROM cur WHERE type <> 'file' AND name IS NOT NULL")
def ids_by_name(spark, d):
    return lookup.ids_by_name(cur(spark, d))


@query(f"WITH {_CUR} SELECT id, len(embedding) AS dim FROM cur WHERE embedding IS NOT NULL")
def all_embeddings(spark, d):
    return cur(spark, d, "embedding").where("embedding is not null").select("id", F.size("embedding").cast("long").alias("dim"))


def _neighbours(this: str, other: str) -> str:
    return f"WITH {_CUR}, {_EDGES} SELECT e.{other} AS {this}, n.id, n.name, n.type, n.file, n.line_start AS line, n.signature FROM edge e JOIN cur n ON n.id = e.{'src' if other == 'dst' else 'dst'} JOIN cur t ON t.id = e.{other} WHERE e.relation = 'CALLS'"


@query(_neighbours("target", "dst"))
def callers(spark, d):
    n = cur(spark, d)
    return lookup.callers(n, edges(spark, d), n)


@query(_neighbours("source", "src"))
def callees(spark, d):
    n = cur(spark, d)
    return lookup.callees(n, edges(spark, d), n)


def _by_name(other: str) -> str:
    mine = "src" if other == "dst" else "dst"
    return f"""WITH {_CUR}, {_EDGES}, first AS (
      SELECT id, name AS "of" FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY file NULLS LAST, line_start NULLS LAST, id) AS r FROM cur WHERE name IS NOT NULL) WHERE r = 1)
    SELECT f."of", n.name, n.type, n.file, n.line_start AS line, n.signature FROM first f JOIN edge e ON e.{other} = f.id JOIN cur n ON n.id = e.{mine} WHERE e.relation = 'CALLS'"""


@query(_by_name("dst"))
def callers_by_name(spark, d):
    return lookup.callers_by_name(cur(spark, d), edges(spark, d))


@query(_by_name("src"))
def callees_by_name(spark, d):
    return lookup.callees_by_name(cur(spark, d), edges(spark, d))


@query(f"""WITH {_CUR} SELECT file, '# Symbol map: ' || file || chr(10) || chr(10) || string_agg(
  'L' || coalesce(CAST(line_start AS VARCHAR), '?') || '  ' || coalesce(nullif(signature, ''), concat_ws(' ', type, name)) ||
  CASE WHEN docstring <> '' THEN chr(10) || '      # ' || substr(docstring, 1, 100) ELSE '' END, chr(10) ORDER BY coalesce(line_start, 0), id) AS map
FROM cur WHERE type <> 'file' AND file IS NOT NULL GROUP BY file""")
def file_map(spark, d):
    return lookup.file_maps(cur(spark, d))


@query(f"""WITH {_CUR}, {_EDGES} SELECT id, name, type, file,
  (SELECT count(*) FROM edge e WHERE e.relation = 'CALLS' AND e.dst = cur.id AND e.src IN (SELECT id FROM cur)) AS n_callers,
  (SELECT count(*) FROM edge e WHERE e.relation = 'CALLS' AND e.src = cur.id AND e.dst IN (SELECT id FROM cur)) AS n_callees FROM cur""")
def node_detail(spark, d):
    return lookup.node_detail(cur(spark, d), edges(spark, d))


@query(f"""WITH {_CUR}, {_EDGES}, e AS (SELECT src, dst FROM edge WHERE relation = 'CALLS' AND src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur))
SELECT e.dst AS id, 'caller' AS role, n.id AS other, n.name, n.file FROM e JOIN cur n ON n.id = e.src UNION ALL SELECT e.src, 'callee', n.id, n.name, n.file FROM e JOIN cur n ON n.id = e.dst""")
def node_relations(spark, d):
    return lookup.node_relations(cur(spark, d), edges(spark, d))


@query(f"""WITH {_CUR}, {_EDGES}, part AS (SELECT id FROM cur WHERE contains(lower(file), '-web/') ORDER BY id LIMIT 100) SELECT src, dst, relation FROM edge WHERE src IN (SELECT id FROM part) AND dst IN (SELECT id FROM part)""")
def file_like_graph_first(spark, d):
    """The reference's limited form: of the files that match, the first symbols by id."""
    n = cur(spark, d)
    return lookup.induced(n, edges(spark, d), lookup.file_like(n, "-web/", 100))[1].select("src", "dst", "relation")


@query(f"WITH {_CUR}, {_EDGES}, part AS (SELECT id FROM cur WHERE contains(lower(file), '-web/')) SELECT src, dst, relation FROM edge WHERE src IN (SELECT id FROM part) AND dst IN (SELECT id FROM part)")
def file_like_graph(spark, d):
    n = cur(spark, d)
    return lookup.induced(n, edges(spark, d), lookup.file_like(n, "-web/"))[1].select("src", "dst", "relation")


@query(f"""WITH {_CALLS}, ids AS (SELECT src AS id, false AS seed FROM call WHERE dst IN {_TOP.format(n=3)} UNION ALL SELECT id, true FROM {_TOP.format(n=3)})
SELECT cur.id, name, type, file, bool_or(seed) AS seed FROM cur JOIN ids ON ids.id = cur.id GROUP BY ALL""")
def induced_subgraph(spark, d):
    n, e = cur(spark, d), edges(spark, d, "CALLS")
    top = most_called(n, e, 3)
    around = graph.existing_edges(n, e).join(top.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(False).alias("seed"))
    ids = around.unionByName(top.withColumn("seed", F.lit(True)))
    return lookup.induced(n, e, ids)[0].select("id", "name", "type", "file", "seed")


@query(f"""WITH {_CUR}, {_EDGES}, gone AS (SELECT DISTINCT file FROM cur WHERE contains(lower(file), 'test')), ids AS (SELECT id FROM cur WHERE file IN (SELECT file FROM gone))
SELECT (SELECT count(*) FROM cur WHERE file IS NULL OR file NOT IN (SELECT file FROM gone)) AS nodes, (SELECT count(*) FROM edge WHERE src NOT IN (SELECT id FROM ids) AND dst NOT IN (SELECT id FROM ids)) AS edges""")
def delete_files(spark, d):
    n = cur(spark, d)
    h = store.current_hashes(table(spark, d, "file_hashes"))
    left, links, _ = store.delete_files(n, edges(spark, d), h, lookup.file_like(n, "test").select("file"))
    return left.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(links.agg(F.count(F.lit(1)).alias("edges")))


# ---------------------------------------------------------------- scalars


@query(f"WITH {_CUR} SELECT id, substr(sha256(file || '::' || type || '::' || name || '::' || CAST(line_start AS VARCHAR)), 1, 16) AS made FROM cur")
def symbol_ids(spark, d):
    return cur(spark, d).select("id", scalar.symbol_id("file", "type", "name", "line_start").alias("made"))


_EMBED = "CASE WHEN nullif(signature, '') IS NULL AND nullif(docstring, '') IS NULL THEN concat_ws(' ', type, name) ELSE concat_ws(' ', nullif(signature, ''), nullif(docstring, '')) END"


@query(f"WITH {_CUR} SELECT id, {_EMBED} AS text, CAST(length({_EMBED}) // 4 AS INTEGER) AS tokens FROM cur")
def embed_texts(spark, d):
    t = scalar.embed_text("type", "name", "signature", "docstring")
    return cur(spark, d).select("id", t.alias("text"), scalar.token_estimate(t).alias("tokens"))


_SERIAL = """concat_ws(chr(10), '# ' || coalesce(file, '') || ':' || coalesce(CAST(line_start AS VARCHAR), '') || '-' || coalesce(CAST(line_end AS VARCHAR), ''),
  coalesce(nullif(signature, ''), concat_ws(' ', type, name)),
  CASE WHEN docstring <> '' THEN '  \"\"\"' || CASE WHEN length(docstring) > 200 THEN substr(docstring, 1, 200) || '...' ELSE docstring END || '\"\"\"' END)"""


@query(f"WITH {_CUR} SELECT id, {_SERIAL} AS text FROM cur")
def serialize_nodes(spark, d):
    return cur(spark, d).select("id", scalar.serialize_symbol("type", "name", "file", "line_start", "line_end", "signature", "docstring").alias("text"))


_NAME = r"regexp_extract({p}, '([^/]*)/*$', 1)"
_STEM = r"regexp_replace(regexp_extract({p}, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1')"
_TEST = f"(contains(lower({_STEM.format(p='file')}), 'test') OR contains(lower(CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END), 'test') OR starts_with(name, 'test_') OR starts_with(name, 'Test'))"


@query(f"WITH {_CUR} SELECT id, {_TEST} AS has_test, {_STEM.format(p='file')} AS stem FROM cur")
def test_coverage(spark, d):
    return cur(spark, d).select("id", scalar.has_test("file", "name").alias("has_test"), scalar.stem("file").alias("stem"))


# ---------------------------------------------------------------- resolution


@query(f"""WITH {_CUR}, last AS (SELECT file, name AS callee, arg_max(id, (coalesce(ordinal, -1), line_start, id)) AS dst FROM cur WHERE type <> 'file' AND name IS NOT NULL GROUP BY 1, 2),
calls AS (SELECT DISTINCT id, name, file, unnest(calls) AS callee FROM cur)
SELECT DISTINCT c.id AS src, l.dst FROM calls c JOIN last l ON l.file = c.file AND l.callee = c.callee WHERE c.callee <> c.name""")
def resolve_intra(spark, d):
    return resolve.resolve_intra(cur(spark, d))


_CROSS = "found AS (SELECT DISTINCT c.id AS src, n.id AS dst FROM (SELECT id, file, unnest(calls) AS callee FROM cur) c JOIN cur n ON n.name = c.callee WHERE n.type <> 'file' AND n.file <> c.file)"


@query(f"WITH {_CUR}, {_CROSS} SELECT * FROM found")
def resolve_cross(spark, d):
    return resolve.resolve_cross(cur(spark, d))


@query(f"WITH {_CUR}, {_EDGES}, {_CROSS} SELECT (SELECT count(*) FROM found) AS attempts, (SELECT count(*) FROM found f WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.relation = 'CALLS' AND e.src = f.src AND e.dst = f.dst)) AS fresh")
def resolve_report(spark, d):
    return resolve.resolve_counts(cur(spark, d), edges(spark, d))


@query(f"WITH {_CUR}, line AS (SELECT '+' || unnest(string_split(replace(raw_text, chr(13), ''), chr(10))) AS line FROM cur WHERE raw_text IS NOT NULL) SELECT DISTINCT regexp_extract(line, '^\\+\\s*(?:def|class)\\s+(\\w+)', 1) AS name FROM line WHERE regexp_matches(line, '^\\+\\s*(?:def|class)\\s+(\\w+)')")
def diff_names(spark, d):
    text = F.concat(F.lit("+"), F.replace(F.replace("raw_text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\n+")))
    return resolve.diff_names(cur(spark, d, "raw_text"), text)


# ---------------------------------------------------------------- graph


@query(f"WITH {_LINKS} SELECT * FROM link")
def graph_symmetrize(spark, d):
    return graph.symmetrize(cur(spark, d, "type"), edges(spark, d, "CALLS"))


_BFS = f"""bfs AS (SELECT id, 0 AS hop FROM {_TOP.format(n=1)} UNION SELECT l.dst, b.hop + 1 FROM bfs b JOIN {{t}} l ON l.src = b.id WHERE b.hop < {{depth}}), hops AS (SELECT id, min(hop) AS hop FROM bfs GROUP BY 1)"""


@query(f"WITH RECURSIVE {_LINKS}, {_BFS.format(t='link', depth=4)} SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def bfs_hops(spark, d):
    n, e = materialize(cur(spark, d, "type"), "cur"), materialize(edges(spark, d, "CALLS"), "calls")
    links = materialize(graph.symmetrize(n, e), "links")
    return graph.bfs(links, most_called(n, e, 1), 4)


def _rank(seeds: str, vertices: str = "cur", links: str = "link", tag: str = "r") -> str:
    """CTEs of power iteration; the last is ``ranked`` (id, score).

    Scores stay as they are from the round on in which their summed change falls
    below 1e-6 times the number of vertices.
    """
    out = [
        f"{tag}n AS (SELECT count(*) AS n FROM {vertices})",
        f"{tag}w AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM {links})",
        f"{tag}b AS MATERIALIZED (SELECT v.id, {seeds} AS p, v.id IN (SELECT src FROM {links}) AS has FROM {vertices} v, {tag}n)",
        f"{tag}0 AS (SELECT id, 1.0::DOUBLE / n AS score, false AS done FROM {tag}b, {tag}n)",
    ]
    for i in range(1, ROUNDS + 1):
        p = f"{tag}{i - 1}"
        out.append(
            f"{tag}{i} AS MATERIALIZED (SELECT id, CASE WHEN was THEN old ELSE new END AS score, was OR sum(abs(new - old)) OVER () < 1e-6 * n AS done FROM ("
            f"SELECT b.id, o.score AS old, o.done AS was, 0.85::DOUBLE * (coalesce(f.got, 0) + l.lost * b.p) + (1 - 0.85::DOUBLE) * b.p AS new FROM {tag}b b JOIN {p} o ON o.id = b.id "
            f"LEFT JOIN (SELECT w.dst AS id, sum(r.score * w.w) AS got FROM {p} r JOIN {tag}w w ON w.src = r.id GROUP BY 1) f ON f.id = b.id, "
            f"(SELECT coalesce(sum(r.score), 0) AS lost FROM {p} r JOIN {tag}b b ON b.id = r.id WHERE NOT b.has) l), {tag}n)"
        )
    return ", ".join(out) + f", ranked AS (SELECT id, score FROM {tag}{ROUNDS})"


_SEED5 = f"CASE WHEN v.id IN {_TOP.format(n=5)} THEN 0.2::DOUBLE ELSE 0 END"
_SEED1 = f"CASE WHEN v.id IN {_TOP.format(n=1)} THEN 1.0::DOUBLE ELSE 0 END"


@query(f"WITH {_LINKS}, {_rank(_SEED5)} SELECT id, round(score, 8) AS score FROM ranked")
def ppr(spark, d):
    n, e = materialize(cur(spark, d, "type"), "cur"), materialize(edges(spark, d, "CALLS"), "calls")
    seeds = most_called(n, e, 5).withColumn("p", F.lit(1.0))
    return graph.pagerank(n, graph.symmetrize(n, e), seeds).select("id", F.round("score", 8).alias("score"))


_EGO = f"WITH RECURSIVE {_LINKS}, {_BFS.format(t='link', depth=2)}, ego AS MATERIALIZED (SELECT id FROM hops), inner_link AS MATERIALIZED (SELECT src, dst FROM link WHERE src IN (SELECT id FROM ego) AND dst IN (SELECT id FROM ego)), {_rank('1.0::DOUBLE / n', 'ego', 'inner_link')}"


@query(f"{_EGO} SELECT id, round(score, 8) AS score FROM ranked")
def pagerank_subgraph(spark, d):
    n, e = materialize(cur(spark, d, "type"), "cur"), materialize(edges(spark, d, "CALLS"), "calls")
    links = materialize(graph.symmetrize(n, e), "links")
    return graph.local_pagerank(links, most_called(n, e, 1), 2).select("id", F.round("score", 8).alias("score"))


# ---------------------------------------------------------------- impact


def _impact(t: str, start: str = _TOP.format(n=1)) -> str:
    back = ", back AS MATERIALIZED (SELECT dst AS src, src AS dst FROM call)" if t == "back" else ""
    walk = _BFS.format(t=t, depth=10).replace(_TOP.format(n=1), "start")
    seeds = "CASE WHEN v.id IN (SELECT id FROM start) THEN 1.0::DOUBLE / (SELECT count(*) FROM start) ELSE 0 END"
    return f"""WITH RECURSIVE {_LINKS}{back}, start AS MATERIALIZED (SELECT id FROM {start}), {walk}, {_rank(seeds)},
    affected AS MATERIALIZED (SELECT c.id, name, file, line_start AS line, type, CAST(hop AS INTEGER) AS hop, round(coalesce(score, 0), 6) AS risk_score, {_TEST} AS has_test
      FROM hops h JOIN cur c ON c.id = h.id LEFT JOIN ranked r ON r.id = c.id WHERE hop > 0),
    high AS (SELECT * FROM affected WHERE NOT has_test AND risk_score >= 0.3 * (SELECT max(risk_score) FROM affected)),
    s AS (SELECT count(*) AS n, sum(CASE WHEN has_test THEN 0 ELSE 1 END) AS untested, (SELECT count(*) FROM start) AS changed FROM affected),
    g AS (SELECT 2 * count(*) AS degree FROM link WHERE src IN (SELECT id FROM start)),
    score AS (SELECT CAST(least(round_even(round((0.4 * least(n / 50, 1.0) + 0.4 * untested / n + 0.2 * least(degree / changed / 20, 1.0)) * 100, 9), 0), 100) AS INTEGER) AS risk_score FROM s, g)"""


_REPORT = """SELECT CAST(changed AS BIGINT) AS changed, n AS blast_radius, n AS affected, CAST(untested AS BIGINT) AS untested, risk_score, (SELECT count(*) FROM high) AS high_risk,
    'Risk: ' || CASE WHEN risk_score < 30 THEN 'LOW' WHEN risk_score < 60 THEN 'MEDIUM' ELSE 'HIGH' END || ' (' || risk_score || '/100). This change touches ' || changed || ' node(s), affecting ' || n || ' downstream caller(s).' AS summary FROM s, score"""


def _blast(spark, d, direction="both"):
    n, e = materialize(cur(spark, d), "cur"), materialize(edges(spark, d), "edges")
    return impact.blast_radius(n, e, most_called(n, e.where("relation = 'CALLS'"), 1), direction=direction)


@query(f"{_impact('link')} SELECT * FROM affected")
def blast_radius(spark, d):
    return _blast(spark, d).affected


@query(f"{_impact('back')} SELECT * FROM affected")
def blast_radius_callers(spark, d):
    return _blast(spark, d, "callers").affected


@query(f"{_impact('link')} SELECT id, name, file, line, risk_score FROM high")
def untested_high_risk(spark, d):
    return _blast(spark, d).high_risk.select("id", "name", "file", "line", "risk_score")


@query(f"{_impact('link')} {_REPORT}")
def risk_report(spark, d):
    return _blast(spark, d).report


@query(
    f"""{_impact('link')}, risky AS (SELECT string_agg('    - ' || coalesce(name, 'null') || ' (' || coalesce(file, 'null') || ':' || coalesce(CAST(line AS VARCHAR), 'null') || ')', chr(10) ORDER BY risk_score DESC, id) AS t FROM (SELECT * FROM high ORDER BY risk_score DESC, id LIMIT 5)),
    topmost AS (SELECT string_agg('    ' || CASE WHEN has_test THEN '[x]' ELSE '[ ]' END || ' ' || coalesce(rpad(name, 30, ' '), 'null') || ' risk=' || printf('%.3f', risk_score) || '  ' || coalesce(file, 'null'), chr(10) ORDER BY risk_score DESC, id) AS t FROM (SELECT * FROM affected ORDER BY risk_score DESC, id LIMIT 8))
    SELECT concat_ws(chr(10), 'Impact Analysis' || chr(10) || '  Changed nodes  : ' || changed || chr(10) || '  Blast radius   : ' || n || ' functions affected' || chr(10) || '  Risk score     : ' || risk_score || '/100',
      '  Untested high-risk nodes:' || chr(10) || risky.t, chr(10) || '  Top affected (by risk):' || chr(10) || topmost.t) AS text FROM s, score, risky, topmost"""
)
def impact_text(spark, d):
    return impact.impact_text(_blast(spark, d))


@query(f"""{_impact('link', "cur WHERE name IN ('get_value', 'Missing')")} {_REPORT}""")
def impact_from_diff(spark, d):
    diff = spark.createDataFrame([("--- a\n+++ b\n+def get_value(x):\n+    return x\n+class Missing:\n def kept():",)], "text string")
    return impact.from_diff(materialize(cur(spark, d), "cur"), edges(spark, d), diff).report


# ---------------------------------------------------------------- vectors and context


@query(
    """WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def vector_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_k(e.where("id % 50 = 0"), e, 10).select("query", "id", F.round("score", 4).alias("score"), "rank")


_SCORED = f"""s AS (SELECT q.vec_id AS query, c.id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, cur c WHERE {{which}} AND {_OK.format(v='c.embedding')}),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)"""


@query(f"WITH {_CUR}, {_SCORED.format(which='q.vec_id % 50 = 0')} SELECT query, id, name, type, file, line_start AS line, signature, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM top JOIN cur USING (id) WHERE rank <= 10")
def search_symbols(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), "embedding")
    n = materialize(cur(spark, d, "name", "type", "file", "line_start", "signature", "embedding"), "cur")
    return context.search_symbols(n, q)




@query("WITH t AS (SELECT doc_id, CAST(length(coalesce(text, '')) // 4 AS INTEGER) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (ORDER BY doc_id) AS total FROM t) SELECT doc_id, tokens, CAST(total AS BIGINT) AS total FROM r WHERE total <= 100000")
def context_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", scalar.token_estimate("text").alias("tokens"))
    return context.within_budget(docs, 100_000, None, [F.col("doc_id")], range_of=F.floor(F.col("doc_id") / 1024)).select("doc_id", "tokens", "total")


_CONTEXT = f"""WITH {_LINKS}, {_SCORED.format(which='q.vec_id = 0')}, seed AS MATERIALIZED (SELECT id, score, rank FROM top WHERE rank <= 5),
    {_rank("CASE WHEN v.id IN (SELECT id FROM seed) THEN 1.0::DOUBLE / (SELECT count(*) FROM seed) ELSE 0 END")},
    ppr AS (SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM ranked ORDER BY rank LIMIT 25),
    pool AS (SELECT id, score, rank AS place, 0 AS part FROM seed UNION ALL SELECT id, 0.8::DOUBLE * score, rank, 1 FROM ppr),
    one AS (SELECT id, part, place, score FROM pool QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, place) = 1),
    merged AS (SELECT id, score, row_number() OVER (ORDER BY part, place) AS place FROM one),
    shown AS (SELECT m.place, m.id, cur.name, m.score, {_SERIAL} AS text FROM merged m JOIN cur ON cur.id = m.id WHERE cur.type <> 'file'),
    counted AS (SELECT *, CAST(length(text) // 4 AS INTEGER) AS tokens, sum(length(text) // 4) OVER (ORDER BY place) AS total FROM shown),
    kept AS (SELECT * FROM counted WHERE total <= 4000)"""


def _context(spark, d):
    n = materialize(cur(spark, d, *_SHORT, "embedding"), "cur")
    q = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("vec_id").alias("id"), "embedding")
    return context.get_context(n, edges(spark, d), q)


@query(f"{_CONTEXT} SELECT CAST(place AS INTEGER) AS place, id, name, round(score, 6) AS score, tokens, CAST(total AS BIGINT) AS total, text FROM kept")
def get_context(spark, d):
    return _context(spark, d)[0]


@query(f"{_CONTEXT} SELECT '# context - ' || count(*) || ' symbols, ~' || sum(tokens) || ' tokens' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY place) AS context, CAST(sum(tokens) AS BIGINT) AS tokens, (SELECT count(*) FROM merged) AS nodes, count(*) AS included FROM kept")
def get_context_report(spark, d):
    return _context(spark, d)[1]


# ---------------------------------------------------------------- drift


_DRIFT = (
    f"""WITH {_CALLS}, linked AS (SELECT c.src, n.embedding AS v FROM call c JOIN cur n ON n.id = c.dst),
    n AS (SELECT src, count(*) AS callees FROM linked GROUP BY 1 HAVING count(*) >= 2),
    per AS (SELECT src, pos, avg(x::DOUBLE) AS x FROM (SELECT src, unnest(v) AS x, unnest(range(len(v))) AS pos FROM linked WHERE {_OK.format(v='v')}) GROUP BY 1, 2),
    mean AS (SELECT src, list(x ORDER BY pos) AS m FROM per GROUP BY 1),
    d AS (SELECT c.id AS node_id, c.name, c.file, c.line_start AS line, n.callees, 1 - list_dot_product(c.embedding::DOUBLE[], m) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) / sqrt(list_dot_product(m, m)) AS score, round(score, 4) AS drift_score
      FROM cur c JOIN n ON n.src = c.id JOIN mean ON mean.src = c.id WHERE c.type IN ('function', 'method') AND {_OK.format(v='c.embedding')} AND list_dot_product(m, m) > 0),
    far AS (SELECT * FROM d WHERE drift_score >= 0.35)"""
)


@query(f"{_DRIFT} SELECT * EXCLUDE (score) FROM far")
def drift_audit(spark, d):
    n = materialize(cur(spark, d, "type", "name", "file", "line_start", "embedding"), "cur")
    return drift.drift(n, materialize(graph.existing_edges(n, edges(spark, d, "CALLS")), "calls").withColumn("relation", F.lit("CALLS")))


_SCORE2 = "printf('%.2f', f.score)"


@query(
    f"""{_DRIFT}, called AS (SELECT c.src, list(n.name ORDER BY n.name) FILTER (WHERE n.name IS NOT NULL) AS names FROM call c JOIN cur n ON n.id = c.dst GROUP BY 1)
    SELECT f.node_id, f.name, f.file, f.line, f.drift_score, concat_ws(' ', f.name, c.docstring) AS declared_intent, array_to_string(names, ', ') AS actual_callees,
      concat_ws(' ', 'Semantic drift (' || CASE WHEN f.score < 0.5 THEN 'mild' WHEN f.score < 0.7 THEN 'moderate' ELSE 'severe' END || ', score=' || {_SCORE2} || ').',
        CASE WHEN coalesce(c.docstring, '') <> '' THEN '"' || f.name || '" declares: "' || substr(c.docstring, 1, 80) || '"' ELSE '"' || f.name || '" has no docstring.' END,
        'But calls: ' || array_to_string(names[1:5], ', ') || CASE WHEN len(names) > 5 THEN ' +' || (len(names) - 5) || ' more' ELSE '' END || '.', 'Name/docstring may not reflect actual responsibilities.') AS explanation
    FROM far f JOIN called ON called.src = f.node_id JOIN cur c ON c.id = f.node_id"""
)
def drift_report(spark, d):
    n = materialize(cur(spark, d, *_SHORT, "embedding"), "cur")
    return drift.drift_report(n, graph.existing_edges(n, edges(spark, d, "CALLS")).withColumn("relation", F.lit("CALLS")))


# ---------------------------------------------------------------- history


def _history(spark, d):
    """A day of indexing stands for a commit."""
    n = table(spark, d, "nodes").where(filled("id") & F.col("file").isNotNull() & F.col("indexed_at").isNotNull())
    day = F.date_trunc("day", F.col("indexed_at").cast("timestamp")).cast("timestamp_ntz")
    n = n.withColumn("ts", day).withColumn("seq", F.datediff(day, F.lit("2000-01-01"))).withColumn("sha", F.substring(F.md5(F.date_format(day, "yyyy-MM-dd")), 1, 8))
    seen = n.where("removed_at is null").select(norm_id("id").alias("node_id"), "name", "file", norm_id("type").alias("type"), "seq", "ts", "sha")
    return seen, n.select("file", "seq", "ts", "sha").distinct()


_HIST = f"""hist AS (SELECT lower(trim(id, {_PAD})) AS node_id, name, file, lower(trim(type, {_PAD})) AS type, removed_at, date_trunc('day', indexed_at)::TIMESTAMP AS ts, date_diff('day', DATE '2000-01-01', indexed_at::DATE) AS seq,
    substr(md5(strftime(indexed_at, '%Y-%m-%d')), 1, 8) AS sha FROM nodes WHERE trim(id, {_PAD}) <> '' AND file IS NOT NULL AND indexed_at IS NOT NULL),
  seen AS (SELECT DISTINCT node_id, name, file, type, seq, ts, sha FROM hist WHERE removed_at IS NULL),
  touches AS (SELECT DISTINCT file, seq, ts, sha FROM hist),
  nxt AS (SELECT file, seq, lead(ts) OVER (PARTITION BY file ORDER BY seq) AS nts, lead(sha) OVER (PARTITION BY file ORDER BY seq) AS nsha, lead(seq) OVER (PARTITION BY file ORDER BY seq) AS nseq FROM touches),
  life AS (SELECT node_id, arg_max(name, seq) AS name, arg_max(file, seq) AS file, arg_max(type, seq) AS type, min(ts) AS first_seen_ts, max(ts) AS t, arg_min(sha, seq) AS first_commit, arg_max(sha, seq) AS c, max(seq) AS seq, count(DISTINCT seq) AS change_count FROM seen GROUP BY 1),
  lives AS (SELECT node_id, name, l.file, type, first_seen_ts, coalesce(nts, t) AS last_seen_ts, first_commit, coalesce(nsha, c) AS last_commit, change_count, round(change_count / (SELECT count(DISTINCT seq) FROM touches), 4) AS volatility
    FROM life l LEFT JOIN nxt ON nxt.file = l.file AND nxt.seq = l.seq)"""


@query(f"WITH {_HIST} SELECT * FROM lives")
def volatility(spark, d):
    return temporal.timeline(*_history(spark, d))


@query(f"WITH {_HIST} SELECT node_id, name, file, change_count, volatility FROM lives ORDER BY volatility DESC, node_id LIMIT 20")
def volatile_top(spark, d):
    return temporal.timeline(*_history(spark, d)).orderBy(F.desc("volatility"), "node_id").limit(20).select("node_id", "name", "file", "change_count", "volatility")


@query(f"SELECT lower(trim(src, {_PAD})) AS src, lower(trim(dst, {_PAD})) AS dst, upper(trim(relation, {_PAD})) AS relation, min(landed_at) AS first_seen_ts, max(landed_at) AS last_seen_ts FROM edges WHERE trim(src, {_PAD}) <> '' AND trim(dst, {_PAD}) <> '' GROUP BY 1, 2, 3")
def edge_lifetimes(spark, d):
    e = table(spark, d, "edges").where(filled("src") & filled("dst"))
    return temporal.edge_lifetimes(e.select(norm_id("src").alias("src"), norm_id("dst").alias("dst"), norm_upper("relation").alias("relation"), F.col("landed_at").alias("ts")))


@query(
    f"""WITH {_HIST}, here AS (SELECT DISTINCT node_id, file, seq FROM seen), before AS (SELECT h.node_id, h.file, n.nseq AS seq FROM here h JOIN nxt n ON n.file = h.file AND n.seq = h.seq WHERE nseq IS NOT NULL)
    SELECT file, CAST(seq AS INTEGER) AS seq, CAST(sum(CASE WHEN a AND NOT b THEN 1 ELSE 0 END) AS BIGINT) AS appeared, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN b AND NOT a THEN 1 ELSE 0 END) AS BIGINT) AS gone
    FROM (SELECT coalesce(h.file, b.file) AS file, coalesce(h.seq, b.seq) AS seq, h.node_id IS NOT NULL AS a, b.node_id IS NOT NULL AS b FROM here h FULL JOIN before b ON b.node_id = h.node_id AND b.file = h.file AND b.seq = h.seq) GROUP BY 1, 2"""
)
def snapshot_changes(spark, d):
    return temporal.snapshot_changes(*_history(spark, d))


@query(f"WITH {_HIST} SELECT a.file AS file_a, b.file AS file_b, count(*) AS cochange_count FROM lives a JOIN lives b ON a.file < b.file AND abs(epoch_us(a.last_seen_ts) - epoch_us(b.last_seen_ts)) < 86400000000 GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def coupling_pairs(spark, d):
    return temporal.coupling_pairs(temporal.timeline(*_history(spark, d)))


_TOUCH = "t AS (SELECT DISTINCT file, repo_id || '@' || strftime(indexed_at, '%Y-%m-%d') AS seq FROM file_hashes WHERE file IS NOT NULL AND repo_id IS NOT NULL AND indexed_at IS NOT NULL)"


@query(f"WITH {_TOUCH} SELECT a.file AS file_a, b.file AS file_b, count(*) AS commits FROM t a JOIN t b ON a.seq = b.seq AND a.file < b.file GROUP BY 1, 2")
def cochange_pairs(spark, d):
    t = table(spark, d, "file_hashes").where("file is not null and repo_id is not null and indexed_at is not null")
    return temporal.cochange_pairs(t.select("file", F.concat("repo_id", F.lit("@"), F.date_format("indexed_at", "yyyy-MM-dd")).alias("seq")), at_least=1)


@query(f"WITH {_HIST}, {_EDGES} SELECT (SELECT count(DISTINCT seq) FROM touches) AS commits_processed, (SELECT count(*) FROM lives) AS nodes_tracked, (SELECT count(*) FROM edge) AS edges_tracked")
def timeline_summary(spark, d):
    seen, touches = _history(spark, d)
    return temporal.summary(temporal.timeline(seen, touches), edge_lifetimes(spark, d), touches)


# ---------------------------------------------------------------- federation

_ENTRY = " OR ".join(f"contains(lower({_STEM.format(p='file')}), '{w}')" for w in scalar.ENTRY_WORDS)
_BOUND = f"""links AS (
    SELECT id AS node_id, repo_id, name, file, type, 1 AS o, 'ENDPOINT' AS link_type, 'endpoint:' || lower(name) AS link_key FROM b WHERE {_ENTRY}
    UNION ALL SELECT id, repo_id, name, file, type, 2, 'EXPORT', 'export:' || name FROM b WHERE {_NAME.format(p='file')} = '__init__.py'
    UNION ALL SELECT id, repo_id, name, file, type, 3, 'GRPC', 'grpc:' || name FROM b WHERE contains(signature, 'Servicer') OR contains(signature, 'grpc')
    UNION ALL SELECT id, repo_id, name, file, type, 4, 'NAME_MATCH', 'fn:' || name FROM b WHERE type IN ('function', 'method') AND NOT starts_with(name, '_')),
  bound AS MATERIALIZED (SELECT * EXCLUDE (o) FROM links QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY o DESC) = 1)"""
_FED = f"{_CUR}, b AS (SELECT id, repo_id, coalesce(name, '') AS name, file, type, coalesce(signature, '') AS signature FROM cur WHERE type IN ('function', 'method', 'class') AND file IS NOT NULL), {_BOUND}"
_XEDGES = f"""x AS MATERIALIZED (SELECT a.repo_id AS src_repo, a.node_id AS src_node, o.repo_id AS dst_repo, o.node_id AS dst_node, a.link_type,
    max(CASE WHEN a.link_type IN ('ENDPOINT', 'GRPC', 'EXPORT') THEN 0.9::DOUBLE WHEN {_STEM.format(p='a.file')} = {_STEM.format(p='o.file')} THEN 0.75 ELSE 0.6 END) AS confidence
    FROM bound a JOIN bound o ON a.link_key = o.link_key AND a.repo_id <> o.repo_id GROUP BY 1, 2, 3, 4, 5)"""


def _bound(spark, d, mode="last"):
    return federation.boundary_nodes(cur(spark, d), mode)


@query(f"WITH {_FED} SELECT * FROM bound")
def boundary_nodes(spark, d):
    return _bound(spark, d)


@query(f"WITH {_FED} SELECT * EXCLUDE (o) FROM links")
def boundary_links(spark, d):
    return _bound(spark, d, "all")


@query(f"WITH {_FED}, {_XEDGES} SELECT * FROM x")
def cross_edges(spark, d):
    return federation.cross_edges(_bound(spark, d))


@query(f"WITH {_FED}, {_XEDGES} SELECT src_repo, dst_repo, CAST(count(*) AS BIGINT) AS links FROM x GROUP BY 1, 2")
def cross_repo_counts(spark, d):
    return federation.cross_counts(_bound(spark, d))


_FEDLINKS = f"""{_FED}, {_XEDGES}, {_EDGES}, key AS (SELECT id, concat_ws(':', coalesce(repo_id, ''), id) AS key FROM cur),
  fed AS MATERIALIZED (SELECT DISTINCT a.key AS src, k.key AS dst FROM edge e JOIN key a ON a.id = e.src JOIN key k ON k.id = e.dst WHERE e.relation = 'CALLS'
    UNION SELECT src_repo || ':' || src_node, dst_repo || ':' || dst_node FROM x)"""


@query(f"WITH {_FEDLINKS} SELECT * FROM fed")
def federated_graph(spark, d):
    n = materialize(cur(spark, d), "cur")
    return federation.federated_links(n, edges(spark, d), federation.cross_edges(federation.boundary_nodes(n)))


_MOST = "(SELECT e.src AS id FROM edge e WHERE e.relation = 'CALLS' AND e.src IN (SELECT id FROM cur) AND e.dst IN (SELECT id FROM cur) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    f"""WITH RECURSIVE {_FEDLINKS}, walk AS (SELECT key AS id, 0 AS hop FROM key WHERE id IN {_MOST} UNION SELECT f.dst, w.hop + 1 FROM walk w JOIN fed f ON f.src = w.id WHERE w.hop < 5),
    least AS (SELECT id, min(hop) AS hop FROM walk GROUP BY 1)
    SELECT coalesce(c.repo_id, '') AS repo, c.id AS node_id, c.name, c.file, CAST(hop AS INTEGER) AS hop FROM least l JOIN key k ON k.key = l.id JOIN cur c ON c.id = k.id"""
)
def trace_cross_repo(spark, d):
    n, e = materialize(cur(spark, d), "cur"), edges(spark, d)
    links = materialize(federation.federated_links(n, e, federation.cross_edges(federation.boundary_nodes(n))), "fed")
    start = graph.existing_edges(n, e.where("relation = 'CALLS'")).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1)
    return federation.trace(n, links, start)


# ---------------------------------------------------------------- memory

_SESS = "sess AS (SELECT doc_id AS id, repo_id AS project, text AS summary, created_at FROM documents), newest AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id) AS age_rank FROM sess)"


def _sessions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("repo_id").alias("project"), F.col("text").alias("summary"), "created_at")


@query(f"WITH {_SESS} SELECT id, project, created_at, CAST(age_rank AS INTEGER) AS age_rank FROM newest WHERE age_rank <= 20")
def session_list(spark, d):
    return memory.newest(_sessions(spark, d), 20).select("id", "project", "created_at", "age_rank")


@query(f"WITH {_SESS} SELECT id, project, created_at FROM newest WHERE age_rank <= 100 AND starts_with(CAST(id AS VARCHAR), '12')")
def session_prefix(spark, d):
    return memory.by_prefix(_sessions(spark, d), "12").select("id", "project", "created_at")


@query(f"WITH {_SESS} SELECT project, '# Prior session memory' || chr(10) || string_agg(chr(10) || '## Session ' || substr(CAST(id AS VARCHAR), 1, 8) || ' (' || coalesce(strftime(created_at, '%Y-%m-%d'), '?') || ')' || chr(10) || coalesce(summary, ''), chr(10) ORDER BY age_rank) AS text FROM newest WHERE age_rank <= 3 GROUP BY 1")
def session_injection(spark, d):
    return memory.for_injection(memory.newest(_sessions(spark, d), 3))


@query("SELECT doc_id AS id, repo_id AS project, created_at FROM documents")
def session_upsert(spark, d):
    s = _sessions(spark, d)
    older = s.withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 1 DAY")).withColumn("project", F.lit("old"))
    return memory.save(older, s).select("id", "project", "created_at")


@query(
    f"""WITH {_CUR}, q AS (SELECT repo_id AS project, arg_min(embedding, id)::DOUBLE[] AS query FROM cur WHERE {_OK.format(v='embedding')} AND repo_id IS NOT NULL GROUP BY 1),
    newest AS (SELECT id, repo_id AS project, embedding, row_number() OVER (PARTITION BY repo_id ORDER BY indexed_at DESC NULLS LAST, id) AS age_rank FROM cur),
    s AS (SELECT n.id, n.project, n.age_rank, CASE WHEN {_OK.format(v='n.embedding')} THEN round(list_dot_product(n.embedding::DOUBLE[], q.query), 9) END AS score FROM newest n JOIN q ON q.project = n.project WHERE n.age_rank <= 50),
    kept AS (SELECT *, max(score IS NOT NULL) OVER (PARTITION BY project) AS any_score FROM s),
    top AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC NULLS LAST, age_rank) AS best FROM kept WHERE score IS NOT NULL OR NOT any_score)
    SELECT project, id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY project ORDER BY age_rank) AS INTEGER) AS recall_rank FROM top WHERE best <= 3"""
)
def session_recall(spark, d):
    n = materialize(cur(spark, d, "repo_id", "indexed_at", "embedding"), "cur")
    s = n.select("id", F.col("repo_id").alias("project"), F.col("indexed_at").alias("created_at"), "embedding")
    q = s.where(vectors.usable("embedding") & F.col("project").isNotNull()).groupBy("project").agg(F.min_by("embedding", "id").alias("query"))
    return memory.recall(s, q)


# ---------------------------------------------------------------- roll-ups

_FOLDER = "CASE WHEN contains({f}, '/') THEN split_part({f}, '/', 1) ELSE '(root)' END"


@query(f"WITH {_CUR} SELECT {_FOLDER.format(f='file')} AS folder, count(DISTINCT file) AS files, count(*) AS symbols FROM cur WHERE file IS NOT NULL GROUP BY 1")
def hierarchy_folders(spark, d):
    return rollup.folders(cur(spark, d, "type", "file"))


@query(f"WITH {_CUR} SELECT file, {_NAME.format(p='file')} AS name, {_FOLDER.format(f='file')} AS folder, count(*) FILTER (WHERE type <> 'file') AS symbols FROM cur WHERE file IS NOT NULL GROUP BY file")
def hierarchy_files(spark, d):
    return rollup.files(cur(spark, d, "type", "file"))


def _weights(a: str, b: str) -> str:
    return f"WITH {_CUR}, {_EDGES} SELECT {a} AS src, {b} AS dst, count(*) AS weight FROM edge e JOIN cur s ON s.id = e.src JOIN cur t ON t.id = e.dst WHERE {a} <> {b} GROUP BY 1, 2"


@query(_weights(_FOLDER.format(f="s.file"), _FOLDER.format(f="t.file")))
def hierarchy_folder_edges(spark, d):
    return rollup.edge_weights(cur(spark, d, "file"), edges(spark, d), "folder")


@query(_weights("s.file", "t.file"))
def hierarchy_file_edges(spark, d):
    return rollup.edge_weights(cur(spark, d, "file"), edges(spark, d), "file")


@query(f"WITH {_CUR}, {_EDGES} SELECT src, dst, relation FROM edge WHERE src IN (SELECT id FROM cur) AND dst IN (SELECT id FROM cur)")
def hierarchy_func_edges(spark, d):
    n = cur(spark, d, "type")
    return lookup.induced(n, edges(spark, d), n.select("id"))[1].select("src", "dst", "relation")


@query("SELECT CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS tokens, count(*) AS texts FROM documents")
def naive_tokens(spark, d):
    return rollup.naive_tokens(table(spark, d, "documents"))


_LOG = f"WITH {_CUR}, log AS (SELECT file, CAST(sum(length(coalesce(raw_text, '')) // 4) AS BIGINT) AS naive, CAST(sum(length({_SERIAL}) // 4) AS BIGINT) AS used FROM cur WHERE file IS NOT NULL GROUP BY 1)"


def _log(spark, d):
    text = scalar.serialize_symbol("type", "name", "file", "line_start", "line_end", "signature", "docstring")
    n = cur(spark, d, *_SHORT, "raw_text").where("file is not null")
    return n.groupBy("file").agg(F.sum(scalar.token_estimate("raw_text").cast("long")).alias("naive_tokens"), F.sum(scalar.token_estimate(text).cast("long")).alias("used_tokens"))


@query(f"{_LOG} SELECT file, naive AS naive_tokens, used AS used_tokens, round((1 - used / greatest(naive, 1)) * 100, 1) AS reduction_pct, round((naive - used) / 1e6 * 3.0, 6) AS cost_saved FROM log")
def bench_metrics(spark, d):
    return _log(spark, d).withColumn("reduction_pct", rollup.reduction("naive_tokens", "used_tokens")).withColumn("cost_saved", rollup.saved("naive_tokens", "used_tokens"))


@query(f"{_LOG} SELECT count(*) AS queries, CAST(sum(naive) AS BIGINT) AS naive_tokens, CAST(sum(used) AS BIGINT) AS used_tokens, round((1 - sum(used) / greatest(sum(naive), 1)) * 100, 1) AS reduction_pct, round((sum(naive) - sum(used)) / 1e6 * 3.0, 6) AS cost_saved FROM log")
def query_totals(spark, d):
    return rollup.query_totals(_log(spark, d))


@query("SELECT doc_id, source, created_at FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20")
def recent_queries(spark, d):
    return rollup.recent(table(spark, d, "documents").select("doc_id", "source", "created_at"), None, "created_at", "doc_id", 20)


# ---------------------------------------------------------------- increments


@query(f"WITH t AS (SELECT file, lower(trim(hash, {_PAD})) AS hash, indexed_at, landed_at FROM file_hashes WHERE trim(file, {_PAD}) <> ''), a AS (SELECT file, arg_min(coalesce(hash, '-'), (indexed_at, landed_at)) AS hash FROM t GROUP BY 1), b AS (SELECT file, arg_max(coalesce(hash, '-'), (indexed_at, landed_at)) AS hash FROM t GROUP BY 1) SELECT b.file, b.hash FROM b JOIN a ON a.file = b.file WHERE b.hash <> '-' AND a.hash <> b.hash")
def hash_skip(spark, d):
    """Files whose last hash isn't their first: what a second indexing would read."""
    t = table(spark, d, "file_hashes").where(filled("file")).select("file", norm_id("hash").alias("hash"), "indexed_at", "landed_at")
    old = t.groupBy("file").agg(F.min_by(F.struct("hash"), F.struct("indexed_at", "landed_at")).alias("x")).select("file", "x.hash")
    return store.unchanged(store.current_hashes(table(spark, d, "file_hashes")), old)


_DELTA = f"""WITH h AS (SELECT file, lower(trim(id, {_PAD})) AS id, indexed_at, landed_at, removed_at FROM nodes WHERE trim(id, {_PAD}) <> '' AND file IS NOT NULL),
    old AS (SELECT file, id, max(indexed_at) AS state FROM h WHERE landed_at < TIMESTAMP '2025-07-01' AND removed_at IS NULL GROUP BY 1, 2),
    new AS (SELECT file, id, max(indexed_at) AS state FROM h WHERE removed_at IS NULL GROUP BY 1, 2),
    moved AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.state IS DISTINCT FROM n.state THEN 'changed' END AS kind
      FROM old o FULL JOIN new n ON n.file = o.file AND n.id = o.id)"""


def _versions(spark, d):
    h = table(spark, d, "nodes").where(filled("id") & F.col("file").isNotNull() & F.col("removed_at").isNull()).select("file", norm_id("id").alias("id"), "indexed_at", "landed_at")
    last = lambda x: x.groupBy("file", "id").agg(F.max("indexed_at").alias("state"))
    return last(h.where(F.col("landed_at") < F.lit("2025-07-01").cast("timestamp_ntz"))), last(h)


@query(f"{_DELTA} SELECT file, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'removed') AS removed, count(*) FILTER (WHERE kind = 'changed') AS changed FROM moved GROUP BY 1")
def delta_sets(spark, d):
    return store.delta_sets(*_versions(spark, d))


@query(f"{_DELTA} SELECT file, kind, id FROM moved WHERE kind IS NOT NULL")
def delta_ids(spark, d):
    return store.delta_ids(*_versions(spark, d))


# ---------------------------------------------------------------- sources and streams


@query()
def parse_symbols(spark, d):
    """Every current source text, parsed again: how many symbols and calls it holds."""
    from codeloom.sources.ingest import parse_files

    n = cur(spark, d, "file", "raw_text").where("raw_text is not null and file is not null")
    kind = F.regexp_extract("file", r"(\.[A-Za-z]+)$", 1)
    parsed = parse_files(n.select(F.concat("id", kind).alias("file"), F.col("raw_text").alias("content")))
    return parsed.where("type <> 'file'").groupBy("type").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.size("calls")).alias("calls"))


_DEFS = r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+"
_CLASSES = r"^[ \t]*class[ \t]+\w+"


@query(f"""WITH {_CUR}, t AS (SELECT id, string_split(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM cur WHERE file LIKE '%.py' AND type IN ('class', 'function', 'method') AND raw_text IS NOT NULL)
SELECT id, len(list_filter(l, lambda x: regexp_matches(x, '{_DEFS}'))) AS functions, len(list_filter(l, lambda x: regexp_matches(x, '{_CLASSES}'))) AS classes FROM t""")
def parse_python(spark, d):
    """How many functions and classes the parser finds in each Python symbol's source."""
    from codeloom.sources.ingest import parse_files

    n = cur(spark, d, "type", "file", "raw_text").where("file like '%.py' and type in ('class', 'function', 'method') and raw_text is not null")
    parsed = parse_files(n.select(F.concat("id", F.lit(".py")).alias("file"), F.col("raw_text").alias("content")))
    of = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    return parsed.groupBy(F.expr("left(file, length(file) - 3)").alias("id")).agg(of("function").alias("functions"), of("class").alias("classes"))


@query(f"WITH {_CUR} SELECT id, CASE WHEN regexp_matches({_EMBED}, '[A-Za-z0-9]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM cur")
def embed_symbols(spark, d):
    """A vector for every current symbol's text, by the hashing model: of length one where there are words."""
    from codeloom.sources.ingest import embed

    n = cur(spark, d).select("id", scalar.embed_text("type", "name", "signature", "docstring").alias("text"))
    return embed(n, "text", 64).select("id", F.round(vectors.norm("embedding"), 3).alias("norm"))


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, value FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2")
def stream_event_windows(spark, d):
    """Windows that are final: what ends less than two hours before the last event is still open."""
    from codeloom.streaming.windows import read_stream, run_to_table, windowed

    return run_to_table(windowed(read_stream(spark, d, "events")), "append").withColumn("total", F.round("total", 4))


def _made(kind: str, name: str) -> str:
    return f"substr(sha256(p || '::{kind}::' || {name} || '::1'), 1, 16)"


@query(
    f"""WITH t AS (SELECT file, 'f' || substr(md5(file), 1, 12) || '.py' AS p, lower(trim(hash, {_PAD})) AS hash, indexed_at, landed_at FROM file_hashes WHERE trim(file, {_PAD}) <> '' AND indexed_at IS NOT NULL AND landed_at IS NOT NULL),
    v AS (SELECT p, arg_min(struct_pack(h := hash), (indexed_at, landed_at)).h AS a, arg_max(struct_pack(h := hash), (indexed_at, landed_at)).h AS b FROM t GROUP BY 1),
    e AS (SELECT p, 0 AS seq, NULL AS was, a AS now FROM v UNION ALL SELECT p, 1, a, b FROM v),
    i AS (SELECT p, seq, was, now, {_made('file', 'p')} AS f, {_made('function', "'g' || was")} AS fw, {_made('function', "'g' || now")} AS fn FROM e)
    SELECT p AS file, seq, CASE WHEN now IS NULL THEN '' WHEN was IS NULL THEN least(f, fn) || ',' || greatest(f, fn) WHEN was <> now THEN fn ELSE '' END AS added,
      CASE WHEN was IS NULL THEN '' WHEN now IS NULL THEN least(f, fw) || ',' || greatest(f, fw) WHEN was <> now THEN fw ELSE '' END AS removed,
      CASE WHEN was IS NULL OR now IS NULL THEN '' WHEN was <> now THEN f ELSE least(f, fn) || ',' || greatest(f, fn) END AS changed FROM i"""
)
def stream_live_deltas(spark, d):
    """The first and then the last version of every hashed file, as two micro-batches of the live graph: a file's hash names its one function."""
    from codeloom.session import scratch
    from codeloom.streaming.live import LiveGraph, watch

    t = table(spark, d, "file_hashes").where(filled("file") & F.col("indexed_at").isNotNull() & F.col("landed_at").isNotNull())
    path = F.concat(F.lit("f"), F.substring(F.md5("file"), 1, 12), F.lit(".py"))
    at = F.struct("indexed_at", "landed_at")
    v = t.select(path.alias("file"), F.struct(norm_id("hash").alias("h")).alias("x"), at.alias("at")).groupBy("file").agg(F.min_by("x", "at").alias("a"), F.max_by("x", "at").alias("b"))
    root = scratch(spark, "live")
    for seq, c in enumerate(("a", "b")):
        text = F.concat(F.lit("def g"), F.col(f"{c}.h"), F.lit("():\n    return 1\n")).cast("binary")
        v.select("file", text.alias("content"), F.timestamp_seconds(F.lit(seq)).alias("ts")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    g = LiveGraph(spark, f"{root}/graph", score=False)
    g.start(watch(spark, f"{root}/in", 1), f"{root}/checkpoint", once=True).awaitTermination()
    join = lambda c: F.array_join(c, ",").alias(c)
    return g.deltas().select("file", F.unix_timestamp("ts").cast("int").alias("seq"), join("added"), join("removed"), join("changed"))


@query(f"SELECT file, h AS hash FROM (SELECT file, arg_max(coalesce(lower(trim(hash, {_PAD})), '-'), (indexed_at, landed_at)) AS h FROM file_hashes WHERE trim(file, {_PAD}) <> '' GROUP BY 1) WHERE h <> '-'")
def stream_file_states(spark, d):
    from codeloom.streaming.windows import file_states, read_stream

    return file_states(read_stream(spark, d, "file_hashes")).where("hash is not null")
