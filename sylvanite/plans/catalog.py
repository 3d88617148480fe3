"""The registered queries over labelled graph collections, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measures, mining
from ..sources import graphs as io
from . import patterns, sessions
from .bridge import graphs, with_views

SMALL = "/root/testdata/sf0.001"
#: share of the graphs that a frequent pattern is in, in percent
SHARE = 2


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["frequent_edges_order"][0](spark, SMALL)


def _sizes(name):
    return lambda s, d: graphs(s, d, name).select("graph_id", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"))


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(x).cast("long").alias(x) for x in names))


def _frequent_edges(s, d):
    g = graphs(s, d, "order")
    least = g.agg(F.ceil(F.count("*") * SHARE / 100.0).alias("least"))
    return measures.edge_support(g).join(F.broadcast(least)).where("support >= least").drop("least")


def _mined(s, d):
    g = graphs(s, d, "order")
    return mining.frequent_subtrees(g, -(-g.count() * 3 // 100), patterns.MAX_SIZE)


def _user_measures(*names):
    return lambda s, d: measures.measure(graphs(s, d, "user"), names)


def _reach(name):
    return with_views(name, """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e),
    reach AS (SELECT graph_id, vid AS a, vid AS b FROM v UNION SELECT r.graph_id, r.a, x.b FROM reach r JOIN arc x ON x.graph_id = r.graph_id AND x.a = r.b),
    comp AS (SELECT graph_id, a, min(b) AS c FROM reach GROUP BY graph_id, a),
    k AS (SELECT graph_id, count(DISTINCT c) AS components, count(*) AS n FROM comp GROUP BY graph_id),
    me AS (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id)
    SELECT k.graph_id, CAST(components AS BIGINT) AS components, CAST(CASE WHEN components <= 1 THEN 1 ELSE 0 END AS BIGINT) AS connected,
      CAST(CASE WHEN components <= 1 AND coalesce(m, 0) = n - 1 THEN 1 ELSE 0 END AS BIGINT) AS tree
    FROM k LEFT JOIN me USING (graph_id)""")


_DEGREE = """, d AS (SELECT graph_id, vid, count(x.src) AS degree FROM (SELECT v.graph_id, v.vid, e1.src FROM v LEFT JOIN
    (SELECT graph_id, src, dst FROM e UNION ALL SELECT graph_id, dst, src FROM e) AS e1 ON e1.graph_id = v.graph_id AND e1.src = v.vid) AS x GROUP BY graph_id, vid)"""
_SUPPORT = """, s AS (SELECT least(a.label, b.label) AS low, e.label AS edge_label, greatest(a.label, b.label) AS high, count(DISTINCT e.graph_id) AS support
    FROM e JOIN v AS a ON a.graph_id = e.graph_id AND a.vid = e.src JOIN v AS b ON b.graph_id = e.graph_id AND b.vid = e.dst GROUP BY 1, 2, 3)"""
#: cycles in graphs of five vertices at most, by paths from the least vertex
_CYCLES = """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e),
    walk AS (SELECT graph_id, a AS start, b AS at, [a, b] AS seen FROM arc WHERE b > a
      UNION ALL SELECT w.graph_id, w.start, x.b, list_append(w.seen, x.b) FROM walk w JOIN arc x ON x.graph_id = w.graph_id AND x.a = w.at WHERE x.b > w.start AND NOT list_contains(w.seen, x.b))
    SELECT g.graph_id, CAST(count(w.start) AS BIGINT) AS simple_cycles FROM (SELECT DISTINCT graph_id FROM v) AS g LEFT JOIN
      (SELECT walk.graph_id, start FROM walk JOIN arc ON arc.graph_id = walk.graph_id AND arc.a = walk.at AND arc.b = walk.start WHERE len(seen) > 2 AND seen[2] < seen[-1]) AS w
      ON w.graph_id = g.graph_id GROUP BY g.graph_id"""
_STARS = """, least AS (SELECT CAST(ceil(count(DISTINCT graph_id) * 3 / 100.0) AS BIGINT) AS t FROM v),
    arm AS (SELECT e.graph_id, c.label AS centre, e.label AS el, l.label AS leaf, row_number() OVER (PARTITION BY e.graph_id ORDER BY e.label, l.label, e.dst) AS k FROM e JOIN v AS c ON c.graph_id = e.graph_id AND c.vid = 0 JOIN v AS l ON l.graph_id = e.graph_id AND l.vid = e.dst),
    star AS (SELECT graph_id, 2 AS size, k, concat(centre, ' ( ', el, ' ', leaf, ' ) ') AS s FROM arm UNION ALL
      SELECT s.graph_id, s.size + 1, a.k, concat(s.s, '( ', a.el, ' ', a.leaf, ' ) ') FROM star AS s JOIN arm AS a ON a.graph_id = s.graph_id AND a.k > s.k),
    one AS (SELECT 1 AS size, concat(label, ' ') AS cstring, count(DISTINCT graph_id) AS support FROM v GROUP BY label),
    two AS (SELECT 2 AS size, concat(least(centre, leaf), ' ( ', el, ' ', greatest(centre, leaf), ' ) ') AS cstring, count(DISTINCT graph_id) AS support FROM arm GROUP BY 2),
    more AS (SELECT size, s AS cstring, count(DISTINCT graph_id) AS support FROM star WHERE size > 2 GROUP BY 1, 2)
    SELECT CAST(size AS INTEGER) AS size, cstring, CAST(support AS BIGINT) AS support FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM more) AS a, least WHERE support >= t"""
_SIZES = """SELECT v.graph_id, n, CAST(coalesce(m, 0) AS BIGINT) AS m FROM (SELECT graph_id, count(*) AS n FROM v GROUP BY graph_id) AS v LEFT JOIN (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id) AS e USING (graph_id)"""

#: name: (query, SQL or None)
QUERIES = {
    "sizes_order": (_sizes("order"), with_views("order", _SIZES)),
    "sizes_user": (_sizes("user"), with_views("user", _SIZES)),
    "sizes_conv": (_sizes("conv"), with_views("conv", _SIZES)),
    "filter_vertices": (lambda s, d: measures.filter_graphs(graphs(s, d, "order"), "numberOfVertices", ">=", 6).select("graph_id"), with_views("order", "SELECT graph_id FROM v GROUP BY graph_id HAVING count(*) >= 6")),
    "degrees_user": (lambda s, d: measures.degrees(graphs(s, d, "user")), with_views("user", _DEGREE + " SELECT graph_id, CAST(vid AS INTEGER) AS vid, degree FROM d")),
    "extreme_degrees_user": (_user_measures("max_degree", "min_degree"), with_views("user", _DEGREE + " SELECT graph_id, CAST(max(degree) AS BIGINT) AS max_degree, CAST(min(degree) AS BIGINT) AS min_degree FROM d GROUP BY graph_id")),
    "components_user": (_user_measures("components", "connected", "tree"), _reach("user")),
    "components_conv": (lambda s, d: measures.measure(graphs(s, d, "conv"), ("components", "connected", "tree")), _reach("conv")),
    "simple_cycles_user": (_user_measures("simple_cycles"), with_views("user", _CYCLES)),
    "block_measures_user": (_user_measures("cactus", "outerplanar", "bicomponents", "blocks", "max_blocks", "bridges", "bridge_trees", "max_block_degree", "min_block_degree", "max_easiness", "min_easiness", "spanning_trees"), None),
    "vertex_support_order": (lambda s, d: measures.vertex_support(graphs(s, d, "order")), with_views("order", "SELECT label, count(DISTINCT graph_id) AS support FROM v GROUP BY label")),
    "edge_support_order": (lambda s, d: measures.edge_support(graphs(s, d, "order")), with_views("order", _SUPPORT + " SELECT * FROM s")),
    "edge_support_user": (lambda s, d: measures.edge_support(graphs(s, d, "user")), with_views("user", _SUPPORT + " SELECT * FROM s")),
    "frequent_edges_order": (_frequent_edges, with_views("order", _SUPPORT + f" SELECT * FROM s WHERE support >= (SELECT ceil(count(DISTINCT graph_id) * {SHARE} / 100.0) FROM v)")),
    "triangles_user": (lambda s, d: measures.triangles(graphs(s, d, "user")), with_views("user", "SELECT a.graph_id, count(*) AS triangles FROM e AS a JOIN e AS b ON a.graph_id = b.graph_id AND a.dst = b.src JOIN e AS c ON c.graph_id = a.graph_id AND c.src = a.src AND c.dst = b.dst GROUP BY 1")),
    "unlabelled_edge_support": (lambda s, d: measures.edge_support(measures.unlabel(graphs(s, d, "user"))), with_views("user", "SELECT '1' AS low, '1' AS edge_label, '1' AS high, count(DISTINCT graph_id) AS support FROM e")),
    "recoded_targets": (lambda s, d: measures.recode(graphs(s, d, "order"), "m").groupBy("activity").agg(F.count("*").alias("graphs")), with_views("order", "SELECT CAST(CASE graph_id % 3 WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE graph_id % 3 END AS BIGINT) AS activity, count(DISTINCT graph_id) AS graphs FROM v GROUP BY 1")),
    "disk_graphs_user": (lambda s, d: _longs(measures.neighbourhoods(graphs(s, d, "user")), "graph_id", "centre", "n_vertices", "n_edges"), with_views("user", """, arc AS (SELECT graph_id, src AS c, dst AS x FROM e UNION ALL SELECT graph_id, dst, src FROM e UNION ALL SELECT graph_id, vid, vid FROM v)
      SELECT a.graph_id, CAST(a.c AS BIGINT) AS centre, count(*) AS n_vertices, coalesce(max(k), 0) AS n_edges FROM arc AS a LEFT JOIN
        (SELECT p.graph_id, p.c, count(*) AS k FROM e JOIN arc AS p ON p.graph_id = e.graph_id AND p.x = e.src JOIN arc AS q ON q.graph_id = e.graph_id AND q.x = e.dst AND q.c = p.c GROUP BY 1, 2) AS i
        ON i.graph_id = a.graph_id AND i.c = a.c GROUP BY 1, 2""")),
    "weisfeiler_lehman_conv": (lambda s, d: measures.weisfeiler_lehman(graphs(s, d, "conv")).groupBy("label").agg(F.count("*").alias("vertices")), with_views("conv", """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e),
      near AS (SELECT arc.graph_id, a, string_agg(label, ' ' ORDER BY label) AS l FROM arc JOIN v ON v.graph_id = arc.graph_id AND v.vid = arc.b GROUP BY 1, 2)
      SELECT concat_ws(' ', v.label, near.l) AS label, count(*) AS vertices FROM v LEFT JOIN near ON near.graph_id = v.graph_id AND near.a = v.vid GROUP BY 1""")),
    "star_strings_order": (lambda s, d: measures.canonical_strings(graphs(s, d, "order")), with_views("order", """, arm AS (SELECT e.graph_id, e.label AS el, v.label AS leaf FROM e JOIN v ON v.graph_id = e.graph_id AND v.vid = e.dst)
      SELECT c.graph_id, CASE count(leaf) WHEN 0 THEN concat(c.label, ' ') WHEN 1 THEN concat(least(c.label, min(leaf)), ' ( ', min(el), ' ', greatest(c.label, min(leaf)), ' ) ')
        ELSE concat(c.label, ' ', string_agg(concat('( ', el, ' ', leaf, ' ) '), '' ORDER BY el, leaf)) END AS cstring FROM v AS c LEFT JOIN arm USING (graph_id) WHERE c.vid = 0 GROUP BY c.graph_id, c.label""")),
    "frequent_subtrees_order": (_mined, with_views("order", _STARS)),
    "sampled_trees_user": (lambda s, d: measures.sampled_trees(graphs(s, d, "user")), None),
    "graph_text_user": (lambda s, d: io.graph_text(graphs(s, d, "user")), with_views("user", """, vl AS (SELECT graph_id, count(*) AS n, string_agg(label, ' ' ORDER BY vid) AS l FROM v GROUP BY 1),
      el AS (SELECT graph_id, count(*) AS m, string_agg(concat(src + 1, ' ', dst + 1, ' ', label), ' ' ORDER BY src, dst) AS l FROM e GROUP BY 1)
      SELECT vl.graph_id, concat('# ', vl.graph_id, ' ', vl.graph_id % 3, ' ', n, ' ', coalesce(m, 0), chr(10), vl.l, chr(10), coalesce(el.l, '')) AS value FROM vl LEFT JOIN el USING (graph_id)""")),
}


EVERY = QUERIES | patterns.QUERIES | sessions.QUERIES | sessions.with_paths(patterns._FREE)
EVERY |= {k: (EVERY[k][0], sql) for k, sql in sessions.USER_SQL.items()}


def queries() -> dict:
    return {k: q for k, (q, _) in EVERY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in EVERY.items() if sql}
