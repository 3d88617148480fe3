"""Registered queries of mining, pattern posets, kernels, samplers and generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, generators, measures, mining, pattern_kernels, poset
from ..operators._session import numbered
from ..sources import formats
from .bridge import graphs, with_views

#: share of the conversations that a frequent pattern is in, in percent
SHARE = 3
#: mining goes on until a level is empty, to this size at most
MAX_SIZE = 20
#: enumerations name trees without asking the graphs, so that no level is empty: their size is an argument
ENUMERATED = {"treeEnumeration": 3, "rootedTreeEnumeration": 3}


def _mine(name: str, i: float):
    def query(s, d):
        g = graphs(s, d, "conv")
        return mining.mine(g, -(-g.count() * SHARE // 100), ENUMERATED.get(name, MAX_SIZE), name, i)[0].select("size", "cstring", F.col("support").cast("long").alias("support"))

    return query


def _by_root(s, d):
    g = graphs(s, d, "conv")
    return mining.mine_by_root(g, -(-g.count() * SHARE // 100), MAX_SIZE)[0].select("size", "cstring", F.col("support").cast("long").alias("support"))


def _postings(s, d):
    g = graphs(s, d, "conv")
    patterns, postings = mining.mine(g, -(-g.count() * SHARE // 100), MAX_SIZE)
    return postings.join(patterns, "pattern_id").select("cstring", "graph_id")


#: chains from a vertex to lower and to higher turns, and the paths of all sizes: from one vertex down, or named at their centres
_PATHS = f""", least AS (SELECT CAST(ceil(count(DISTINCT graph_id) * {SHARE} / 100.0) AS BIGINT) AS t FROM v),
    up AS (SELECT graph_id, vid, 1 AS len, concat(label, ' ') AS s FROM v UNION ALL
      SELECT v.graph_id, v.vid, c.len + 1, concat(v.label, ' ( 1 ', c.s, ') ') FROM up AS c JOIN v ON v.graph_id = c.graph_id AND v.vid = c.vid + 1),
    down AS (SELECT graph_id, vid, 1 AS len, concat(label, ' ') AS s FROM v UNION ALL
      SELECT v.graph_id, v.vid, c.len + 1, concat(v.label, ' ( 1 ', c.s, ') ') FROM down AS c JOIN v ON v.graph_id = c.graph_id AND v.vid = c.vid - 1),
    lo AS (SELECT graph_id, vid + 1 AS c, len, s FROM up UNION ALL SELECT graph_id, vid, 0, '' FROM v),
    hi AS (SELECT graph_id, vid - 1 AS c, len, s FROM down UNION ALL SELECT graph_id, vid, 0, '' FROM v),
    rooted AS (SELECT v.graph_id, v.vid - lo.len AS start, lo.len + hi.len + 1 AS size, concat(v.label, ' ', CASE WHEN least(lo.s, hi.s) = '' THEN '' ELSE concat('( 1 ', least(lo.s, hi.s), ') ') END,
        CASE WHEN greatest(lo.s, hi.s) = '' THEN '' ELSE concat('( 1 ', greatest(lo.s, hi.s), ') ') END) AS s
      FROM v JOIN lo ON lo.graph_id = v.graph_id AND lo.c = v.vid JOIN hi ON hi.graph_id = v.graph_id AND hi.c = v.vid WHERE abs(lo.len - hi.len) <= 1),
    hit AS ({{hit}}),
    found AS (SELECT size, cstring, count(*) AS support FROM hit GROUP BY 1, 2)"""
_FREE = _PATHS.format(hit="SELECT DISTINCT size, cstring, graph_id FROM (SELECT graph_id, start, size, min(s) AS cstring FROM rooted GROUP BY 1, 2, 3) AS p")
_ROOTED = _PATHS.format(hit="SELECT DISTINCT len AS size, s AS cstring, graph_id FROM down")
_FOUND = " SELECT CAST(size AS INTEGER) AS size, cstring, support FROM found, least WHERE support >= t"
#: operators that are exact on paths, whatever their samples
EXACT = ("subtree", "subtree_iterative", "subtree_relimp", "subtree_absimp", "exactGlobalTreeEnumeration", "ps", "localEasy", "bps", "bps_resampling")


def _sql(name: str) -> str | None:
    if name in EXACT:
        return with_views("conv", _FREE + _FOUND)
    return with_views("conv", _ROOTED + _FOUND) if name == "rootedTrees" else None


def _user_patterns(s, d) -> tuple[DataFrame, list[str]]:
    g = graphs(s, d, "user")
    return g, sorted(r["cstring"] for r in mining.frequent_subtrees(g, -(-g.count() * 40 // 100), 3).collect())


def _all_methods(s, d):
    g, patterns = _user_patterns(s, d)
    i = lambda m: 1 if m.endswith("Abs") else 0.5 if m.endswith("Rel") else 3 if "Resampling" in m or m.startswith("hops") else 0
    return reduce(DataFrame.unionByName, [poset.embed(g, patterns, m, i(m)).withColumn("method", F.lit(m)) for m in poset.FEATURES])


def _all_sketches(s, d):
    g, patterns = _user_patterns(s, d)
    i = lambda m: {"minHashAbs": 1, "minHashRel": 0.5}.get(m, 0)
    return reduce(DataFrame.unionByName, [poset.sketch(g, patterns, m, 4, i(m)).withColumn("method", F.lit(m)) for m in poset.SKETCHES])


def _all_samplers(s, d):
    g = graphs(s, d, "user")
    every = ("wilson", "kruskal", "listing", "mix", "partialListing", "bridgeForest", "listOrSample")
    rows = [measures.sampled_trees(g, 3, how=h, by_component=True).withColumn("sampler", F.lit(h)) for h in every]
    rows.append(measures.sampled_trees(measures.filter_graphs(g, "cactus", "==", 1), 3, how="cactus").withColumn("sampler", F.lit("cactus")))
    return reduce(DataFrame.unionByName, rows)


def _value(name: str, argument: int = 50, view: str = "user"):
    return lambda s, d: measures.filter_graphs(graphs(s, d, view), name, output="idAndValue", argument=argument)


def _generated(s, d):
    every = {
        "erdosRenyi": generators.random_graphs(s, 20, 8, 0.3), "barabasiAlbert": generators.preferential(s, 20, 12, 2), "barabasiAlbertAlpha": generators.preferential(s, 20, 12, 2, 0.95),
        "overlap": generators.geometric(s, 20, 12, 0.3), "clusteredOverlap": generators.geometric(s, 20, 12, 0.2, clusters=3), "iterativeOverlap": generators.moving(s, 4, 5, 12, 0.3, 0.05),
        "iterativeClusteredOverlap": generators.moving(s, 4, 5, 12, 0.2, 0.05, clusters=3), "chains": generators.chains(s, 20, 3, 5, 0.4),
    }
    return reduce(DataFrame.unionByName, [g.withColumn("generator", F.lit(x)) for x, g in every.items()])


def _numbered_features(s, d):
    known, rows = pattern_kernels.feature_rows(pattern_kernels.cyclic_patterns(graphs(s, d, "user")))
    return pattern_kernels.count_lines(rows)


def _label_pairs(s, d):
    return evaluation.label_baseline(graphs(s, d, "order"), True)


def _label_chi(s, d):
    g = graphs(s, d, "user")
    names = g.select(F.explode("vlabels").alias("label")).distinct()
    known = numbered(names, "label", "index").withColumn("index", F.col("index").cast("int"))
    pairs = evaluation.label_baseline(g).join(known, "label").select("graph_id", F.col("index").alias("feature"))
    rows = evaluation.svm_rows(pairs).drop("label").join(g.select("graph_id", F.col("activity").cast("double").alias("label")), "graph_id")
    return evaluation.chi_squared(rows).select("index", F.round("statistic", 6).alias("statistic"))


_EDGE_CUT = """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e),
    reach AS (SELECT graph_id, src AS s, dst AS d, src AS pos FROM e UNION
      SELECT r.graph_id, r.s, r.d, x.b FROM reach r JOIN arc x ON x.graph_id = r.graph_id AND x.a = r.pos WHERE NOT (x.a = r.s AND x.b = r.d) AND NOT (x.a = r.d AND x.b = r.s)),
    bridge AS (SELECT graph_id, s, d FROM reach GROUP BY 1, 2, 3 HAVING NOT bool_or(pos = d))
    SELECT g.graph_id, count(bridge.s) AS value FROM (SELECT DISTINCT graph_id FROM v) AS g LEFT JOIN bridge ON bridge.graph_id = g.graph_id GROUP BY 1"""
#: spanning trees of up to five vertices: edge sets grown in order, each edge joining two pieces of the labelling
_TREES = """, no AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS k FROM e),
    size AS (SELECT graph_id, count(*) AS n FROM v GROUP BY 1),
    grow AS (SELECT graph_id, n, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS taken, range(n) AS home FROM size
      UNION ALL SELECT g.graph_id, g.n, no.k, g.taken + 1, list_transform(g.home, lambda h: CASE WHEN h = g.home[no.dst + 1] THEN g.home[no.src + 1] ELSE h END)
      FROM grow g JOIN no ON no.graph_id = g.graph_id AND no.k > g.k WHERE g.home[no.src + 1] <> g.home[no.dst + 1])
    SELECT s.graph_id, CAST(count(grow.k) AS BIGINT) AS value FROM size s LEFT JOIN grow ON grow.graph_id = s.graph_id AND grow.taken = s.n - 1 GROUP BY 1"""

QUERIES = {
    **{f"mine_{x}": (_mine(x, {"subtree_relimp": 0.5, "subtree_absimp": 1}.get(x, 3)), _sql(x)) for x in mining.OPERATORS},
    "mine_by_root_conv": (_by_root, with_views("conv", _ROOTED + _FOUND)),
    "postings_conv": (_postings, with_views("conv", _FREE + " SELECT cstring, graph_id FROM hit JOIN found USING (cstring), least WHERE support >= t")),
    "poset_methods_user": (_all_methods, None),
    "poset_sketches_user": (_all_sketches, None),
    "tree_samplers_user": (_all_samplers, None),
    "generators": (_generated, None),
    "common_neighbours_user": (lambda s, d: measures.common_neighbours(graphs(s, d, "user")).select("graph_id", F.col("v").cast("long").alias("v"), F.col("w").cast("long").alias("w"), "shared"), with_views("user", """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e)
      SELECT x.graph_id, x.b AS v, y.b AS w, count(*) AS shared FROM arc AS x JOIN arc AS y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b < y.b GROUP BY 1, 2, 3""")),
    "numberOfBridges_user": (_value("numberOfBridges"), with_views("user", _EDGE_CUT)),
    "spanningTreeListing_user": (_value("spanningTreeListing", 1000), with_views("user", _TREES.replace("grow.taken = s.n - 1", "grow.taken = (SELECT max(taken) FROM grow AS g WHERE g.graph_id = s.graph_id)"))),
    "numberOfSimpleCycles_user": (_value("numberOfSimpleCycles"), None),
    "numberOfNonIsoCycles_user": (_value("numberOfNonIsoCycles"), None),
    "count_user": (_value("count"), with_views("user", "SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS value FROM (SELECT DISTINCT graph_id FROM v) AS g")),
    "label_user": (_value("label"), with_views("user", "SELECT DISTINCT graph_id, graph_id % 3 AS value FROM v")),
    **{f"{x}_user": (_value(x, 5), None) for x in measures.EXTRA if x not in ("spanningTreeListing", "numberOfSimpleCycles", "numberOfNonIsoCycles")},
    "components_of_vertices_user": (lambda s, d: measures.components(graphs(s, d, "user")), with_views("user", """, arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e),
      reach AS (SELECT graph_id, vid AS a, vid AS b FROM v UNION SELECT r.graph_id, r.a, x.b FROM reach r JOIN arc x ON x.graph_id = r.graph_id AND x.a = r.b)
      SELECT graph_id, CAST(a AS INTEGER) AS vid, CAST(min(b) AS INTEGER) AS component FROM reach GROUP BY 1, 2""")),
    "bicomponent_edges_user": (lambda s, d: measures.bicomponent_edges(graphs(s, d, "user")), None),
    "cyclic_patterns_user": (lambda s, d: pattern_kernels.cyclic_patterns(graphs(s, d, "user")), None),
    "cyclic_rows_user": (_numbered_features, None),
    "outerplanar_patterns_user": (lambda s, d: pattern_kernels.outerplanar_patterns(graphs(s, d, "user")), None),
    "triangle_prints_user": (lambda s, d: pattern_kernels.triples(graphs(s, d, "user")), None),
    "triple_prints_user": (lambda s, d: pattern_kernels.triples(graphs(s, d, "user"), False), None),
    "reports_user": (lambda s, d: pattern_kernels.reports(graphs(s, d, "user")), None),
    "label_baseline_order": (_label_pairs, with_views("order", "SELECT graph_id, label, count(*) AS occurrences FROM v GROUP BY 1, 2")),
    "chi_squared_user": (_label_chi, None),
    "elements": (lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", formats.element("p_size").alias("symbol")), f"SELECT p_partkey, string_split('{formats.ELEMENTS}', ' ')[p_size] AS symbol FROM part"),
    "fingerprints_order": (lambda s, d: graphs(s, d, "order").select("graph_id", pattern_kernels.fingerprint(F.transform("vlabels", lambda x: F.length(x))).alias("print")), with_views("order", "SELECT graph_id, bit_or(CAST(1 AS BIGINT) << (length(label) % 32)) AS print FROM v GROUP BY 1")),
}
