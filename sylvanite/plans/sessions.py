"""Registered queries over the graphs of user sessions, whose shapes differ, and over the events as tables.

A session's vertices are its event types, so that a graph has no label twice: the SQL can name trees by their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import measures, mining, pattern_kernels, poset
from ..operators._session import cut
from ..sources import formats, graphs as io
from ..streaming import graph_stream
from .bridge import _SESSIONS, graphs, with_views

#: share of the sessions that a frequent pattern is in, in percent
SHARE = 2
PATTERN = 5

_ARC = ", arc AS (SELECT graph_id, src AS a, dst AS b FROM e UNION ALL SELECT graph_id, dst, src FROM e)"
#: cycles by paths from the least vertex; edges on a common cycle are one biconnected component, named by its least edge
_BLOCKS = _ARC + """,
    walk AS (SELECT graph_id, a AS start, b AS at, [a, b] AS seen FROM arc WHERE b > a
      UNION ALL SELECT w.graph_id, w.start, x.b, list_append(w.seen, x.b) FROM walk w JOIN arc x ON x.graph_id = w.graph_id AND x.a = w.at WHERE x.b > w.start AND NOT list_contains(w.seen, x.b)),
    cyc AS (SELECT w.graph_id, w.seen FROM walk w JOIN arc ON arc.graph_id = w.graph_id AND arc.a = w.at AND arc.b = w.start WHERE len(seen) > 2 AND seen[2] < seen[-1]),
    ce AS (SELECT graph_id, seen, least(seen[i], seen[i % len(seen) + 1]) AS s, greatest(seen[i], seen[i % len(seen) + 1]) AS d FROM cyc, UNNEST(range(1, len(seen) + 1)) AS t(i)),
    part AS (SELECT e.graph_id, e.src AS s, e.dst AS d, least(e.src * 1000 + e.dst, coalesce(min(f.s * 1000 + f.d), 999999999)) AS part
      FROM e LEFT JOIN ce AS c ON c.graph_id = e.graph_id AND c.s = e.src AND c.d = e.dst LEFT JOIN ce AS f ON f.graph_id = c.graph_id AND f.seen = c.seen GROUP BY 1, 2, 3),
    psize AS (SELECT graph_id, part, count(*) AS m FROM part GROUP BY 1, 2),
    ends AS (SELECT DISTINCT graph_id, part, vid FROM (SELECT graph_id, part, s AS vid FROM part UNION ALL SELECT graph_id, part, d FROM part) AS x),
    bv AS (SELECT ends.* FROM ends JOIN psize USING (graph_id, part) WHERE m > 1),
    bn AS (SELECT graph_id, part, count(*) AS n FROM bv GROUP BY 1, 2),
    size AS (SELECT graph_id, count(*) AS n FROM v GROUP BY 1)"""
_SHAPES = _BLOCKS + """,
    reach AS (SELECT graph_id, vid AS a, vid AS b FROM v UNION SELECT r.graph_id, r.a, x.b FROM reach r JOIN arc x ON x.graph_id = r.graph_id AND x.a = r.b),
    comp AS (SELECT graph_id, a AS vid, min(b) AS c FROM reach GROUP BY 1, 2),
    no AS (SELECT part.*, row_number() OVER (PARTITION BY graph_id, part ORDER BY s, d) AS k FROM part JOIN bn USING (graph_id, part)),
    grow AS (SELECT graph_id, part, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS taken, range(size.n) AS home FROM bn JOIN size USING (graph_id)
      UNION ALL SELECT g.graph_id, g.part, no.k, g.taken + 1, list_transform(g.home, lambda h: CASE WHEN h = g.home[no.d + 1] THEN g.home[no.s + 1] ELSE h END)
      FROM grow g JOIN no ON no.graph_id = g.graph_id AND no.part = g.part AND no.k > g.k WHERE g.home[no.s + 1] <> g.home[no.d + 1]),
    bt AS (SELECT g.graph_id, g.part, count(*) AS trees FROM grow g JOIN bn USING (graph_id, part) WHERE g.taken = bn.n - 1 GROUP BY 1, 2),
    ham AS (SELECT cyc.graph_id, p.part, cyc.seen FROM cyc JOIN part AS p ON p.graph_id = cyc.graph_id AND p.s = least(seen[1], seen[2]) AND p.d = greatest(seen[1], seen[2]) JOIN bn ON bn.graph_id = p.graph_id AND bn.part = p.part AND bn.n = len(seen)),
    pos AS (SELECT h.*, least(list_position(h.seen, p.s), list_position(h.seen, p.d)) AS lo, greatest(list_position(h.seen, p.s), list_position(h.seen, p.d)) AS hi FROM ham h JOIN part AS p USING (graph_id, part)),
    crossed AS (SELECT DISTINCT p.graph_id, p.part, p.seen FROM pos p JOIN pos q ON q.graph_id = p.graph_id AND q.part = p.part AND q.seen = p.seen WHERE p.lo < q.lo AND q.lo < p.hi AND p.hi < q.hi),
    good AS (SELECT graph_id, count(DISTINCT part) AS good FROM (SELECT graph_id, part, seen FROM ham EXCEPT SELECT graph_id, part, seen FROM crossed) AS x GROUP BY 1),
    per_vertex AS (SELECT v.graph_id, v.vid, count(bt.part) AS bdeg, CAST(coalesce(product(bt.trees), 1) AS BIGINT) AS easy FROM v LEFT JOIN bv ON bv.graph_id = v.graph_id AND bv.vid = v.vid LEFT JOIN bt ON bt.graph_id = bv.graph_id AND bt.part = bv.part GROUP BY 1, 2),
    critical AS (SELECT graph_id, vid, count(*) AS crit FROM ends GROUP BY 1, 2),
    crowded AS (SELECT graph_id, max(k) AS k FROM (SELECT bv.graph_id, bv.part, count(*) FILTER (crit > 1) AS k FROM bv JOIN critical USING (graph_id, vid) GROUP BY 1, 2) AS x GROUP BY 1),
    trail AS (SELECT graph_id, vid AS at, [vid] AS seen FROM v UNION ALL SELECT t.graph_id, x.b, list_append(t.seen, x.b) FROM trail t JOIN arc x ON x.graph_id = t.graph_id AND x.a = t.at WHERE NOT list_contains(t.seen, x.b)),
    deg AS (SELECT v.graph_id, v.vid, count(arc.a) AS degree FROM v LEFT JOIN arc ON arc.graph_id = v.graph_id AND arc.a = v.vid GROUP BY 1, 2),
    a1 AS (SELECT graph_id, count(DISTINCT c) AS components FROM comp GROUP BY 1),
    a2 AS (SELECT graph_id, count(*) AS m FROM e GROUP BY 1),
    a3 AS (SELECT graph_id, count(*) AS bicomponents, count(*) FILTER (m > 1) AS blocks, count(*) FILTER (m = 1) AS bridges FROM psize GROUP BY 1),
    a4 AS (SELECT graph_id, max(k) AS max_blocks FROM (SELECT b.graph_id, c, count(DISTINCT part) AS k FROM bv AS b JOIN comp USING (graph_id, vid) GROUP BY 1, 2) AS x GROUP BY 1),
    a5 AS (SELECT graph_id, max(degree) AS max_degree, min(degree) AS min_degree FROM deg GROUP BY 1),
    a6 AS (SELECT graph_id, max(bdeg) AS max_block_degree, min(bdeg) AS min_block_degree, max(easy) AS max_easiness, min(easy) AS min_easiness FROM per_vertex GROUP BY 1),
    a7 AS (SELECT graph_id, CAST(product(trees) AS BIGINT) AS spanning_trees FROM bt GROUP BY 1),
    a8 AS (SELECT graph_id, count(*) AS simple_cycles FROM cyc GROUP BY 1),
    a9 AS (SELECT graph_id, max(crit) AS crit FROM critical GROUP BY 1),
    a10 AS (SELECT trail.graph_id, count(*) AS trails FROM trail JOIN size ON size.graph_id = trail.graph_id AND size.n = len(seen) GROUP BY 1),
    raw AS (SELECT s.graph_id, s.n, coalesce(m, 0) AS m, components, coalesce(bicomponents, 0) AS bicomponents, coalesce(blocks, 0) AS blocks, coalesce(max_blocks, 0) AS max_blocks, coalesce(bridges, 0) AS bridges,
        max_degree, min_degree, max_block_degree, min_block_degree, max_easiness, min_easiness, coalesce(spanning_trees, 1) AS spanning_trees, coalesce(simple_cycles, 0) AS simple_cycles,
        coalesce(good, 0) AS good, coalesce(crit, 0) AS crit, coalesce(crowded.k, 0) AS crowded, coalesce(trails, 0) AS trails
      FROM size AS s JOIN a1 USING (graph_id) LEFT JOIN a2 USING (graph_id) LEFT JOIN a3 USING (graph_id) LEFT JOIN a4 USING (graph_id) JOIN a5 USING (graph_id) JOIN a6 USING (graph_id)
        LEFT JOIN a7 USING (graph_id) LEFT JOIN a8 USING (graph_id) LEFT JOIN a9 USING (graph_id) LEFT JOIN a10 USING (graph_id) LEFT JOIN good USING (graph_id) LEFT JOIN crowded USING (graph_id)),
    shape AS (SELECT graph_id, CAST(components <= 1 AS BIGINT) AS connected, CAST(components <= 1 AND m = n - 1 AS BIGINT) AS tree, CAST(m = n - 1 AND max_degree <= 2 AS BIGINT) AS path,
        CAST(n <= 1 OR (components = 1 AND m - blocks = n - 1) AS BIGINT) AS cactus, CAST(good = blocks AS BIGINT) AS outerplanar, components, bicomponents, blocks, max_blocks, bridges, n - bridges AS bridge_trees,
        max_degree, min_degree, max_block_degree, min_block_degree, max_easiness, min_easiness, spanning_trees, simple_cycles,
        CAST(components <= 1 AND crit <= 2 AND crowded <= 2 AS BIGINT) AS weakly_traceable, trails, n, m FROM raw)"""

#: measures by the names of the filter tool and the columns of `shape` that they equal here, where labels are distinct
MEASURES = {
    "graphName": "graph_id", "label": "graph_id % 3", "connected": "connected", "outerplanar": "outerplanar", "tree": "tree", "cactus": "cactus", "path": "path",
    "traceableCactus": "CAST(cactus = 1 AND trails > 0 AS BIGINT)", "weaklyTraceable": "weakly_traceable", "spanningTreeListing": "spanning_trees", "nonisomorphicSpanningTrees": "spanning_trees",
    "numberOfBlocks": "blocks", "maxBlocksPerComponent": "max_blocks", "numberOfBridges": "bridges", "numberOfBridgeTrees": "bridge_trees", "numberOfVertices": "n", "numberOfEdges": "m",
    "numberOfNonIsoCycles": "simple_cycles", "numberOfSimpleCycles": "simple_cycles", "numberOfBiconnectedComponents": "bicomponents", "numberOfConnectedComponents": "components",
    "maxDegree": "max_degree", "minDegree": "min_degree", "maxBlockDegree": "max_block_degree", "minBlockDegree": "min_block_degree", "maxLocalEasiness": "max_easiness", "minLocalEasiness": "min_easiness",
}


def _named_measures(s, d):
    g = graphs(s, d, "session")
    for name in MEASURES:
        g = measures.value(g, name).withColumnRenamed("value", f"m_{name}")
    return g.select("graph_id", F.explode(F.array(*(F.struct(F.lit(x).alias("measure"), F.col(f"m_{x}").alias("value")) for x in MEASURES))).alias("x")).select("graph_id", "x.measure", "x.value")


_MEASURE_ROWS = _SHAPES + " SELECT graph_id, unnest([" + ", ".join(f"'{x}'" for x in MEASURES) + "]) AS measure, unnest([" + ", ".join(f"CAST({y} AS BIGINT)" for y in MEASURES.values()) + "]) AS value FROM shape"

_JOIN = lambda *kids: "array_to_string(list_sort([" + ", ".join(kids) + "]), '')"
_KID = lambda label, *kids: f"concat('( 1 ', {label}, ' ', " + (_JOIN(*kids) if kids else "''") + ", ') ')"
#: trees of up to five vertices by their labels: rooted at the centre, or at the lesser of two
_TREES = _ARC + f""",
    least AS (SELECT CAST(ceil(count(DISTINCT graph_id) * {SHARE} / 100.0) AS BIGINT) AS t FROM v),
    la AS (SELECT arc.graph_id, x.label AS a, y.label AS b FROM arc JOIN v AS x ON x.graph_id = arc.graph_id AND x.vid = arc.a JOIN v AS y ON y.graph_id = arc.graph_id AND y.vid = arc.b),
    hit AS (
      SELECT 1 AS size, graph_id, concat(label, ' ') AS cstring FROM v
      UNION SELECT 2, graph_id, concat(a, ' ', {_KID('b')}) FROM la WHERE a < b
      UNION SELECT 3, p.graph_id, concat(p.a, ' ', {_JOIN(_KID('p.b'), _KID('q.b'))}) FROM la p JOIN la q ON q.graph_id = p.graph_id AND q.a = p.a WHERE p.b < q.b
      UNION SELECT 4, p.graph_id, concat(p.a, ' ', {_JOIN(_KID('p.b'), _KID('q.b'), _KID('r.b'))}) FROM la p JOIN la q ON q.graph_id = p.graph_id AND q.a = p.a JOIN la r ON r.graph_id = p.graph_id AND r.a = p.a WHERE p.b < q.b AND q.b < r.b
      UNION SELECT 4, m.graph_id, concat(m.a, ' ', {_JOIN(_KID('p.b'), _KID('m.b', _KID('q.b')))}) FROM la m JOIN la p ON p.graph_id = m.graph_id AND p.a = m.a JOIN la q ON q.graph_id = m.graph_id AND q.a = m.b
        WHERE m.a < m.b AND p.b <> m.b AND q.b <> m.a AND p.b <> q.b
      UNION SELECT 5, p.graph_id, concat(p.a, ' ', {_JOIN(_KID('p.b'), _KID('q.b'), _KID('r.b'), _KID('s.b'))}) FROM la p JOIN la q ON q.graph_id = p.graph_id AND q.a = p.a JOIN la r ON r.graph_id = p.graph_id AND r.a = p.a
        JOIN la s ON s.graph_id = p.graph_id AND s.a = p.a WHERE p.b < q.b AND q.b < r.b AND r.b < s.b
      UNION SELECT 5, p.graph_id, concat(p.a, ' ', {_JOIN(_KID('p.b', _KID('x.b')), _KID('q.b', _KID('y.b')))}) FROM la p JOIN la q ON q.graph_id = p.graph_id AND q.a = p.a JOIN la x ON x.graph_id = p.graph_id AND x.a = p.b
        JOIN la y ON y.graph_id = p.graph_id AND y.a = q.b WHERE p.b < q.b AND x.b NOT IN (p.a, q.b) AND y.b NOT IN (p.a, p.b) AND x.b <> y.b
      UNION SELECT 5, m.graph_id, CASE WHEN m.a < m.b THEN concat(m.a, ' ', {_JOIN(_KID('p.b'), _KID('q.b'), _KID('m.b', _KID('y.b')))}) ELSE concat(m.b, ' ', {_JOIN(_KID('m.a', _KID('p.b'), _KID('q.b')), _KID('y.b'))}) END
        FROM la m JOIN la p ON p.graph_id = m.graph_id AND p.a = m.a JOIN la q ON q.graph_id = m.graph_id AND q.a = m.a JOIN la y ON y.graph_id = m.graph_id AND y.a = m.b
        WHERE p.b < q.b AND p.b <> m.b AND q.b <> m.b AND y.b NOT IN (m.a, p.b, q.b)),
    found AS (SELECT size, cstring, count(*) AS support FROM hit GROUP BY 1, 2 HAVING count(*) >= (SELECT t FROM least))"""


def _threshold(g: DataFrame) -> int:
    return -(-g.count() * SHARE // 100)


def _mined(name: str):
    def query(s, d):
        g = graphs(s, d, "session")
        return mining.mine(g, _threshold(g), PATTERN, name, 1)[0].select("size", "cstring", F.col("support").cast("long").alias("support"))

    return query


#: containment methods that are exact without sampling
EXACT = tuple(m for m, (_, how) in poset.FEATURES.items() if how in ("tree", "local"))


def _poset(s, d):
    g = graphs(s, d, "session")
    patterns = sorted(r["cstring"] for r in mining.mine(g, _threshold(g), PATTERN)[0].select("cstring").collect())
    order, rows = poset.Poset(patterns).patterns, None
    names = s.createDataFrame(list(enumerate(order)), "pattern int, cstring string")
    for m in EXACT:
        one = poset.embed(g, patterns, m).select("graph_id", F.lit(m).alias("method"), F.explode("features").alias("pattern"))
        rows = one if rows is None else rows.unionByName(one)
    held = rows.join(F.broadcast(names), "pattern").groupBy("method", "graph_id")
    return held.agg(F.array_join(F.array_sort(F.collect_list("cstring")), "|").alias("patterns"))


#: slots of the sketch: patterns, numbered from 1 by size and name, in the order of number * slot modulo a prime
SLOTS, PRIME = (1234, 5678, 777, 4321), 10007


def _min_hash(s, d):
    g = graphs(s, d, "session")
    patterns = sorted(r["cstring"] for r in mining.mine(g, _threshold(g), PATTERN)[0].select("cstring").collect())
    order = poset.Poset(patterns)
    orders = [sorted(range(len(patterns)), key=lambda k: (k + 1) * x % PRIME) for x in SLOTS]
    places = [(j, at, order.patterns[k]) for j, p in enumerate(orders) for at, k in enumerate(order.shrunk(p))]
    names = s.createDataFrame(places, "slot int, place int, cstring string")
    slots = poset.sketch(g, patterns, "minHash", len(orders), orders=orders).select("graph_id", F.posexplode("sketch").alias("slot", "place"))
    return slots.join(F.broadcast(names), ["slot", "place"]).select("graph_id", F.col("slot").cast("long").alias("slot"), "cstring")


def _numbered(s, d):
    """The mined patterns, numbered from 1 by name."""
    g = graphs(s, d, "session")
    patterns, postings = mining.mine(g, _threshold(g), 3)
    known = patterns.withColumn("number", F.row_number().over(Window.orderBy("cstring")))  # a few dozen patterns
    return g, known, postings.join(F.broadcast(known.select("pattern_id", "number", "cstring", "support")), "pattern_id")


_NUMBERED = _TREES + ", num AS (SELECT cstring, support, row_number() OVER (ORDER BY cstring) AS number FROM found WHERE size <= 3)"


def _held_numbers(s, d):
    return _numbered(s, d)[2].groupBy("graph_id").agg(F.collect_list("number").alias("features"))


def _posting_lines(s, d):
    _, _, rows = _numbered(s, d)
    return io.posting_lines(rows.select(F.col("number").alias("pattern_id"), "graph_id")).select("value")


def _sparse_lines(s, d):
    g, _, rows = _numbered(s, d)
    held = rows.groupBy("graph_id").agg(F.collect_list("number").alias("features"))
    none = F.array().cast("array<int>")
    return io.sparse_lines(g.join(held, "graph_id", "left").withColumn("features", F.coalesce("features", none)))


def _pattern_lines(s, d):
    _, known, _ = _numbered(s, d)
    return formats.pattern_lines(known.select(F.col("number").alias("pattern_id"), F.col("support").cast("long").alias("support"), "cstring"), 1)


def _samplers(s, d):
    """Conversations are paths: their only spanning tree is the path itself, whoever draws it."""
    g = graphs(s, d, "conv")
    every = ("wilson", "kruskal", "listing", "mix", "partialListing", "bridgeForest", "listOrSample", "cactus")
    rows = reduce(DataFrame.unionByName, [measures.sampled_trees(g, 3, how=h, by_component=True).withColumn("sampler", F.lit(h)) for h in every])
    return rows.select("graph_id", "sampler", "cstring").distinct()


def _sampled(s, d):
    """The different trees that each sampler draws of a session in 30 turns."""
    g = cut(graphs(s, d, "session"))
    every = ("wilson", "kruskal", "listing", "mix", "partialListing", "listOrSample")
    rows = reduce(DataFrame.unionByName, [measures.sampled_trees(g, 30, how=h, threshold=3).withColumn("sampler", F.lit(h)) for h in every])
    return rows.select("graph_id", "sampler", "cstring").distinct().groupBy("graph_id", "sampler").agg(F.count("*").alias("trees"))


def _read_back(s, d):
    back = io.from_text(io.graph_text(graphs(s, d, "session")).select("value"))
    return back.select("graph_id", "activity", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), F.array_join("vlabels", " ").alias("labels"), F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["src"], e["dst"], e["label"])), " ").alias("links"))


def _rollup(s, d):
    v = io.explode_vertices(graphs(s, d, "session")).withColumn("third", F.col("graph_id") % 3)
    sums = v.rollup("third", "label").agg(F.count("*").alias("vertices"), F.grouping_id().alias("level"))
    return sums.select(F.coalesce("third", F.lit(-1)).cast("long").alias("third"), F.coalesce("label", F.lit("all")).alias("label"), "vertices", "level")


def _days(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.dayofweek("w.start").cast("long").alias("weekday"), "event_type", "events", "total")


_START = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias("start")


def _session_windows(s, d):
    """The session graphs of the stream operator, over the table."""
    g = graph_stream.session_graphs(s.read.parquet(f"{d}/events.parquet"))
    links = F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["src"], e["dst"], e["label"])), " ")
    return g.select(F.col("user_id").cast("long").alias("user_id"), _START("start"), F.array_join("vlabels", " ").alias("labels"), links.alias("links"))


def _sliding(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return graph_stream.windowed_support(e, "6 hours", "3 hours").select(_START("start"), "event_type", "events")


def _last_view(s, d):
    """Each purchase with the user's last view before it: an as-of join by one window instead of a join."""
    e = s.read.parquet(f"{d}/events.parquet").where("event_type in ('view', 'purchase')")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(before)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", F.coalesce("view_id", F.lit(-1)).cast("long").alias("view_id"))


def _near_errors(s, d):
    """Errors in the hour after each purchase of the same user: an interval join on equal users and hour buckets."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").alias("bucket"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("t0"), F.explode(F.array("bucket", F.col("bucket") + F.expr("interval 1 hour"))).alias("bucket"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("t1"), "bucket")
    return bought.join(errors, ["user_id", "bucket"]).where("t1 >= t0 and t1 < t0 + interval 1 hour").select("purchase_id", "error_id")


_CYCLE_NAMES = " SELECT x.graph_id, x.graph_id % 3 AS activity, concat('( ', string_agg(concat('1 ', label, ' '), '' ORDER BY i), ') ') AS cstring, CAST(1 AS BIGINT) AS occurrences FROM (SELECT graph_id, seen, i FROM cyc, UNNEST(range(1, len(seen) + 1)) AS t(i)) AS x JOIN v ON v.graph_id = x.graph_id AND v.vid = seen[i] GROUP BY x.graph_id, seen"
#: trees of the forest of bridges: the hits along bridges that are as large as the tree of their root
_FOREST = _BLOCKS + ", br AS (SELECT graph_id, s AS src, d AS dst FROM part JOIN psize USING (graph_id, part) WHERE m = 1), arc2 AS (SELECT graph_id, src AS a, dst AS b FROM br UNION ALL SELECT graph_id, dst, src FROM br)" + _TREES.removeprefix(_ARC).replace("FROM arc JOIN", "FROM arc2 AS arc JOIN") + """,
    breach AS (SELECT graph_id, vid AS a, vid AS b FROM v UNION SELECT r.graph_id, r.a, x.b FROM breach r JOIN arc2 x ON x.graph_id = r.graph_id AND x.a = r.b),
    bcomp AS (SELECT graph_id, a AS vid, min(b) AS c FROM breach GROUP BY 1, 2),
    bsize AS (SELECT graph_id, c, count(*) AS n FROM bcomp GROUP BY 1, 2),
    whole AS (SELECT h.graph_id, h.cstring, h.size FROM hit h JOIN v ON v.graph_id = h.graph_id AND v.label = split_part(h.cstring, ' ', 1) JOIN bcomp ON bcomp.graph_id = v.graph_id AND bcomp.vid = v.vid JOIN bsize ON bsize.graph_id = bcomp.graph_id AND bsize.c = bcomp.c AND bsize.n = h.size)"""
_TREE_NAMES = " SELECT graph_id, graph_id % 3 AS activity, cstring, CAST(1 AS BIGINT) AS occurrences FROM whole"


def _patterns(which):
    return lambda s, d: pattern_kernels.cyclic_patterns(graphs(s, d, "session"), which)


def _plain(column: str) -> str:
    return with_views("user", _SHAPES + f" SELECT graph_id, CAST({column} AS BIGINT) AS value FROM shape")


#: SQL of queries over user graphs, whose labels are distinct too
USER_SQL = {f"{x}_user": _plain(MEASURES[x]) for x in ("numberOfSimpleCycles", "numberOfNonIsoCycles", "traceableCactus", "weaklyTraceable", "nonisomorphicSpanningTrees")}
USER_SQL["block_measures_user"] = with_views("user", _SHAPES + " SELECT graph_id, " + ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("cactus", "outerplanar", "bicomponents", "blocks", "max_blocks", "bridges", "bridge_trees", "max_block_degree", "min_block_degree", "max_easiness", "min_easiness", "spanning_trees")) + " FROM shape")

_SHAPE_COLUMNS = ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in measures.NAMES)
_FULL_PATH = "SELECT graph_id, min(s) AS cstring FROM rooted JOIN (SELECT graph_id, count(*) AS n FROM v GROUP BY 1) AS k USING (graph_id) WHERE size = n GROUP BY 1"

QUERIES = {
    "sizes_session": (lambda s, d: graphs(s, d, "session").select("graph_id", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m")), with_views("session", "SELECT v.graph_id, n, CAST(coalesce(m, 0) AS BIGINT) AS m FROM (SELECT graph_id, count(*) AS n FROM v GROUP BY graph_id) AS v LEFT JOIN (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id) AS e USING (graph_id)")),
    "measures_session": (lambda s, d: measures.measure(graphs(s, d, "session")), with_views("session", _SHAPES + f" SELECT graph_id, {_SHAPE_COLUMNS} FROM shape")),
    "named_measures_session": (_named_measures, with_views("session", _MEASURE_ROWS)),
    "bicomponent_edges_session": (lambda s, d: measures.bicomponent_edges(graphs(s, d, "session")).select("graph_id", F.col("part").cast("long").alias("part"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("block").cast("long").alias("block")),
        with_views("session", _BLOCKS + " SELECT graph_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY part) - 1 AS BIGINT) AS part, s AS src, d AS dst, CAST(m > 1 AS BIGINT) AS block FROM part JOIN psize USING (graph_id, part)")),
    "cycles_of_length_session": (lambda s, d: measures.cycles_of_length(graphs(s, d, "session"), 4).select("graph_id", F.array_join("cycle", " ").alias("cycle")), with_views("session", _BLOCKS + " SELECT graph_id, array_to_string(seen, ' ') AS cycle FROM cyc WHERE len(seen) = 4")),
    "neighbourhoods_session": (lambda s, d: measures.neighbourhood_graphs(graphs(s, d, "session")).select("graph_id", F.col("centre").cast("long").alias("centre"), F.array_join("vlabels", " ").alias("labels"), F.col("m").cast("long").alias("m")),
        with_views("session", _ARC + """, near AS (SELECT graph_id, a AS c, b AS x FROM arc UNION SELECT graph_id, vid, vid FROM v), inner_ AS (SELECT p.graph_id, p.c, count(*) AS m FROM e JOIN near AS p ON p.graph_id = e.graph_id AND p.x = e.src JOIN near AS q ON q.graph_id = e.graph_id AND q.x = e.dst AND q.c = p.c GROUP BY 1, 2)
        SELECT near.graph_id, near.c AS centre, string_agg(v.label, ' ' ORDER BY v.vid) AS labels, CAST(coalesce(max(inner_.m), 0) AS BIGINT) AS m FROM near JOIN v ON v.graph_id = near.graph_id AND v.vid = near.x LEFT JOIN inner_ ON inner_.graph_id = near.graph_id AND inner_.c = near.c GROUP BY 1, 2""")),
    **{f"mine_{x}_session": (_mined(x), with_views("session", _TREES + " SELECT CAST(size AS INTEGER) AS size, cstring, support FROM found")) for x in ("subtree", "subtree_iterative", "subtree_absimp")},
    "poset_exact_session": (_poset, with_views("session", _TREES + f" SELECT method, graph_id, string_agg(cstring, '|' ORDER BY cstring) AS patterns FROM hit JOIN found USING (cstring), (SELECT unnest({list(EXACT)}) AS method) AS ms GROUP BY 1, 2")),
    "tree_strings_session": (lambda s, d: measures.canonical_strings(graphs(s, d, "session")).where("cstring is not null"), with_views("session", _FOREST + " SELECT graph_id, cstring FROM whole JOIN size USING (graph_id) WHERE whole.size = size.n")),
    "cyclic_patterns_session": (_patterns("all"), with_views("session", _FOREST + _CYCLE_NAMES + " UNION ALL" + _TREE_NAMES)),
    "cycle_patterns_session": (_patterns("cycles"), with_views("session", _BLOCKS + _CYCLE_NAMES)),
    "tree_patterns_session": (_patterns("trees"), with_views("session", _FOREST + _TREE_NAMES)),
    "min_hash_session": (_min_hash, with_views("session", _TREES + f", num AS (SELECT cstring, row_number() OVER (ORDER BY size, cstring) AS number FROM found) SELECT graph_id, CAST(slot AS BIGINT) AS slot, arg_min(cstring, number * x % {PRIME}) AS cstring FROM hit JOIN num USING (cstring), (SELECT unnest(range({len(SLOTS)})) AS slot, unnest({list(SLOTS)}) AS x) AS s GROUP BY 1, 2")),
    "mine_localEasy_session": (_mined("localEasy"), with_views("session", _TREES + " SELECT CAST(size AS INTEGER) AS size, cstring, support FROM found")),
    "feature_lines_session": (lambda s, d: io.array_lines(_held_numbers(s, d), "features", "graph_id", True), with_views("session", _NUMBERED + " SELECT concat_ws(' ', graph_id, string_agg(concat(number, ':1'), ' ' ORDER BY number)) AS value FROM hit JOIN num USING (cstring) GROUP BY graph_id")),
    "posting_lines_session": (_posting_lines, with_views("session", _NUMBERED + " SELECT concat(number, ': ', string_agg(CAST(graph_id AS VARCHAR), ' ' ORDER BY graph_id)) AS value FROM hit JOIN num USING (cstring) GROUP BY number")),
    "sparse_lines_session": (_sparse_lines, with_views("session", _NUMBERED + " SELECT g.graph_id, concat(g.graph_id % 3, ' ', coalesce(string_agg(concat(number, ':1'), ' ' ORDER BY number), '')) AS value FROM (SELECT DISTINCT graph_id FROM v) AS g LEFT JOIN (SELECT graph_id, number FROM hit JOIN num USING (cstring)) AS x USING (graph_id) GROUP BY g.graph_id")),
    "pattern_lines_session": (_pattern_lines, with_views("session", _NUMBERED + " SELECT concat(support + 1, chr(9), number, chr(9), cstring) AS value FROM num")),
    "read_back_session": (_read_back, with_views("session", """, vl AS (SELECT graph_id, count(*) AS n, string_agg(label, ' ' ORDER BY vid) AS labels FROM v GROUP BY 1), el AS (SELECT graph_id, count(*) AS m, string_agg(concat(src, '-', dst, '-', label), ' ' ORDER BY src, dst) AS links FROM e GROUP BY 1)
        SELECT graph_id, graph_id % 3 AS activity, n, CAST(coalesce(m, 0) AS BIGINT) AS m, labels, coalesce(links, '') AS links FROM vl LEFT JOIN el USING (graph_id)""")),
    "gaston_session": (lambda s, d: io.gaston_lines(graphs(s, d, "session")), with_views("session", """, vl AS (SELECT graph_id, string_agg(concat('v ', vid, ' ', label), chr(10) ORDER BY vid) AS l FROM v GROUP BY 1), el AS (SELECT graph_id, string_agg(concat('e ', src, ' ', dst, ' ', label), chr(10) ORDER BY src, dst) AS l FROM e GROUP BY 1)
        SELECT graph_id, concat_ws(chr(10), concat('t # ', graph_id), vl.l, el.l) AS value FROM vl LEFT JOIN el USING (graph_id)""")),
    **{f"dot_{'directed_' if x else ''}session": (lambda s, d, x=x: io.dot(graphs(s, d, "session"), x), with_views("session", f""", vl AS (SELECT graph_id, string_agg(concat('  ', vid, ' [label="', label, '"];'), chr(10) ORDER BY vid) AS l FROM v GROUP BY 1), el AS (SELECT graph_id, string_agg(concat('  ', src, ' {'->' if x else '--'} ', dst, ' [label="', label, '"];'), chr(10) ORDER BY src, dst) AS l FROM e GROUP BY 1)
        SELECT graph_id, concat_ws(chr(10), concat('{'di' if x else ''}graph ', graph_id, ' {{'), vl.l, el.l, '}}') AS value FROM vl LEFT JOIN el USING (graph_id)""")) for x in (False, True)},
    **{f"directed_edges_{x}": (lambda s, d, x=x: mining.directed_edge_support(graphs(s, d, "conv") if x == "conv" else measures.reverse(graphs(s, d, "conv"))), with_views("conv", f"SELECT a.label AS low, e.label AS edge_label, b.label AS high, count(DISTINCT e.graph_id) AS support FROM e JOIN v AS a ON a.graph_id = e.graph_id AND a.vid = e.{'src' if x == 'conv' else 'dst'} JOIN v AS b ON b.graph_id = e.graph_id AND b.vid = e.{'dst' if x == 'conv' else 'src'} GROUP BY 1, 2, 3")) for x in ("conv", "reversed")},
    "sampled_trees_session": (_sampled, None),
    "label_rollup_session": (_rollup, with_views("session", "SELECT CAST(coalesce(graph_id % 3, -1) AS BIGINT) AS third, coalesce(label, 'all') AS label, count(*) AS vertices, grouping_id(graph_id % 3, label) AS level FROM v GROUP BY ROLLUP (graph_id % 3, label)")),
    "event_windows": (_days, "SELECT strftime(time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, CAST(dayofweek(time_bucket(INTERVAL '6' HOUR, ts, TIMESTAMP '1970-01-01')) + 1 AS BIGINT) AS weekday, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"),
    "session_windows": (_session_windows, with_views("session", f""", t AS (SELECT graph_id, min(ts) AS start FROM ({_SESSIONS}) AS s GROUP BY 1), vl AS (SELECT graph_id, string_agg(label, ' ' ORDER BY vid) AS labels FROM v GROUP BY 1), el AS (SELECT graph_id, string_agg(concat(src, '-', dst, '-', label), ' ' ORDER BY src, dst) AS links FROM e GROUP BY 1)
        SELECT CAST(graph_id // 10000 AS BIGINT) AS user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, labels, coalesce(links, '') AS links FROM t JOIN vl USING (graph_id) LEFT JOIN el USING (graph_id)""")),
    "sliding_windows": (_sliding, "SELECT strftime(w - k * INTERVAL '3' HOUR, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events FROM (SELECT time_bucket(INTERVAL '3' HOUR, ts, TIMESTAMP '1970-01-01') AS w, event_type FROM events) AS e, UNNEST(range(2)) AS t(k) GROUP BY 1, 2"),
    "last_view": (_last_view, "SELECT event_id, coalesce((SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))), -1) AS view_id FROM events a WHERE event_type = 'purchase'"),
    "errors_after_purchase": (_near_errors, "SELECT a.event_id AS purchase_id, b.event_id AS error_id FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'error' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL '1' HOUR WHERE a.event_type = 'purchase'"),
}


def with_paths(paths: str) -> dict:
    """Queries whose SQL needs the path names of `patterns`."""
    return {"samplers_conv": (_samplers, with_views("conv", paths + ", whole AS (" + _FULL_PATH + ") SELECT graph_id, sampler, cstring FROM whole, (SELECT unnest(['wilson', 'kruskal', 'listing', 'mix', 'partialListing', 'bridgeForest', 'listOrSample', 'cactus']) AS sampler) AS x"))}
