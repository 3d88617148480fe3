"""Structural measures of graphs and filters on them."""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding, kernels, structure
from ..sources.graphs import arcs, explode_edges, explode_vertices, text_column
from ._session import numbered

NAMES = tuple(kernels.MEASURES)
COMPARE = {"<=": "__le__", "==": "__eq__", ">=": "__ge__", "!=": "__ne__", "<": "__lt__", ">": "__gt__"}


def _pairs(edges) -> list[tuple[int, int]]:
    return [(e["src"], e["dst"]) for e in edges]


def bounded(v: int) -> int:
    if v > structure.MAX_LONG:
        raise OverflowError("a measure exceeds 63 bits")
    return v


def measure(graphs: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """The named structural measures of each graph, one Arrow-batched pass; only these are worked out. Values over 63 bits raise."""

    def run(batches):
        for b in batches:
            rows = [{k: bounded(v) for k, v in kernels.measures(n, _pairs(e), names).items()} for n, e in zip(b["n"], b["edges"])]
            out = pd.DataFrame(rows, columns=names, dtype="int64")
            out.insert(0, "graph_id", b["graph_id"].to_numpy())
            yield out

    return graphs.select("graph_id", "n", "edges").mapInPandas(run, "graph_id long, " + ", ".join(f"{x} long" for x in names))


def condition(column, comparator: str, value):
    """measure <comparator> value; 'pass' holds always."""
    return F.lit(True) if comparator == "pass" else getattr(column, COMPARE[comparator])(value)


def _sampled(labels, edges, samples, rng, classes):
    """Different spanning trees (or classes of them) among `samples` uniform ones, added over components."""
    out = 0
    for v, e, _ in structure.split_components(labels, edges):
        pairs, link = [x[:2] for x in e], structure.links(e)
        drawn = {tuple(kernels.wilson(len(v), pairs, rng)) for _ in range(samples)}
        out += len({kernels.free_string(v, [(*p, link[p]) for p in t]) for t in drawn} if classes else drawn)
    return out


def _local(labels, edges, samples, rng, unique, classes):
    """Combinations of local sampled trees, or classes of the forests they make."""
    local = embedding.LocalTrees(labels, edges, samples, rng, unique)
    if not classes:
        return local.combinations()
    link, bridges = structure.links(edges), structure.bridge_forest(labels, edges)[1]
    forest = lambda c: [*bridges, *((*p, link[p]) for t in c for p in t)]
    return len({tuple(structure.forest_strings(labels, forest(c))) for c in product(*local.trees.values())})


def _per_component(f):
    return lambda v, e, a, r: f(v, e, a, r) // max(1, len(set(kernels.component_ids(len(v), [x[:2] for x in e]))))


_pair = lambda e: [x[:2] for x in e]
#: measures that need more than the shape: (labels, edges, argument, random numbers) -> value
EXTRA = {
    "traceableCactus": lambda v, e, a, r: int(structure.traceable_cactus(len(v), _pair(e))),
    "weaklyTraceable": lambda v, e, a, r: int(structure.weakly_traceable(len(v), _pair(e))),
    "spanningTreeEstimate": lambda v, e, a, r: structure.tree_estimate(len(v), _pair(e)),
    "spanningTreeListing": lambda v, e, a, r: structure.capped_trees(len(v), _pair(e), a),
    "nonisomorphicSpanningTrees": lambda v, e, a, r: structure.tree_classes(v, e),
    "nonisomorphicSampledSpanningTrees": lambda v, e, a, r: _sampled(v, e, a, r, True),
    "sampledSpanningTreesFiltered": lambda v, e, a, r: _sampled(v, e, a, r, False),
    "nonisomorphicLocallySampledSpanningTrees": lambda v, e, a, r: _local(v, e, a, r, False, True),
    "nonisomorphicLocallySampledSpanningTreesFiltered": lambda v, e, a, r: _local(v, e, a, r, True, True),
    "locallySampledSpanningTrees": lambda v, e, a, r: _local(v, e, a, r, False, False),
    "locallySampledSpanningTreesFiltered": lambda v, e, a, r: _local(v, e, a, r, True, False),
    "numberOfNonIsoCycles": lambda v, e, a, r: len(set(structure.cycle_strings(v, e))),
    "numberOfSimpleCycles": lambda v, e, a, r: sum(1 for _ in kernels.simple_cycles(len(v), _pair(e))),
}
EXTRA |= {f"{x}Normalized": _per_component(EXTRA[x]) for x in ("nonisomorphicSampledSpanningTrees", "nonisomorphicLocallySampledSpanningTrees", "nonisomorphicLocallySampledSpanningTreesFiltered", "locallySampledSpanningTrees", "locallySampledSpanningTreesFiltered")}
#: measures that are columns of `measure`
SHAPE = {"numberOfBlocks": "blocks", "maxBlocksPerComponent": "max_blocks", "numberOfBridges": "bridges", "numberOfBridgeTrees": "bridge_trees", "numberOfBiconnectedComponents": "bicomponents", "numberOfConnectedComponents": "components", "maxDegree": "max_degree", "minDegree": "min_degree", "maxBlockDegree": "max_block_degree", "minBlockDegree": "min_block_degree", "maxCycleDegree": "max_block_degree", "minCycleDegree": "min_block_degree", "maxLocalEasiness": "max_easiness", "minLocalEasiness": "min_easiness"} | {x: x for x in NAMES}
PLAIN = {"graphName": "graph_id", "label": "activity", "numberOfVertices": "n", "numberOfEdges": "m"}


def value(graphs: DataFrame, name: str, argument: int = 1000, seed: int = 0) -> DataFrame:
    """graphs with the named measure as a column `value`. `argument`: samples, or the bound over which a count is -1.

    Sizes, ids, labels and random numbers are plain columns; the others are one Arrow-batched pass without a shuffle."""
    if name in PLAIN:
        return graphs.withColumn("value", F.col(PLAIN[name]).cast("long"))
    if name == "randomSample":
        return graphs.withColumn("value", F.pmod(F.xxhash64("graph_id", F.lit(seed)), F.lit(1000)))
    if name == "count":
        return numbered(graphs, "graph_id", "value")
    if name not in EXTRA and name not in SHAPE:
        raise ValueError(f"unknown measure {name!r}")

    def one(g, labels, edges):
        e = [(x["src"], x["dst"], x["label"]) for x in edges]
        if name in EXTRA:
            out = EXTRA[name](list(labels), e, argument, random.Random(f"{seed}/{g}"))
        else:
            out = kernels.measures(len(labels), _pairs(edges), (SHAPE[name],))[SHAPE[name]]
            if name in ("maxLocalEasiness", "minLocalEasiness") and out > argument:
                out = -1
        return bounded(out)

    @F.pandas_udf("long")
    def run(ids: pd.Series, labels: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(ids, labels, edges)], dtype="int64")

    return graphs.withColumn("value", run("graph_id", "vlabels", "edges"))


def filter_graphs(graphs: DataFrame, name: str, comparator: str = "pass", threshold: int = 0, argument: int = 1000, output: str = "graph", seed: int = 0) -> DataFrame:
    """The graphs whose measure compares so; output: graph, idAndValue, id, value or print (text of the graph and value)."""
    kept = value(graphs, name, argument, seed).where(condition(F.col("value"), comparator, threshold))
    if output == "print":
        return kept.select("graph_id", text_column().alias("text"), "value")
    return kept.drop("value") if output == "graph" else kept.select(*{"idAndValue": ("graph_id", "value"), "id": ("graph_id",), "value": ("value",)}[output])


def degrees(graphs: DataFrame) -> DataFrame:
    """(graph_id, vid, degree) of every vertex, those without edges too."""
    ends = arcs(graphs).select("graph_id", F.col("src").alias("vid"), F.lit(1).alias("d"))
    return ends.union(explode_vertices(graphs).select("graph_id", "vid", F.lit(0))).groupBy("graph_id", "vid").agg(F.sum("d").alias("degree"))


def vertex_support(graphs: DataFrame) -> DataFrame:
    """Graphs that hold each vertex label."""
    return explode_vertices(graphs).groupBy("label").agg(F.countDistinct("graph_id").alias("support"))


def edge_support(graphs: DataFrame) -> DataFrame:
    """Graphs that hold each labelled edge; end labels in bytewise order."""
    v = explode_vertices(graphs)
    e = explode_edges(graphs).withColumnRenamed("label", "edge_label")
    a, b = v.select("graph_id", F.col("vid").alias("src"), F.col("label").alias("la")), v.select("graph_id", F.col("vid").alias("dst"), F.col("label").alias("lb"))
    e = e.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return e.select("graph_id", F.least("la", "lb").alias("low"), "edge_label", F.greatest("la", "lb").alias("high")).groupBy("low", "edge_label", "high").agg(F.countDistinct("graph_id").alias("support"))


def triangles(graphs: DataFrame) -> DataFrame:
    """Triangles of each graph, each once."""
    e = explode_edges(graphs).select("graph_id", "src", "dst")
    two = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select("graph_id", F.col("src").alias("b"), F.col("dst").alias("c")), ["graph_id", "b"])
    return two.join(e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("c")), ["graph_id", "a", "c"]).groupBy("graph_id").agg(F.count("*").alias("triangles"))


def unlabel(graphs: DataFrame, label: str = "1") -> DataFrame:
    one = F.lit(label)
    return graphs.withColumns({"vlabels": F.transform("vlabels", lambda x: one), "edges": F.transform("edges", lambda e: e.withField("label", one))})


def recode(graphs: DataFrame, how: str) -> DataFrame:
    """Targets: a: 2 becomes 1, others -1; m: 0 becomes -1, 2 becomes 1; i: 1 goes, then a; d: the graph id."""
    t = F.col("activity")
    if how == "i":
        graphs, how = graphs.where(t != 1), "a"
    new = {"a": F.when(t == 2, 1).otherwise(-1), "m": F.when(t == 0, -1).when(t == 2, 1).otherwise(t), "d": F.col("graph_id")}[how]
    return graphs.withColumn("activity", new.cast("long"))


def weisfeiler_lehman(graphs: DataFrame, rounds: int = 1) -> DataFrame:
    """(graph_id, vid, label): labels are ranks of (own label, sorted neighbour labels) over the whole collection, by dictionary join."""
    v, a = explode_vertices(graphs), arcs(graphs).select("graph_id", "src", "dst")
    for _ in range(rounds):
        near = a.join(v.select("graph_id", F.col("vid").alias("dst"), "label"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("label")).alias("near"))
        named = v.join(near, ["graph_id", "vid"], "left").select("graph_id", "vid", F.concat_ws(" ", F.array("label"), F.coalesce("near", F.array().cast("array<string>"))).alias("label"))
        v = named
    return v


def neighbourhoods(graphs: DataFrame, with_centre: bool = True) -> DataFrame:
    """The subgraph induced by each vertex's neighbours (and itself): (graph_id, centre, vertices, edges) sizes."""
    a = arcs(graphs).select("graph_id", F.col("src").alias("centre"), F.col("dst").alias("vid"))
    if with_centre:
        a = a.union(explode_vertices(graphs).select("graph_id", F.col("vid").alias("centre"), "vid"))
    e = explode_edges(graphs)
    inside = e.join(a.withColumnRenamed("vid", "src"), ["graph_id", "src"]).join(a.withColumnRenamed("vid", "dst"), ["graph_id", "centre", "dst"])
    count = inside.groupBy("graph_id", "centre").agg(F.count("*").alias("n_edges"))
    return a.groupBy("graph_id", "centre").agg(F.count("*").alias("n_vertices")).join(count, ["graph_id", "centre"], "left").fillna(0, ["n_edges"])


def canonical_strings(graphs: DataFrame, rooted: bool = False) -> DataFrame:
    """(graph_id, cstring) of trees; null for graphs that are none."""

    @F.pandas_udf("string")
    def name(labels: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for v, e in zip(labels, edges):
            t = [(x["src"], x["dst"], x["label"]) for x in e]
            ok = len(t) == len(v) - 1 and len(set(kernels.component_ids(len(v), [x[:2] for x in t]))) == 1
            out.append((kernels.rooted_string(list(v), t) if rooted else kernels.free_string(list(v), t)) if ok else None)
        return pd.Series(out)

    return graphs.select("graph_id", name("vlabels", "edges").alias("cstring"))


def sampled_trees(graphs: DataFrame, samples: int = 5, seed: int = 0, how: str = "wilson", threshold: int = 1000, by_component: bool = False) -> DataFrame:
    """(graph_id, sample, cstring): spanning trees, seeded by graph; unconnected graphs have none unless taken by component.

    how: wilson (uniform), kruskal, listing, mix, partialListing, cactus, bridgeForest, listOrSample. Trees of a forest count apart."""

    def run(batches):
        for b in batches:
            rows = []
            for g, labels, edges in zip(b["graph_id"], b["vlabels"], b["edges"]):
                e = [(x["src"], x["dst"], x["label"]) for x in edges]
                parts = structure.split_components(list(labels), e)
                if len(parts) != 1 and not by_component and how != "bridgeForest":
                    continue
                rng, found = random.Random(f"{seed}/{g}"), []
                for v, pe, _ in parts:
                    link = structure.links(pe)
                    for tree in embedding.tree_sampler(how, len(v), [x[:2] for x in pe], samples, threshold, rng):
                        found += structure.forest_strings(v, [(*p, link[p]) for p in tree])
                rows += [(g, k, c) for k, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["graph_id", "sample", "cstring"])

    return graphs.select("graph_id", "vlabels", "edges").mapInPandas(run, "graph_id long, sample int, cstring string")


def distinct_trees(samples: DataFrame, keep_count: bool = False) -> DataFrame:
    """(graph_id, pattern_id, cstring[, support]): each graph's different trees; numbers are ranks in the graph."""
    from pyspark.sql import Window

    out = samples.groupBy("graph_id", "cstring").agg(F.count("*").alias("support"))
    out = out.withColumn("pattern_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("cstring")))
    return out.select("graph_id", "pattern_id", "cstring", *(["support"] if keep_count else []))


def cycles_of_length(graphs: DataFrame, length: int) -> DataFrame:
    """(graph_id, cycle): the simple cycles of a length, as vertices from the least one in the lesser direction."""

    def run(batches):
        for b in batches:
            rows = [(g, list(c)) for g, n, e in zip(b["graph_id"], b["n"], b["edges"]) for c in kernels.simple_cycles(n, _pairs(e), length)]
            yield pd.DataFrame(rows, columns=["graph_id", "cycle"])

    return graphs.select("graph_id", "n", "edges").mapInPandas(run, "graph_id long, cycle array<int>")


def neighbourhood_graphs(graphs: DataFrame, with_centre: bool = True) -> DataFrame:
    """The subgraph induced by each vertex's neighbours (and itself) as a graph row, with its `centre`; vertices keep their order."""
    near = lambda v: F.transform(F.filter("edges", lambda e: (e["src"] == v) | (e["dst"] == v)), lambda e: F.when(e["src"] == v, e["dst"]).otherwise(e["src"]))
    own = graphs.select("graph_id", "activity", "vlabels", "edges", F.posexplode("vlabels").alias("centre", "_label"))
    own = own.withColumn("_in", F.array_sort(F.concat(near(F.col("centre")), F.array("centre") if with_centre else F.array().cast("array<int>"))))
    place = lambda v: (F.array_position("_in", v) - 1).cast("int")
    inside = F.filter("edges", lambda e: F.array_contains("_in", e["src"]) & F.array_contains("_in", e["dst"]))
    edges = F.transform(inside, lambda e: F.struct(place(e["src"]).alias("src"), place(e["dst"]).alias("dst"), e["label"].alias("label")))
    out = own.select("graph_id", "centre", "activity", F.transform("_in", lambda v: F.get("vlabels", v)).alias("vlabels"), edges.alias("edges"))
    return out.withColumns({"n": F.size("vlabels"), "m": F.size("edges")}).select("graph_id", "centre", "activity", "n", "m", "vlabels", "edges")


def components(graphs: DataFrame) -> DataFrame:
    """(graph_id, vid, component): the least vertex of each vertex's connected component."""

    def run(batches):
        for b in batches:
            rows = [(g, v, c) for g, n, e in zip(b["graph_id"], b["n"], b["edges"]) for v, c in enumerate(kernels.component_ids(n, _pairs(e)))]
            yield pd.DataFrame(rows, columns=["graph_id", "vid", "component"])

    return graphs.select("graph_id", "n", "edges").mapInPandas(run, "graph_id long, vid int, component int")


def common_neighbours(graphs: DataFrame) -> DataFrame:
    """(graph_id, v, w, shared) of vertex pairs that have a neighbour in common."""
    a = arcs(graphs).select("graph_id", F.col("src").alias("via"), F.col("dst").alias("v"))
    return a.join(a.withColumnRenamed("v", "w"), ["graph_id", "via"]).where("v < w").groupBy("graph_id", "v", "w").agg(F.count("*").alias("shared"))


def bicomponent_edges(graphs: DataFrame) -> DataFrame:
    """(graph_id, part, src, dst, block): each edge with its biconnected component; block tells those of two edges or more."""

    def run(batches):
        for b in batches:
            rows = []
            for g, n, e in zip(b["graph_id"], b["n"], b["edges"]):
                parts = sorted(sorted(p) for p in kernels.bicomponents(n, _pairs(e)))
                rows += [(g, k, s, d, len(p) > 1) for k, p in enumerate(parts) for s, d in p]
            yield pd.DataFrame(rows, columns=["graph_id", "part", "src", "dst", "block"])

    return graphs.select("graph_id", "n", "edges").mapInPandas(run, "graph_id long, part int, src int, dst int, block boolean")


def reverse(graphs: DataFrame) -> DataFrame:
    """All arcs turned round."""
    return graphs.withColumn("edges", F.transform("edges", lambda e: F.struct(e["dst"].alias("src"), e["src"].alias("dst"), e["label"].alias("label"))))
