"""Frequent subtree mining: a level-wise driver loop over DataFrame jobs, with pluggable embedding operators.

The driver holds patterns (bounded by the result), never graphs. Graphs stay where they are: each level is one
Arrow-batched pass without a shuffle in which a row carries the numbers of the last level's patterns it holds, and is
tested only for candidates all of whose parents are among them. Lineage is cut by a checkpoint at every level.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding, kernels, structure
from ..sources.graphs import GRAPH, explode_edges, explode_vertices
from ._session import cut
from .measures import edge_support, vertex_support

PATTERN = "size int, cstring string, support long"
#: pattern numbers are broadcast up to this many
BROADCAST = 1_000_000
STATE = GRAPH + ", held array<int>, found array<int>"


@dataclass(frozen=True)
class Operator:
    """`test(graph, pattern, rng, i, least)` -> count, where graph is what `begin(labels, edges, rng, i)` made of the row."""

    test: object
    begin: object = None
    prepare: str | None = None
    apriori: bool = True
    rooted: bool = False
    aliases: tuple = field(default=())


def _plain(labels, edges, rng, i):
    return labels, edges


def _hops(how):
    def test(g, p, rng, i, least):
        return int(any(embedding.hops(*g, *p, rng, how) for _ in range(max(1, int(i)))))

    return test


def _estimate(g, p, rng, i, least):
    trials = max(1, int(i))
    mean = ceil(sum(embedding.hops(*g, *p, rng) for _ in range(trials)) / trials)
    return min(mean, 2**31 - 1) if mean >= least else 0


def _subtree(g, p, rng, i, least):
    return int(embedding.subtree(*g, *p))


def _absolute(g, p, rng, i, least):
    return int(embedding.important(*g, *p)[0] >= i)


def _relative(g, p, rng, i, least):
    held, parts = embedding.important(*g, *p)
    return int(parts > 0 and held / parts >= i)


def _local(labels, edges, rng, i):
    return embedding.LocalTrees(labels, edges, max(1, int(i)), rng)


def _every_local(labels, edges, rng, i):
    """All local trees; a graph with too many to list is searched itself, which gives the same answers."""
    try:
        return embedding.LocalTrees(labels, edges)
    except OverflowError:
        return embedding.Whole(labels, edges)


def _resampled(g, p, rng, i, least):
    return int(embedding.LocalTrees(*g, max(1, int(i)), rng).holds(*p))


def _rooted(g, p, rng, i, least):
    return int(embedding.rooted_subtree(*g, *p) >= 0)


def _rooted_hops(g, p, rng, i, least):
    return int(any(embedding.rooted_hops(*g, *p, rng) for _ in range(max(1, int(i)))))


#: the embedding operators by name
OPERATORS = {
    "subtree": Operator(_subtree),
    "subtree_iterative": Operator(lambda g, p, rng, i, least: int(g.holds(*p)), begin=lambda labels, edges, rng, i: embedding.Shared(labels, edges), aliases=("iterative",)),
    "subtree_relimp": Operator(_relative, aliases=("relImp",)),
    "subtree_absimp": Operator(_absolute, aliases=("absImp",)),
    "exactGlobalTreeEnumeration": Operator(_subtree, prepare="all"),
    "ps": Operator(_subtree, prepare="sampled", aliases=("probabilisticTreeSampling",)),
    "hops": Operator(_hops("maximum"), aliases=("probabilisticTreeSamplingFKF",)),
    "hops_estimate": Operator(_estimate),
    "hops_simple": Operator(_hops("simple"), aliases=("probabilisticTreeSamplingFK",)),
    "hops_simplerandom": Operator(_hops("random"), aliases=("probabilisticTreeSamplingFKR",)),
    "hops_simplematching": Operator(_hops("matching"), aliases=("probabilisticTreeSamplingFKM",)),
    "localEasy": Operator(lambda g, p, rng, i, least: int(g.holds(*p)), begin=_every_local),
    "bps": Operator(lambda g, p, rng, i, least: int(g.holds(*p)), begin=_local, aliases=("localEasySampling",)),
    "bps_resampling": Operator(_resampled, apriori=False, aliases=("localEasyResampling",)),
    "treeEnumeration": Operator(lambda g, p, rng, i, least: 1, apriori=False),
    "rootedTrees": Operator(_rooted, rooted=True),
    "rootedHops": Operator(_rooted_hops, rooted=True),
    "rootedTreeEnumeration": Operator(lambda g, p, rng, i, least: 1, apriori=False, rooted=True),
}


def operator(name: str) -> Operator:
    for key, op in OPERATORS.items():
        if name == key or name in op.aliases:
            return op
    raise ValueError(f"unknown embedding operator {name!r}")


def _triples(edges):
    return [(e["src"], e["dst"], e["label"]) for e in edges]


def spanning_forests(graphs: DataFrame, samples: int | None, seed: int = 0) -> DataFrame:
    """Each graph as the disjoint union of its components' spanning trees that are not isomorphic: all, or of `samples` uniform ones."""

    def run(batches):
        for b in batches:
            rows = []
            for g, a, labels, edges in zip(b["graph_id"], b["activity"], b["vlabels"], b["edges"]):
                rng, trees = random.Random(f"{seed}/{g}"), []
                for v, e, _ in structure.split_components(list(labels), _triples(edges)):
                    pairs, link = [x[:2] for x in e], structure.links(e)
                    drawn = structure.listed_trees(len(v), pairs) if samples is None else (kernels.wilson(len(v), pairs, rng) for _ in range(samples))
                    trees += [kernels.parse_string(c) for c in sorted({kernels.free_string(v, [(*p, link[p]) for p in t]) for t in drawn})]
                v, e = structure.merge(trees)
                rows.append((g, a, len(v), len(e), v, [{"src": min(s, d), "dst": max(s, d), "label": x} for s, d, x in e]))
            yield pd.DataFrame(rows, columns=["graph_id", "activity", "n", "m", "vlabels", "edges"])

    return graphs.mapInPandas(run, GRAPH)


def _extensions(cstring: str, rules, rooted: bool = False, outer: bool = True) -> set[str]:
    """Canonical strings of the trees with one more leaf; free trees grow at the two outermost shells around their centre only."""
    labels, edges = kernels.parse_string(cstring)
    name = kernels.rooted_string if rooted else kernels.free_string
    far = structure.distance_to_centre(len(labels), [e[:2] for e in edges]) if outer and not rooted else [0] * len(labels)
    out = set()
    for v, label in enumerate(labels):
        if far[v] >= max(far) - 1:
            for near, e, new in rules:
                if near == label:
                    out.add(name([*labels, new], [*edges, (v, len(labels), e)]))
    return out


def _parents(cstring: str, rooted: bool = False) -> set[str]:
    """Canonical strings of the trees with one leaf less; the root of a rooted one stays."""
    labels, edges = kernels.parse_string(cstring)
    name = kernels.rooted_string if rooted else kernels.free_string
    degree = [sum(v in e[:2] for e in edges) for v in range(len(labels))]
    out = set()
    for v in range(1 if rooted and len(labels) > 1 else 0, len(labels)):
        if degree[v] == 1:
            at = {x: k for k, x in enumerate(x for x in range(len(labels)) if x != v)}
            out.add(name([labels[x] for x in at], [(at[a], at[b], e) for a, b, e in edges if v not in (a, b)]))
    return out


def directed_edge_support(graphs: DataFrame) -> DataFrame:
    """Graphs that hold each labelled arc (parent label, edge label, child label); edges stand from src to dst."""
    v = explode_vertices(graphs)
    a, b = v.select("graph_id", F.col("vid").alias("src"), F.col("label").alias("low")), v.select("graph_id", F.col("vid").alias("dst"), F.col("label").alias("high"))
    e = explode_edges(graphs).withColumnRenamed("label", "edge_label").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return e.groupBy("low", "edge_label", "high").agg(F.countDistinct("graph_id").alias("support"))


def _pass(state: DataFrame, candidates, op: Operator, i, least, seed) -> DataFrame:
    """state with `held` and `found` of the candidates [(number, cstring, parents' numbers)]."""
    shared = state.sparkSession.sparkContext.broadcast([(k, kernels.parse_string(c), frozenset(p)) for k, c, p in candidates])

    def run(batches):
        for b in batches:
            every_held, every_found = [], []
            for g, labels, edges, old in zip(b["graph_id"], b["vlabels"], b["edges"], b["held"]):
                begin = op.begin or _plain
                thing = begin(list(labels), _triples(edges), random.Random(f"{seed}/{g}"), i)
                old, labels_held, held, found = set(old), set(labels), [], []
                for k, p, parents in shared.value:
                    if parents <= old and (not op.apriori or set(p[0]) <= labels_held):
                        f = op.test(thing, p, random.Random(f"{seed}/{g}/{k}"), i, least)
                        if f:
                            held.append(k)
                            found.append(f)
                every_held.append(held)
                every_found.append(found)
            yield b.assign(held=every_held, found=every_found)

    return state.mapInPandas(run, STATE)


def mine(graphs: DataFrame, threshold: int, max_size: int, name: str = "subtree", i: float = 1, least: int = 1, seed: int = 0, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, postings): patterns (pattern_id, size, cstring, support) of up to max_size vertices with support of at
    least `threshold`, and (pattern_id, graph_id, found). Support is the sum of what the embedding operator finds; `i` is
    its importance or number of samples, `least` the least count that 'hops_estimate' takes as one. `roots`: the labels that rooted patterns may
    have at their root (all)."""
    op, spark = operator(name), graphs.sparkSession
    if op.prepare:
        graphs = spanning_forests(graphs, None if op.prepare == "all" else max(1, int(i)), seed)
    none = F.array().cast("array<int>")
    state = cut(graphs.select("graph_id", "activity", "n", "m", "vlabels", "edges", none.alias("held"), none.alias("found")))
    # small collections arrive coalesced; testing containment is worth all cores
    if state.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        state = state.repartition(spark.sparkContext.defaultParallelism)
    labels = [r["label"] for r in vertex_support(state).where(F.col("support") >= threshold).collect()]
    rows = edge_support(state).where(F.col("support") >= threshold).collect()
    rules = {(r["low"], r["edge_label"], r["high"]) for r in rows}
    rules |= {(b, e, a) for a, e, b in rules}
    if roots is not None and not op.rooted:
        raise ValueError("only rooted patterns keep their root")
    candidates, known, found, postings = sorted(x + " " for x in labels if roots is None or x in roots), {}, [], []
    for size in range(1, max_size + 1):
        if not candidates:
            break
        base = len(found)
        # parents are asked of a graph only where a hit for a tree is one for its subtrees
        numbered = [(base + k + 1, c, {known[p] for p in _parents(c, op.rooted)} if op.apriori and size > 1 and name != "hops_estimate" else ()) for k, c in enumerate(candidates)]
        state = cut(_pass(state, numbered, op, i, least, seed))
        posting = state.select(F.explode(F.arrays_zip("held", "found")).alias("x"), "graph_id").select(F.col("x.held").alias("pattern_id"), "graph_id", F.col("x.found").alias("found"))
        support = {r["pattern_id"]: r["support"] for r in posting.groupBy("pattern_id").agg(F.sum("found").alias("support")).where(F.col("support") >= threshold).collect()}
        known = {c: k for k, c, _ in numbered if k in support}
        found += [(k, size, c, support.get(k)) for k, c, _ in numbered]
        postings.append(posting)
        grown = set().union(*(_extensions(c, rules, op.rooted) for c in known)) if known else set()
        candidates = sorted(c for c in grown if not op.apriori or _parents(c, op.rooted) <= known.keys())
    patterns = spark.createDataFrame([f for f in found if f[3] is not None], "pattern_id int, size int, cstring string, support long")
    every = postings[0] if postings else spark.createDataFrame([], "pattern_id int, graph_id long, found int")
    for p in postings[1:]:
        every = every.unionByName(p)
    kept = patterns.select("pattern_id")
    return patterns, every.join(F.broadcast(kept) if len(found) <= BROADCAST else kept, "pattern_id", "left_semi")


def mine_by_root(graphs: DataFrame, threshold: int, max_size: int, name: str = "rootedTrees", i: float = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """As `mine` does it for rooted patterns, but in depth: all patterns under one root label before the next one's.

    Growing leaves the root as it is, so that root labels part the patterns: the driver holds one part's candidates
    at a time. pattern_id runs on from part to part."""
    graphs = cut(graphs.select("graph_id", "activity", "n", "m", "vlabels", "edges"))
    labels = sorted(r["label"] for r in vertex_support(graphs).where(F.col("support") >= threshold).collect())
    parts = [mine(graphs, threshold, max_size, name, i, 1, seed, [x]) for x in labels]
    if not parts:
        return mine(graphs, threshold, max_size, name, i, 1, seed, [])
    before, every, held = 0, None, None
    for patterns, postings in parts:
        shift = (F.col("pattern_id") + before).cast("int").alias("pattern_id")
        last = patterns.agg(F.max("pattern_id")).first()[0] or 0
        patterns, postings = patterns.select(shift, "size", "cstring", "support"), postings.select(shift, "graph_id", "found")
        every, held = (patterns, postings) if every is None else (every.unionByName(patterns), held.unionByName(postings))
        before += last
    return every, held


def frequent_subtrees(graphs: DataFrame, threshold: int, max_size: int) -> DataFrame:
    """(size, cstring, support) of all trees of up to max_size vertices that at least `threshold` graphs contain."""
    return mine(graphs, threshold, max_size, "subtree_iterative")[0].select("size", "cstring", "support")


def _held(graphs: DataFrame, patterns: list[str], name: str, i: float, seed: int) -> DataFrame:
    """(pattern, graph_id, found): numbers of the patterns that each graph holds."""
    op, none = operator(name), F.array().cast("array<int>")
    if op.prepare:
        graphs = spanning_forests(graphs, None if op.prepare == "all" else max(1, int(i)), seed)
    state = graphs.select("graph_id", "activity", "n", "m", "vlabels", "edges", none.alias("held"), none.alias("found"))
    hit = _pass(state, [(k, p, ()) for k, p in enumerate(patterns)], op, i, 1, seed).select("graph_id", F.explode(F.arrays_zip("held", "found")).alias("x"))
    return hit.select(F.col("x.held").alias("pattern"), "graph_id", F.col("x.found").alias("found"))


def support(graphs: DataFrame, patterns: list[str], name: str = "subtree", i: float = 1, seed: int = 0) -> DataFrame:
    """(cstring, graph_id, found) for each pattern that a graph holds by the named operator."""
    names = graphs.sparkSession.createDataFrame(list(enumerate(patterns)), "pattern int, cstring string")
    return _held(graphs, patterns, name, i, seed).join(F.broadcast(names), "pattern").select("cstring", "graph_id", "found")


def features(graphs: DataFrame, patterns: list[str], name: str = "subtree", i: float = 1, seed: int = 0) -> DataFrame:
    """(graph_id, activity, features): the sorted numbers of the patterns each graph contains."""
    held = _held(graphs, patterns, name, i, seed).groupBy("graph_id").agg(F.sort_array(F.collect_list("pattern")).alias("features"))
    return graphs.select("graph_id", "activity").join(held, "graph_id", "left").withColumn("features", F.coalesce("features", F.array().cast("array<int>")))


def sketch(features_: DataFrame, permutations: list[list[int]]) -> DataFrame:
    """(graph_id, sketch): for each permutation the place of the first pattern the graph holds, -1 for none."""
    slots = []
    for p in permutations:
        first = F.array_min(F.filter(F.transform(F.lit(p), lambda x, i: F.when(F.array_contains("features", x), i)), lambda x: x.isNotNull()))
        slots.append(F.coalesce(first, F.lit(-1)).cast("int"))
    return features_.select("graph_id", F.array(*slots).alias("sketch"))
