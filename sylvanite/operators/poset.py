"""Patterns ordered by containment: sketches and feature sets with few containment tests a graph.

The order (one vertex for each pattern, arcs to the patterns with one leaf more) and the evaluation plans are made on the
driver, as they depend on the patterns only, and are broadcast; graphs are one Arrow-batched pass without a shuffle.
Pattern numbers in results count from 0 in the order (vertices, given place)."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import embedding, kernels, structure
from .mining import _every_local, _parents, _triples


class Poset:
    def __init__(self, patterns: list[str]):
        size = lambda c: len(kernels.parse_string(c)[0])
        self.patterns = sorted(patterns, key=size)
        self.trees = [kernels.parse_string(c) for c in self.patterns]
        at = {c: k for k, c in enumerate(self.patterns)}
        self.below = [sorted(at[p] for p in _parents(c) if p in at) for c in self.patterns]
        self.above: list[list[int]] = [[] for _ in self.patterns]
        for k, down in enumerate(self.below):
            for p in down:
                self.above[p].append(k)
        self.ups, self.downs = self._closure(self.above), self._closure(self.below)

    @staticmethod
    def _closure(step) -> list[frozenset[int]]:
        out = []
        for k in range(len(step)):
            seen, stack = set(), list(step[k])
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += step[x]
            out.append(frozenset(seen))
        return out

    def shrunk(self, permutation: list[int]) -> list[int]:
        """The permutation without superpatterns of earlier entries, which can never come first."""
        out, dead = [], set()
        for k in permutation:
            if k not in dead:
                out.append(k)
            dead |= self.ups[k]
        return out

    def greedy_chain(self, open_: set[int], longest: bool = False, weight=None, limit: int | None = None) -> list[int]:
        """A chain of open patterns upwards: from the least one on by first successor, or the longest (heaviest) one."""
        if not longest:
            chain = [min(open_)]
            while nxt := [x for x in self.above[chain[-1]] if x in open_]:
                chain.append(nxt[0])
            return chain
        best, step = {}, {}
        for k in sorted(open_, reverse=True):
            tail = max((x for x in self.above[k] if x in open_), key=best.get, default=None)
            step[k], best[k] = tail, (weight[k] if weight else 1) + (best[tail] if tail is not None else 0)
        chain = [max(sorted(open_), key=best.get)]
        while step[chain[-1]] is not None:
            chain.append(step[chain[-1]])
        return chain

    def chain_cover(self) -> list[list[int]]:
        """The fewest chains that hold every pattern once, by matching in the transitive order."""
        nxt: dict[int, int] = {}
        owner: dict[int, int] = {}

        def place(k, tried):
            for x in sorted(self.ups[k]):
                if x not in tried:
                    tried.add(x)
                    if x not in owner or place(owner[x], tried):
                        owner[x], nxt[k] = k, x
                        return True
            return False

        for k in range(len(self.patterns)):
            place(k, set())
        out = []
        for k in range(len(self.patterns)):
            if k not in owner:
                chain = [k]
                while chain[-1] in nxt:
                    chain.append(nxt[chain[-1]])
                out.append(chain)
        return out

    def covers(self, chains: list[list[int]]) -> bool:
        """Whether the chains are chains of the order and hold every pattern once."""
        joined = all(b in self.ups[a] for chain in chains for a, b in zip(chain, chain[1:]))
        return joined and sorted(k for chain in chains for k in chain) == list(range(len(self.patterns)))

    def border(self, held: set[int]) -> int:
        """Held patterns all of whose direct superpatterns in the order are not held."""
        return sum(not any(x in held for x in self.above[k]) for k in held)


class Evaluation:
    """What is known of one graph: a hit settles all subpatterns, a miss all superpatterns."""

    def __init__(self, poset: Poset, test):
        self.poset, self.test, self.known, self.tests = poset, test, {}, 0

    def holds(self, k: int) -> bool:
        if k not in self.known:
            self.tests += 1
            hit = bool(self.test(k))
            for x in (k, *(self.poset.downs[k] if hit else self.poset.ups[k])):
                self.known.setdefault(x, hit)
        return self.known[k]

    def features(self) -> list[int]:
        return sorted(k for k, v in self.known.items() if v)

    def search(self, chain: list[int], weight=None) -> None:
        """Binary search for where hits end on a chain; with weights, cut where the chance is even."""
        low, high = 0, len(chain)
        while low < high:
            mid = (low + high) // 2
            if weight:
                mid = min(range(low, high), key=lambda j: (abs(weight[chain[j]] - 0.5), j))
            if self.holds(chain[mid]):
                low = mid + 1
            else:
                high = mid

    def run(self, strategy: str, cover=None, weight=None) -> None:
        n = len(self.poset.patterns)
        if strategy == "full":
            for k in range(n):
                self.tests += 1
                self.known[k] = bool(self.test(k))
        elif strategy == "bfs":
            for k in range(n):
                self.holds(k)
        elif strategy == "dfs":
            for k in reversed(range(n)):
                self.holds(k)
        elif strategy == "cover":
            for chain in cover:
                self.search(chain)
        else:
            while open_ := set(range(n)) - self.known.keys():
                self.search(self.poset.greedy_chain(open_, strategy != "path", weight if strategy == "weighted" else None), weight if strategy == "weighted" else None)


#: feature methods: name -> (strategy, containment)
FEATURES = {
    "treePatterns": ("full", "tree"), "treePatternsFast": ("bfs", "tree"), "treePatternsFastAbs": ("bfs", "abs"), "treePatternsFastRel": ("bfs", "rel"),
    "treePatternsResampling": ("full", "resampled"), "hopsPatterns": ("full", "hops"), "localEasyPatternsFast": ("bfs", "local"), "localEasyPatternsResampling": ("full", "local_resampled"),
    "dfsForTrees": ("dfs", "tree"), "latticePathForTrees": ("path", "tree"), "latticeLongestPathForTrees": ("longest", "tree"), "weightedLongestPathForTrees": ("weighted", "tree"), "dilworthsCoverForTrees": ("cover", "tree"),
    "dfsForLocalEasy": ("dfs", "local"), "latticePathForLocalEasy": ("path", "local"), "latticeLongestPathForLocalEasy": ("longest", "local"), "weightedLongestPathForLocalEasy": ("weighted", "local"), "dilworthsCoverForLocalEasy": ("cover", "local"),
}
SKETCHES = {"minHash": "tree", "minHashAbs": "abs", "minHashRel": "rel", "dotApproxForTrees": "tree", "dotApproxLocalEasy": "local", "dotApproxForLocalEasy": "local", "randomProjectionForTrees": "tree", "randomProjectionForLocalEasy": "local"}


def _tester(poset: Poset, how: str, labels, edges, i, rng):
    """A containment test by pattern number. i: importance, trials, or sampled trees (0: exact)."""
    trees = poset.trees
    if how == "hops":
        return lambda k: any(embedding.hops(labels, edges, *trees[k], rng) for _ in range(max(1, int(i))))
    if how in ("abs", "rel"):
        def count(k):
            held, parts = embedding.important(labels, edges, *trees[k])
            return held >= i if how == "abs" else parts > 0 and held / parts >= i

        return count
    if how == "local":
        local = embedding.LocalTrees(labels, edges, int(i), rng) if int(i) > 0 else _every_local(labels, edges, rng, i)
        return lambda k: local.holds(*trees[k])
    if how == "local_resampled":
        return lambda k: embedding.LocalTrees(labels, edges, max(1, int(i)), rng).holds(*trees[k])
    if how == "resampled":
        def drawn(k):
            link = structure.links(edges)
            pairs = [e[:2] for e in edges]
            return any(embedding.subtree_in_forest(labels, [(*p, link[p]) for p in kernels.wilson(len(labels), pairs, rng)], *trees[k]) for _ in range(max(1, int(i))))

        return drawn
    return lambda k: embedding.subtree(labels, edges, *trees[k])


def embed(graphs: DataFrame, patterns: list[str], method: str, i: float = 0, seed: int = 0, weights: list[float] | None = None) -> DataFrame:
    """(graph_id, activity, features, tests): the patterns each graph holds by a method of FEATURES, and the tests that took.

    `weights`: supports divided by the number of graphs, in the order of `patterns`, for the weighted methods (else even)."""
    strategy, how = FEATURES[method]
    poset = Poset(patterns)
    by = dict(zip(patterns, weights or [0.5] * len(patterns)))
    plan = (poset, poset.chain_cover() if strategy == "cover" else None, [by[p] for p in poset.patterns])
    shared = graphs.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        order, cover, weight = shared.value
        for b in batches:
            rows = []
            for g, a, labels, edges in zip(b["graph_id"], b["activity"], b["vlabels"], b["edges"]):
                e = Evaluation(order, _tester(order, how, list(labels), _triples(edges), i, random.Random(f"{seed}/{g}")))
                e.run(strategy, cover, weight)
                rows.append((g, a, e.features(), e.tests))
            yield pd.DataFrame(rows, columns=["graph_id", "activity", "features", "tests"])

    return graphs.select("graph_id", "activity", "vlabels", "edges").mapInPandas(run, "graph_id long, activity long, features array<int>, tests int")


def permutations(n: int, count: int, seed: int = 0) -> list[list[int]]:
    rng = random.Random(seed)
    return [rng.sample(range(n), n) for _ in range(count)]


def sketch(graphs: DataFrame, patterns: list[str], method: str, k: int, i: float = 0, seed: int = 0, orders: list[list[int]] | None = None) -> DataFrame:
    """(graph_id, sketch array<int>, tests). orders: the permutations to use in place of k random ones.

    minHash*: for each of k permutations without superpatterns of earlier entries, the place of the first pattern held
    (-1: none). dotApprox*: of k random patterns, 1, -1 or 0 (unknown) for every pattern. randomProjection*: 0 or 1 for
    each of the k."""
    how, poset = SKETCHES[method], Poset(patterns)
    if method.startswith("minHash"):
        plan = [poset.shrunk(p) for p in orders or permutations(len(patterns), k, seed)]
    else:
        plan = sorted(random.Random(seed).sample(range(len(patterns)), min(k, len(patterns))))
    shared = graphs.sparkSession.sparkContext.broadcast((poset, plan))

    def run(batches):
        order, todo = shared.value
        for b in batches:
            rows = []
            for g, labels, edges in zip(b["graph_id"], b["vlabels"], b["edges"]):
                e = Evaluation(order, _tester(order, how, list(labels), _triples(edges), i, random.Random(f"{seed}/{g}")))
                if method.startswith("minHash"):
                    # places in turn, so that a hit early in one permutation settles others
                    out, depth = [-1] * len(todo), 0
                    while any(out[s] < 0 and depth < len(p) for s, p in enumerate(todo)):
                        for s, p in enumerate(todo):
                            if out[s] < 0 and depth < len(p) and e.holds(p[depth]):
                                out[s] = depth
                        depth += 1
                else:
                    hits = [int(e.holds(x)) for x in todo]
                    out = hits if method.startswith("random") else [{True: 1, False: -1}.get(e.known.get(x), 0) for x in range(len(order.patterns))]
                rows.append((g, out, e.tests))
            yield pd.DataFrame(rows, columns=["graph_id", "sketch", "tests"])

    return graphs.select("graph_id", "vlabels", "edges").mapInPandas(run, "graph_id long, sketch array<int>, tests int")
