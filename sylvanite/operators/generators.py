"""Seeded random graph collections, made where they are used: each row is drawn from its own seed."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graphs import GRAPH


def _collection(spark: SparkSession, count: int, seed: int, draw) -> DataFrame:
    """`count` graphs; draw(random numbers) -> (labels, [(src, dst, label)])."""

    def run(batches):
        for b in batches:
            rows = []
            for g in b["id"]:
                v, e = draw(random.Random(f"{seed}/{g}"))
                rows.append(_row(int(g), v, e))
            yield pd.DataFrame(rows, columns=["graph_id", "activity", "n", "m", "vlabels", "edges"])

    return spark.range(count).mapInPandas(run, GRAPH)


def _row(g: int, v: list[str], e) -> tuple:
    kept = sorted({(min(s, d), max(s, d)): x for s, d, x in e if s != d}.items())
    return g, 0, len(v), len(kept), v, [{"src": s, "dst": d, "label": x} for (s, d), x in kept]


def _labels(r, n: int, kinds: int) -> list[str]:
    return [str(r.randrange(max(1, kinds))) for _ in range(n)]


def random_graphs(spark: SparkSession, count: int, n: int, p: float, labels: int = 3, seed: int = 0, edge_labels: int = 0, max_n: int | None = None) -> DataFrame:
    """Graphs of n (to max_n, both included) vertices in which each edge stands with probability p; labels are uniform."""

    def draw(r):
        size = r.randint(n, max_n) if max_n else n
        v = _labels(r, size, labels)
        return v, [(i, j, str(r.randrange(edge_labels)) if edge_labels else "1") for i in range(size) for j in range(i + 1, size) if r.random() < p]

    return _collection(spark, count, seed, draw)


def random_trees(spark: SparkSession, count: int, n: int, labels: int = 3, seed: int = 0) -> DataFrame:
    """Recursive trees: each vertex hangs at a uniform earlier one."""
    return _collection(spark, count, seed, lambda r: ([str(r.randrange(labels)) for _ in range(n)], [(r.randrange(k), k, "1") for k in range(1, n)]))


def attached(r, n: int, edges_each: int, alpha: float = 0.0) -> list[tuple[int, int, str]]:
    """Growth from a clique of edges_each + 1: a new vertex picks partners by degree, or uniformly with probability alpha."""
    core = min(n, edges_each + 1)
    e = [(i, j, "1") for i in range(core) for j in range(i + 1, core)]
    ends = [v for s, d, _ in e for v in (s, d)] or [0]
    for v in range(core, n):
        chosen: set[int] = set()
        while len(chosen) < min(edges_each, v):
            chosen.add(r.randrange(v) if r.random() < alpha else r.choice(ends))
        for w in sorted(chosen):
            e.append((w, v, "1"))
            ends += [w, v]
    return e


def preferential(spark: SparkSession, count: int, n: int, edges_each: int = 1, alpha: float = 0.0, labels: int = 3, seed: int = 0) -> DataFrame:
    """Preferential attachment; alpha mixes in uniform attachment (0.95 in the usual variant)."""
    return _collection(spark, count, seed, lambda r: (_labels(r, n, labels), attached(r, n, edges_each, alpha)))


def near_pairs(points: list[tuple[float, float]], d: float) -> list[tuple[int, int, str]]:
    """Pairs nearer than d, by a grid of cells of side d."""
    if d <= 0:
        return []
    cells: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(points):
        cells.setdefault((int(x // d), int(y // d)), []).append(k)
    out = []
    for (a, b), members in cells.items():
        around = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((a + i, b + j), ())]
        out += [(k, o, "1") for k in members for o in around if k < o and math.dist(points[k], points[o]) < d]
    return out


def _points(r, n: int, clusters: int = 0, mu: float = 0.0) -> list[tuple[float, float]]:
    if not clusters:
        return [(r.random(), r.random()) for _ in range(n)]
    middle = [(r.random(), r.random()) for _ in range(clusters)]
    return [(r.gauss(x, mu), r.gauss(y, mu)) for x, y in (middle[r.randrange(clusters)] for _ in range(n))]


def geometric(spark: SparkSession, count: int, n: int, d: float, labels: int = 3, clusters: int = 0, mu: float = 0.1, seed: int = 0) -> DataFrame:
    """Points of the unit square (or normal clusters), joined where nearer than d."""
    return _collection(spark, count, seed, lambda r: (_labels(r, n, labels), near_pairs(_points(r, n, clusters, mu), d)))


def moving(spark: SparkSession, series: int, steps: int, n: int, d: float, sigma: float, labels: int = 3, clusters: int = 0, mu: float = 0.1, seed: int = 0) -> DataFrame:
    """Geometric graphs whose points move by normal steps, mirrored at 0: graph series * steps + t is step t of a series."""

    def run(batches):
        for b in batches:
            for g in b["id"]:
                r, rows = random.Random(f"{seed}/{g}"), []
                points, v = _points(r, n, clusters, mu), _labels(r, n, labels)
                for t in range(steps):
                    rows.append(_row(int(g) * steps + t, v, near_pairs(points, d)))
                    points = [(abs(r.gauss(x, sigma)), abs(r.gauss(y, sigma))) for x, y in points]
                yield pd.DataFrame(rows, columns=["graph_id", "activity", "n", "m", "vlabels", "edges"])

    return spark.range(series).mapInPandas(run, GRAPH)


def chains(spark: SparkSession, count: int, blocks: int, size: int, p: float, labels: int = 3, edge_labels: int = 1, seed: int = 0) -> DataFrame:
    """Rings of `size` vertices joined by bridges into a chain; each diagonal that crosses no earlier one stands with probability p."""

    def draw(r):
        e = []
        for k in range(blocks):
            at = k * size
            ring = [(at + i, at + (i + 1) % size) for i in range(size)] if size > 2 else [(at + i, at + i + 1) for i in range(size - 1)]
            inside: list[tuple[int, int]] = []
            for i in range(size):
                for j in range(i + 2, size):
                    if (i, j) != (0, size - 1) and r.random() < p and not any(a < i < b < j or i < a < j < b for a, b in inside):
                        inside.append((i, j))
            pairs = ring + [(at + i, at + j) for i, j in inside] + ([(at - 1, at)] if k else [])
            e += [(s, t, str(r.randrange(max(1, edge_labels)))) for s, t in pairs]
        return _labels(r, blocks * size, labels), e

    return _collection(spark, count, seed, draw)


def integer_noise(column: str, sigma: float, seed: int = 0) -> Column:
    """A whole number moved by a normal step, rounded towards zero."""
    return (F.col(column) + (F.randn(seed) * sigma).cast("long")).cast("long")


def joined_up(graphs: DataFrame, label: str = "1", seed: int = 0) -> DataFrame:
    """Every vertex without an edge gets one to a random other vertex."""

    def run(batches):
        for b in batches:
            rows = []
            for g, a, v, edges in zip(b["graph_id"], b["activity"], b["vlabels"], b["edges"]):
                r, e = random.Random(f"{seed}/{g}"), [(x["src"], x["dst"], x["label"]) for x in edges]
                busy = {x for p in e for x in p[:2]}
                for k in range(len(v)):
                    if k not in busy and len(v) > 1:
                        w = (k + 1 + r.randrange(len(v) - 1)) % len(v)
                        busy |= {k, w}
                        e.append((k, w, label))
                row = _row(int(g), list(v), e)
                rows.append((row[0], a, *row[2:]))
            yield pd.DataFrame(rows, columns=["graph_id", "activity", "n", "m", "vlabels", "edges"])

    return graphs.mapInPandas(run, GRAPH)


#: generators by name
GENERATORS = {"erdosRenyi": random_graphs, "barabasiAlbert": preferential, "barabasiAlbertAlpha": preferential, "overlap": geometric, "clusteredOverlap": geometric, "iterativeOverlap": moving, "iterativeClusteredOverlap": moving, "chains": chains}
