"""Connected components of a distributed list of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import cut, parallelism

LINK = "a long, b long"
#: so many links (16 MB) are less than what a task holds anyway, and are finished in one
FEW = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links and the least node it is connected to, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        apart = lo != hi
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root != root[root]).any():
            root = root[root]


def _stars(limit: int = 1 << 20):
    """Links of a partition in; stars around least nodes out, the same components with fewer hops."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, np.asarray(batch.column(0))]), np.concatenate([b, np.asarray(batch.column(1))])
            if len(a) > limit:
                nodes, root = _roots(a, b)
                a, b = root[nodes != root], nodes[nodes != root]
                if len(a) > limit // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            nodes, root = _roots(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(root[nodes != root]), pa.array(nodes[nodes != root])], ["a", "b"])

    return run


def _finished(batches):
    """All links in; every node and the least node it is connected to out."""
    sides = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if not sides:
        return
    nodes, root = _roots(*(np.concatenate(x) for x in zip(*sides)))
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["node", "root"])


def components(links: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the links (a, b), which are read several times: root is the least node reachable.
    Alternates star operations on the shuffled links with a contraction inside each partition, until all links are
    stars or no more than `few` are left, which one task finishes: a round deals them out a dozen times, and its files
    and tasks cost the same for a handful. More links are summed by node before a shuffle, never gathered; rounds are
    cut by checkpoints."""
    n = parallelism(links)
    finish = lambda x: x.select("a", "b").coalesce(1).mapInArrow(_finished, "node long, root long")
    links = links.where("a <> b")
    if links.count() <= few:
        return finish(links)
    now = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(_stars(), LINK))
    for _ in range(rounds):
        if now.count() <= few:
            return finish(now)
        # every node that hangs at several roots ties them together; a root that hangs itself passes its leaves up
        best = now.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("x"))
        hang = best.select(F.col("b").alias("p"), F.col("m").alias("up"))
        up = now.join(hang, now["a"] == hang["p"], "left").select("b", F.coalesce("up", "a").alias("a"), F.col("up").isNotNull().alias("moved"))
        least = up.groupBy("b").agg(F.min("a").alias("m"))
        new = up.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("l"), "moved").select("l.a", "l.b", "moved").where("a <> b")
        new = new.groupBy("a", "b").agg(F.max("moved").alias("moved"))
        new = cut(new)
        several = new.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
        chained = new.select(F.col("b").alias("p")).distinct().join(new.select("a").distinct(), F.col("p") == F.col("a"), "left_semi")
        if not several.take(1) and not chained.take(1):
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).union(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = cut(new.select("a", "b").repartition(n, "a").mapInArrow(_stars(), LINK))
    raise RuntimeError("components did not settle")
