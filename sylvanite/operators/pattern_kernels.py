"""Pattern kernels: strings of each graph with their counts, numbered over the whole collection by joins."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structure
from ._session import cut, numbered


def _triples(edges):
    return [(e["src"], e["dst"], e["label"]) for e in edges]


def _strings(graphs: DataFrame, make) -> DataFrame:
    """(graph_id, activity, cstring, occurrences); make(labels, edges) -> {string: count}."""

    def run(batches):
        for b in batches:
            rows = []
            for g, a, v, e in zip(b["graph_id"], b["activity"], b["vlabels"], b["edges"]):
                rows += [(g, a, c, k) for c, k in sorted(make(list(v), _triples(e)).items())]
            yield pd.DataFrame(rows, columns=["graph_id", "activity", "cstring", "occurrences"])

    return graphs.select("graph_id", "activity", "vlabels", "edges").mapInPandas(run, "graph_id long, activity long, cstring string, occurrences long")


def cyclic_patterns(graphs: DataFrame, which: str = "all") -> DataFrame:
    """Trees of the bridge forest and simple cycles; which: all, cycles or trees."""
    return _strings(graphs, lambda v, e: structure.kernel_features(v, e, which))


def outerplanar_patterns(graphs: DataFrame, depth: int = 2, free: bool = False) -> DataFrame:
    """Depth-bounded trees around every vertex of the block-and-bridge tree; graphs that aren't outerplanar have none."""

    def make(v, e):
        out: dict[str, int] = {}
        tree = structure.block_tree(v, e)
        # a block's string becomes one token, as it holds spaces
        labels = [x.replace(" ", "_") for x in tree[0]] if tree else []
        for part, pe, _ in structure.split_components(labels, tree[1]) if tree else ():
            for c in structure.bfs_trees(part, pe, depth, free):
                out[c] = out.get(c, 0) + 1
        return out

    return _strings(graphs, make)


def counts(graphs: DataFrame) -> DataFrame:
    """(graph_id, cycles, trees, n, m): patterns with repeats, and sizes."""
    def make(v, e):
        return {"cycles": len(structure.cycle_strings(v, e)), "trees": len(structure.forest_strings(*structure.bridge_forest(v, e)))}

    sums = [F.sum(F.when(F.col("cstring") == x, F.col("occurrences")).otherwise(0)).alias(x) for x in ("cycles", "trees")]
    return _strings(graphs, make).groupBy("graph_id").agg(*sums).join(graphs.select("graph_id", "n", "m"), "graph_id")


def feature_rows(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary, rows): (cstring, feature) with numbers from 1 in the order of the strings, and (graph_id, activity,
    features array<struct<feature, occurrences>>) sorted by number. The dictionary grows with the data and is joined, not broadcast."""
    strings = cut(strings)
    known = numbered(strings.select("cstring").distinct(), "cstring", "feature").withColumn("feature", F.col("feature") + 1)
    known = cut(known)
    pairs = F.sort_array(F.collect_list(F.struct("feature", "occurrences"))).alias("features")
    return known, strings.join(known, "cstring").groupBy("graph_id", "activity").agg(pairs)


def count_lines(rows: DataFrame) -> DataFrame:
    """'target id:count ...' for each graph."""
    text = F.transform("features", lambda x: F.concat_ws(":", x["feature"].cast("string"), x["occurrences"].cast("string")))
    return rows.select("graph_id", F.concat_ws(" ", F.col("activity").cast("string"), F.concat_ws(" ", text)).alias("value"))


def triples(graphs: DataFrame, wedges: bool = True) -> DataFrame:
    """(graph_id, activity, features array<int>): hashes of vertex triples with two edges or more (wedges) or of all."""

    @F.pandas_udf("array<int>")
    def prints(v: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([structure.triple_prints(list(a), _triples(b), wedges) for a, b in zip(v, e)], dtype=object)

    return graphs.select("graph_id", "activity", prints("vlabels", "edges").alias("features"))


def reports(graphs: DataFrame, every: bool = False) -> DataFrame:
    """(graph_id, value): JSON of outerplanarity, Hamiltonian cycles and block-and-bridge trees; `every` lists the cycles of other blocks too."""

    @F.pandas_udf("string")
    def one(ids: pd.Series, v: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"graph": int(g), **structure.report(list(a), _triples(b), every)}) for g, a, b in zip(ids, v, e)], dtype=object)

    return graphs.select("graph_id", one("graph_id", "vlabels", "edges").alias("value"))


def fingerprint(numbers: str) -> Column:
    """32 bits over a set of numbers, to prune subset tests: the bits number mod 32 of an array column, as a long."""
    bits = F.transform(numbers, lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(32)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def maybe_subset(a: Column, b: Column) -> Column:
    """Whether the set behind fingerprint a can lie in that behind b; never false for a real subset."""
    return a.bitwiseAND(b) == a
