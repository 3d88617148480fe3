"""Reading and writing collections of labelled graphs.

A graph is a row: graph_id, activity, n, m, vlabels array<string>, edges array<struct<src, dst, label>> with
0-based vertices; undirected edges stand once, with src < dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "graph_id long, activity long, n int, m int, vlabels array<string>, edges array<struct<src:int,dst:int,label:string>>"


def assemble(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (graph_id, vid, label) and (graph_id, src, dst, label) as one row per graph; activity 0. Graphs without vertices don't appear."""
    v = vertices.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("vid", "label"))).alias("v"))
    e = edges.select("graph_id", F.struct(F.least("src", "dst").cast("int").alias("src"), F.greatest("src", "dst").cast("int").alias("dst"), "label").alias("e"))
    e = e.groupBy("graph_id").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    both = v.join(e, "graph_id", "left")
    empty = F.array().cast("array<struct<src:int,dst:int,label:string>>")
    out = both.select("graph_id", F.lit(0).cast("long").alias("activity"), F.transform("v", lambda x: x["label"]).alias("vlabels"), F.coalesce("edges", empty).alias("edges"))
    return out.withColumns({"n": F.size("vlabels"), "m": F.size("edges")}).select("graph_id", "activity", "n", "m", "vlabels", "edges")


def explode_vertices(graphs: DataFrame) -> DataFrame:
    return graphs.select("graph_id", F.posexplode("vlabels").alias("vid", "label"))


def explode_edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("graph_id", F.inline("edges"))


def arcs(graphs: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return explode_edges(graphs).select("graph_id", both.alias("a"), "label").select("graph_id", "a.src", "a.dst", "label")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """A text database as rows of one record each: Hadoop splits at the '#' that begins a header."""
    text = spark.read.option("lineSep", "\n#").text(path)
    lines = F.split(F.regexp_replace("value", r"^#", ""), "\n")
    return text.select(lines.alias("lines")).where(F.size("lines") >= 3)


def parse_graphs(records: DataFrame, directed: bool = False) -> DataFrame:
    """Rows with the three lines of a record each. Malformed records are left out; a lone end mark ends nothing."""
    line = lambda k: F.filter(F.split(F.trim(F.get("lines", F.lit(k))), r"\s+"), lambda t: t != "")
    rows = records.select(line(0).alias("h"), line(1).alias("vlabels"), line(2).alias("t"))
    number = lambda k: F.get("h", F.lit(k)).try_cast("long")
    rows = rows.select(number(0).alias("graph_id"), number(1).alias("activity"), number(2).cast("int").alias("n"), number(3).cast("int").alias("m"), "vlabels", "t")
    rows = rows.where("graph_id is not null and activity is not null and n >= 0 and m >= 0 and size(vlabels) = n and size(filter(t, x -> x <> '$')) = 3 * m")
    end = lambda k: F.get("t", k).try_cast("int") - 1

    def edge(i: Column) -> Column:
        a, b = end(3 * i), end(3 * i + 1)
        src, dst = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
        return F.struct(src.alias("src"), dst.alias("dst"), F.get("t", 3 * i + 2).alias("label"))

    edges = F.when(F.col("m") > 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), edge)).otherwise(F.array().cast("array<struct<src:int,dst:int,label:string>>"))
    rows = rows.select("graph_id", "activity", "n", "m", "vlabels", edges.alias("edges"))
    return rows.where(F.forall("edges", lambda e: (e["src"] >= 0) & (e["dst"] < F.col("n")) & (e["src"] < F.col("n")) & (e["dst"] >= 0)))


def read_graphs(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """A text database: '# id target n m', n labels, m times 'src dst label' (1-based), and '$' at the end."""
    return parse_graphs(_records(spark, path), directed)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'support<tab>id<tab>canonical string' with a space at the end; others are left out."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").endswith(" ") & (F.size(part) == 3))
    return rows.select(part[1].try_cast("int").alias("pattern_id"), part[0].try_cast("long").alias("support"), part[2].alias("cstring")).where("pattern_id is not null and support is not null")


def text_column() -> Column:
    """The three lines of a graph as one string."""
    edge = F.transform("edges", lambda e: F.concat_ws(" ", e["src"] + 1, e["dst"] + 1, e["label"]))
    head = F.concat_ws(" ", F.lit("#"), "graph_id", "activity", "n", "m")
    return F.concat_ws("\n", head, F.concat_ws(" ", "vlabels"), F.concat_ws(" ", edge))


def graph_text(graphs: DataFrame) -> DataFrame:
    """The three lines of each graph as one string `value`."""
    return graphs.select("graph_id", text_column().alias("value"))


def from_text(texts: DataFrame, directed: bool = False) -> DataFrame:
    """The inverse of graph_text(): graphs of the texts in column `value`, one each."""
    return parse_graphs(texts.select(F.split(F.regexp_replace("value", "^#", ""), "\n").alias("lines")), directed)


def write_graphs(graphs: DataFrame, path: str) -> None:
    graph_text(graphs).select("value").write.text(path)


def gaston_lines(graphs: DataFrame) -> DataFrame:
    """'t # id', 'v i label' and 'e i j label' lines as one string for each graph."""
    v = F.transform("vlabels", lambda x, i: F.concat_ws(" ", F.lit("v"), i, x))
    e = F.transform("edges", lambda x: F.concat_ws(" ", F.lit("e"), x["src"], x["dst"], x["label"]))
    return graphs.select("graph_id", F.concat_ws("\n", F.concat(F.lit("t # "), F.col("graph_id")), v, e).alias("value"))


def dot(graphs: DataFrame, directed: bool = False) -> DataFrame:
    arrow = " -> " if directed else " -- "
    v = F.transform("vlabels", lambda x, i: F.concat(F.lit("  "), i, F.lit(' [label="'), x, F.lit('"];')))
    e = F.transform("edges", lambda x: F.concat(F.lit("  "), x["src"], F.lit(arrow), x["dst"], F.lit(' [label="'), x["label"], F.lit('"];')))
    kind = "digraph " if directed else "graph "
    return graphs.select("graph_id", F.concat_ws("\n", F.concat(F.lit(kind), F.col("graph_id"), F.lit(" {")), v, e, F.lit("}")).alias("value"))


def sparse_lines(features: DataFrame) -> DataFrame:
    """(graph_id, activity, features array<int>) as 'target f:1 f:1 ...'."""
    f = F.transform(F.sort_array("features"), lambda x: F.concat(x.cast("string"), F.lit(":1")))
    return features.select("graph_id", F.concat_ws(" ", F.col("activity").cast("string"), F.concat_ws(" ", f)).alias("value"))


def posting_lines(support: DataFrame) -> DataFrame:
    """(pattern_id, graph_id) as 'patternId: graphId graphId ...'."""
    ids = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("graph_id")), lambda x: x.cast("string")))
    return support.groupBy("pattern_id").agg(F.concat(F.col("pattern_id").cast("string"), F.lit(": "), ids).alias("value"))


def array_lines(rows: DataFrame, column: str, name: str | None = None, sparse: bool = False) -> DataFrame:
    """Arrays of whole numbers as lines of `value`, behind 'name ' where a column is named; sparse: sorted, as 'k:1'."""
    items = F.transform(F.sort_array(column) if sparse else F.col(column), lambda x: F.concat(x.cast("string"), F.lit(":1" if sparse else "")))
    line = F.concat_ws(" ", items)
    return rows.select((F.concat_ws(" ", F.col(name).cast("string"), line) if name else line).alias("value"))
