"""Further text formats: single graphs, pattern blocks, sparse feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._session import numbered

#: The element symbols behind the numbers of the molecule collection, from 1.
ELEMENTS = "H C O CU N S P CL ZN B BR CO MN AS AL NI SE SI V SN I F LI SB FE PD HG BI NA CA TI ZR HO GE PT RU RH CR GA K AG AU TB IR TE MG PB W CS MO RE CD OS PR ND SM GD YB ER U TL NB AC"


def element(column: str) -> Column:
    """The symbol of a numbered element; ERR where there is none."""
    names = F.split(F.lit(ELEMENTS), " ")
    at = F.col(column).try_cast("int")
    return F.when(at > 0, F.coalesce(F.get(names, at - 1), F.lit("ERR"))).otherwise(F.lit("ERR"))


def read_simple(spark: SparkSession, path: str, directed: bool = False) -> DataFrame:
    """One graph for each file: 'n m', n lines 'id label', m lines 'src dst label', all counted from 0. Graphs are numbered by their file's rank."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = whole.select("file", F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")).alias("t"))
    rows = rows.withColumns({"n": rows.t[0][0].try_cast("int"), "m": rows.t[0][1].try_cast("int")}).where("n is not null and m is not null and size(t) = 1 + n + m")
    vertex = lambda x: F.struct(x[0].cast("int").alias("id"), x[1].alias("label"))

    def edge(x):
        a, b = x[0].cast("int"), x[1].cast("int")
        src, dst = (a, b) if directed else (F.least(a, b), F.greatest(a, b))
        return F.struct(src.alias("src"), dst.alias("dst"), x[2].alias("label"))

    v = F.transform(F.array_sort(F.transform(F.slice("t", F.lit(2), F.col("n")), vertex)), lambda x: x["label"])
    e = F.transform(F.slice("t", F.col("n") + 2, F.col("m")), edge)
    # ranks are made of the names alone; graphs stay where they were read
    ranks = numbered(rows.select("file"), "file", "rank").select("file", (F.col("rank") + 1).alias("graph_id"))
    return rows.join(ranks, "file").select("graph_id", F.lit(0).cast("long").alias("activity"), "n", "m", v.alias("vlabels"), e.alias("edges"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks '# id count' of pattern lines 'support<tab>id<tab>string' as (graph_id, pattern_id, support, cstring)."""
    text = spark.read.option("lineSep", "#").text(path).where(F.trim("value") != "")
    parts = text.select(F.split("value", "\n").alias("l"))
    head = F.split(F.trim(F.get("l", F.lit(0))), r"\s+")
    rows = parts.select(F.get(head, F.lit(0)).try_cast("long").alias("graph_id"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line")).where("graph_id is not null")
    p = F.split("line", "\t")
    return rows.where(F.col("line").endswith(" ") & (F.size(p) == 3)).select("graph_id", p[1].try_cast("int").alias("pattern_id"), p[0].try_cast("long").alias("support"), p[2].alias("cstring"))


def pattern_lines(patterns: DataFrame, offset: int = 0) -> DataFrame:
    """(pattern_id, support, cstring) as 'support<tab>id<tab>string', with a constant added to the support."""
    return patterns.select(F.concat_ws("\t", (F.col("support") + offset).cast("string"), F.col("pattern_id").cast("string"), "cstring").alias("value"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'label f:v f:v ...', '#' beginning a comment, as (label double, features array<struct<index, value>>).

    Any line that isn't one raises when read."""
    text = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    t = F.split("line", r"\s+")
    pair = lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("index"), F.split(x, ":")[1].cast("double").alias("value"))
    good = F.col("line").rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?(\s+[0-9]+:[-+]?[0-9.]+([eE][-+]?[0-9]+)?)*$")
    label = F.when(good, t[0].cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a sparse feature line: "), "line")).cast("double"))
    return text.select(label.alias("label"), F.transform(F.slice(t, F.lit(2), F.size(t)), pair).alias("features"))


def sparse_text(rows: DataFrame) -> DataFrame:
    """The inverse: labels and values without a fraction are written as integers."""
    number = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    pairs = F.transform("features", lambda p: F.concat(p["index"].cast("string"), F.lit(":"), number(p["value"])))
    return rows.select(F.concat_ws(" ", number(F.col("label")), F.concat_ws(" ", pairs)).alias("value"))
