"""Graph databases that arrive as files: parsed, measured and filtered as a stream, one pass and no state; graphs of event sessions and counts over windows, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.measures import condition, value
from ..sources.graphs import parse_graphs


def stream_graphs(spark: SparkSession, folder: str, directed: bool = False, files_each: int = 100) -> DataFrame:
    """Graphs of the text databases that appear in a folder."""
    text = spark.readStream.option("lineSep", "\n#").option("maxFilesPerTrigger", files_each).text(folder)
    lines = F.split(F.regexp_replace("value", "^#", ""), "\n")
    return parse_graphs(text.select(lines.alias("lines")).where(F.size("lines") >= 3), directed)


def stream_filter(graphs: DataFrame, name: str, comparator: str = "pass", threshold: int = 0, argument: int = 1000, seed: int = 0) -> DataFrame:
    """The graphs whose measure compares so, with the measure as `value`; running numbers ('count') have no meaning here."""
    if name == "count":
        raise ValueError("a stream has no running numbers")
    return value(graphs, name, argument, seed).where(condition(F.col("value"), comparator, threshold))


def stream_support(graphs: DataFrame) -> DataFrame:
    """Running number of graphs that hold each vertex label."""
    return graphs.select(F.explode(F.array_distinct("vlabels")).alias("label")).groupBy("label").agg(F.count("*").alias("support"))


def session_graphs(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n, m, vlabels, edges): a session's event types, those that follow each other joined by an edge.

    A session ends where no event of the user comes for `gap`. In a stream its graph is given once the watermark, `late` behind
    the latest event, has passed its end; events later than that are dropped. A session's events meet in one row."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    session = events.where("user_id is not null and ts is not null and event_type is not null").withWatermark("ts", late)
    rows = session.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(steps.alias("steps")).withColumn("kinds", F.col("steps.event_type"))
    rows = rows.withColumn("vlabels", F.array_sort(F.array_distinct("kinds")))
    follow = F.size("kinds") - 1
    vid = lambda x: (F.array_position("vlabels", x) - 1).cast("int")
    pairs = F.zip_with(F.slice("kinds", 1, follow), F.slice("kinds", 2, follow), lambda a, b: F.struct(vid(F.least(a, b)).alias("src"), vid(F.greatest(a, b)).alias("dst"), F.lit("1").alias("label")))
    edges = F.array_sort(F.array_distinct(F.filter(pairs, lambda e: e["src"] != e["dst"])))
    return rows.select("user_id", F.col("w.start").alias("start"), F.size("vlabels").alias("n"), F.size(edges).alias("m"), "vlabels", edges.alias("edges"))


def windowed_support(events: DataFrame, width: str = "6 hours", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, events): counts over tumbling windows, or sliding ones, by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def write(df: DataFrame, path: str, checkpoint: str, wait: bool = False) -> StreamingQuery:
    """Append to Parquet with exactly-once bookkeeping in `checkpoint`, which must be a shared folder."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
