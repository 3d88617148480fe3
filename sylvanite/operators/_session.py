"""Cutting lineage and numbering rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder. Where none is named, a temporary one in local mode, as in tests; a cluster must name one."""
    sc = df.sparkSession.sparkContext
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if root is None and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with dense numbers from 0 in the given order: a range partition, places in it, and offsets of the partitions.

    Only one count for each partition is broadcast; no window runs over all rows in one task."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order)
    placed = cut(placed.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes, total, offsets = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect(), 0, []
    for r in sizes:
        offsets.append((r["_part"], total))
        total += r["count"]
    known = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return placed.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn(name, F.col("_offset") + place).drop("_part", "_offset", "_id")
