"""Session helpers of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a temporary one in local mode, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    return root


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    root, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return df.checkpoint()


def scanned(df: DataFrame) -> bool:
    """Whether df is read straight from files, so that its rows stand in the same partitions and order whenever it is read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Scan" in plan and bool(df.inputFiles()) and not re.search("Exchange|Join|Aggregate|Arrow|Python|Pandas|Sample|Limit|Generate|Union|RDD", plan)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Texts are long: bound what a Python worker holds at once."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parallelism(df: DataFrame) -> int:
    """Partitions for a shuffle of data that grows with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def text_column(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
