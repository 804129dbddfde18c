"""Results written to the folder that driver and executors share, and read back: lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, or where none is named (tests) in a local temporary folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = f"file://{tempfile.mkdtemp(prefix='loomtrace-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Written to a folder of its own and read back."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
