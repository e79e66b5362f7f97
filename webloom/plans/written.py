"""Cutting lineage by a written table in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from webloom.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """df as a parquet table in the checkpoint folder: compressed, read by column, and there when executors are lost. It goes with the JVM."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    path = f"{context.getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)
