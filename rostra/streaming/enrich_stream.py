"""Incremental enrichment: each micro-batch of extracted records updates the directory of the batch before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from rostra.plans.pipeline import enrich


def enrich_stream(records: DataFrame, directory: str, run_date: str) -> DataStreamWriter:
    """records: a stream of records (ordinal, fields, markers). directory: folder that gets one Parquet version per batch,
    `batch=N`; batch N starts from the latest version below N, so a batch that runs again gives the same version."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        older = sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) < number)
        existing = spark.read.parquet(f"{directory}/batch={older[-1]}") if older else spark.createDataFrame([], batch.schema)
        done, _ = enrich(existing, batch, run_date)
        done.write.mode("overwrite").parquet(f"{directory}/batch={number}")

    return records.writeStream.foreachBatch(step)
