"""Tables that cut lineage, in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder for a local master (tests); an error on a cluster, whose
    executors would each write to a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "rostra-shared")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder. Inside scratch() it goes when the scope ends; keep: when the scope around that ends, or
    with nothing around it, never."""
    path = f"{shared_folder(spark)}/rostra/{name}-{uuid.uuid4().hex}"
    scopes = _OPEN[:-1] if keep else _OPEN
    if scopes:
        scopes[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes at the end, but for what is kept. Nothing that outlives the scope may read the rest."""
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN.remove(mine)
        remove(spark, *mine)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and has a size that Spark knows."""
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
