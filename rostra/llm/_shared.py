"""Helpers of the operators: white space, the input table, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.plans.scratch import fresh_path, remove, scratch, shared_folder, written

__all__ = ["NOT_WS", "WS", "documents", "fresh_path", "remove", "scratch", "shared_folder", "text_or_empty", "written"]

#: Python regex and Java regex alike: the six ASCII white-space characters of the contracts.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
