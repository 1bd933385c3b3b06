"""A training-data pipeline over `documents`: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from rostra.llm._shared import documents, fresh_path, remove, scratch, text_or_empty, written

#: Documents scored below this are rejected: label 0 is likelier than label 1.
MIN_SCORE = 0.5
#: The last table of documents with scores that near_duplicates left for the mix, by what it was made of.
_SCORED: dict[tuple, DataFrame] = {}


def contents(docs: DataFrame, sf_dir: str) -> tuple:
    """Tells tables apart by their rows, in any order, and the labels' folder."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a hash skips nulls and takes no maps
    values = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)]
    sums = [F.sum(F.xxhash64(F.lit(k), *values, *[c.isNull() for c in columns]).cast("decimal(20,0)")) for k in range(2)]
    return (sf_dir, *docs.columns, *docs.agg(F.count(F.lit(1)), *sums).first())


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """body, score: the documents and what a quality classifier learned from them makes of each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return written(quality_classifier.quality_scores(docs, labels).select("body", "score"), "scored", keep=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. All columns; rows stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_scores(docs, labels).filter(F.col("score") >= MIN_SCORE).select("body.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share; n_chars follows the text. No document goes."""
    kept = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Equal rows count once; rows with a
    null doc_id stay. They are scored here, as that takes Python, which the mix does without."""
    groups = ngram_join.ngram_join(docs)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    # documents and their mark side by side, so that a column of any name is no clash
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    marked = docs.join(first, "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns]).select(body, F.col("doc_id").alias("i"), F.xxhash64(text_or_empty()).alias("m"))
    path = fresh_path(spark, "single")
    marked.dropDuplicates(["i", "m"]).select("body.*").unionByName(docs.filter("doc_id is null")).write.parquet(path)
    table = scored(spark, spark.read.schema(docs.schema).parquet(path), sf_dir)
    remove(spark, path)
    left = table.select("body.*")
    _SCORED.clear()
    _SCORED[contents(left, sf_dir)] = table
    return left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; what the quality classifier makes of a document is its weight. The
    rows that near_duplicates left have their scores, others are scored here."""
    table = _SCORED.get(contents(docs, sf_dir))
    if table is None:
        table = scored(spark, docs, sf_dir)
    return mixing.mixed(table, "body.doc_id", "body.text", "body.source", quality=F.col("score")).select("body.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, placed in sequences."""
    return packing.packing(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]
#: Stages 1 and 5 cannot be expressed in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote on its way goes when its result is written, and the results of all but the last at the end."""
    docs = documents(spark, sf_dir)
    try:
        with scratch(spark):
            for _, stage in STAGES[:-1]:
                with scratch(spark):
                    docs = written(stage(spark, docs, sf_dir), "stage", keep=True)
            return written(STAGES[-1][1](spark, docs, sf_dir), "pipeline", keep=True)
    finally:
        _SCORED.clear()
