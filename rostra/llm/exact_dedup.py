"""Exact deduplication by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WS, written

#: A chunk ends after the first character, at or beyond MIN_CHUNK, that is equal to the third one before it, or at MAX_CHUNK. That
#: depends on nearby characters only and happens in every script.
CUT_AFTER = r"(.)..\1"
MIN_CHUNK, MAX_CHUNK = 256, 4096
#: Groups with at least one in HOT_SHARE of all rows are looked up by broadcast: there are HOT_SHARE of them at most.
HOT_SHARE = 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def chunks(text: Column) -> Column:
    """Cuts depend on nearby characters only, so an insertion moves few of them. The pieces joined give the text back."""
    pattern = rf"(?s).{{{MIN_CHUNK - 4},{MAX_CHUNK - 4}}}?{CUT_AFTER}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per input row: row_no, doc_id, text_sha256, ids (list of 64-bit chunk identifiers) and digests
    (the chunks' SHA-256, kept to verify the identifiers)."""
    norm = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).alias("doc_id"),
        normalised(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"),
    )
    cut = norm.select("row_no", "doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunk"))
    return cut.select(
        "row_no",
        "doc_id",
        "text_sha256",
        F.transform("chunk", chunk_id).alias("ids"),
        F.transform("chunk", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def chunk_store(recipe: DataFrame) -> DataFrame:
    """The distinct chunks: chunk_id, digest, uses. Partial sums leave each task, so a chunk found in a third of all documents is as
    cheap as any other."""
    each = recipe.select(F.explode(F.arrays_zip("ids", "digests")).alias("c")).select(F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest"))
    return each.groupBy("chunk_id", "digest").agg(F.count(F.lit(1)).alias("uses"))


def shared_ids(store: DataFrame) -> DataFrame:
    """chunk_id, digest, nth of chunks that share their identifier with others, but for the first of each (nth 0). Two chunks in
    2**64 do, so this is small at any size."""
    shared = store.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id")
    order = Window.partitionBy("chunk_id").orderBy("digest")
    return store.join(shared, "chunk_id", "left_semi").withColumn("nth", F.row_number().over(order) - 1).filter("nth > 0").select("chunk_id", "digest", "nth")


def verified(recipe: DataFrame) -> DataFrame:
    """recipe with list_key, a SHA-256 of the document's ordered list of verified identifiers: equal lists and equal texts are the
    same thing. An identifier is a chunk's 64-bit hash; where distinct chunks share one, places with other than the first
    of them are told apart by their number, in the few documents that have such chunks."""
    numbers = written(shared_ids(chunk_store(recipe)), "shared-ids")
    listed = F.array_join(F.transform("ids", lambda i: F.hex(i)), ",")
    if numbers.limit(1).count():
        places = recipe.select("row_no", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "c")).select("row_no", "at", F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest"))
        fixes = places.join(numbers, ["chunk_id", "digest"]).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("at", "nth"))).alias("fixes"))
        recipe = recipe.join(fixes, "row_no", "left")
        listed = F.concat(listed, F.coalesce(F.array_join(F.transform("fixes", lambda f: F.concat(F.lit(";"), f["at"].cast("string"), F.lit(":"), f["nth"].cast("string"))), ""), F.lit("")))
    return recipe.select("row_no", "doc_id", "text_sha256", F.size("ids").cast("long").alias("n_chunks"), F.unhex(F.sha2(listed, 256)).alias("list_key"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts are equal after each run of white space becomes one space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks. Chunks are deduplicated to
    verified identifiers, and documents with the same ordered list of them are one group; no text moves.
    Null texts count as empty; empty texts are one group. The row with the smallest doc_id stays; a null doc_id comes
    after all others; of repeated rows with one doc_id a single one stays. Other columns are not read. An empty table
    gives an empty result.
    """
    recipe = written(recipes(docs, id_col, text_col), "recipes")
    listed = written(verified(recipe), "lists").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    groups = listed.groupBy("list_key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1"), "copies")
    total = listed.count()
    hot = F.broadcast(groups.filter(F.col("group_size") * HOT_SHARE >= total))  # HOT_SHARE rows of fixed size at most
    rest = groups.filter(F.col("group_size") * HOT_SHARE < total)
    by_hot = listed.join(hot, "list_key", "left")
    cold = by_hot.filter(F.col("first").isNull()).drop("first", "group_size").join(rest, "list_key", "left")
    found = by_hot.filter(F.col("first").isNotNull()).unionByName(cold)
    first = F.coalesce("first", "place")
    return found.select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (first["row_no"] == F.col("row_no")).alias("kept"),
        "text_sha256",
        "n_chunks",
    )
