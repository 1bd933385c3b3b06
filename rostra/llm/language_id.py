"""Language identification by compression: the language whose raw-content dictionary makes a text smallest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_classifier import held_out

LEVEL, MIN_MATCH, MIN_MARGIN, UNKNOWN = 3, 3, 0.01, "und"
#: A dictionary is learned from at most MAX_DOCS whole documents of a language, those whose hashed doc_id is smallest, the last
#: of them the one that reaches MAX_CHARS characters in all.
MAX_DOCS, MAX_CHARS = 200, 200 * 2048
#: Bytes of size difference that halve a language's share of the score.
HALF = 8.0

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def words_only(text: str) -> bytes:
    """Lower case, everything but letters and their marks one space."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> dict[str, bytes]:
    """For each language seen in rows that are not held out, lower-cased text of some of them."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text rlike '\\\\p{L}'").filter(~held_out(F.col("k")))
    rows = rows.select("lang", "text", F.xxhash64("k").alias("o"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "text"))).filter(F.col("n") <= max_docs)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < max_chars)
    found: dict[str, list] = {}
    for r in best.select("lang", "n", "text").collect():
        found.setdefault(r["lang"], []).append((r["n"], r["text"]))
    # a dictionary's end is what a compressor reaches most cheaply
    return {k: b"".join(words_only(t) for _, t in sorted(v, reverse=True)) for k, v in sorted(found.items())}


def classify_batches(known: dict[str, bytes], level: int, min_margin: float):
    def run(batches):
        import zstandard

        langs, packers = list(known), []
        for raw in known.values():
            d = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, min_match=MIN_MATCH, write_content_size=0, write_dict_id=0)
            d.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
        for batch in batches:
            pred, score, rejected = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not langs or not _LETTER.search(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                low = words_only(text)
                sizes = np.array([len(p(low)) for p in packers], float)
                i = int(sizes.argmin())
                second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
                pred.append(langs[i])
                score.append(float(1 / np.exp2((sizes[i] - sizes) / HALF).sum()))
                rejected.append(bool((second - sizes[i]) < min_margin * sizes[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The language of every whole text.

    Returns one row per input row: doc_id, held_out, lang_pred, score (the best language's share, 0 to 1) and rejected (the
    margin over the second best is under min_margin, so lang_pred is a guess). lang_pred is `und` with score 0 for null
    texts, texts without a letter, and where no language could be learned; ties go to the first language by code point.
    Rows stay apart even if repeated. Other columns are not read. An empty table gives an empty result.
    """
    known = dictionaries(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(classify_batches(known, level, min_margin), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
