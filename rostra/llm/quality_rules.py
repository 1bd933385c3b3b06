"""Quality rules: a threshold table compiled into one projection (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import NOT_WS, WS

# Common function words of languages written in Latin letters: English, German, French, Spanish, Italian, Portuguese,
# Dutch, Swedish, Polish, Czech, Hungarian, Finnish, Turkish, Romanian.
STOP_WORDS = """the of and to a in that is was for it with as his on be at by this had not are but from or have an they which
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
de la le et les des en un une du que est pour qui dans par plus pas sur ne se ce il au avec
el los las y un una por con para su al lo como más o pero sus le ya este
di che non per della sono del più gli
os em não uma da do com
het een van dat niet zijn voor met
och att det som på är av
i na się nie jest że w z
je že by v jsou
az és hogy egy nem
ja on ei se että
ve bir bu için ile
și în cu mai""".split()
SYMBOLS = r"[#*$%&|<>]"

LATIN = "A-Za-zÀ-ɏ"

#: (measure, lowest allowed, highest allowed); None: no bound. Ratios are 0 where their denominator is 0; a null measure does
#: not apply and breaks no rule. The share of stop words does not apply where most letters are not Latin ones.
THRESHOLDS = (
    ("mean_word_length", 2.0, 14.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("duplicate_line_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.5),
)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all counts and ratios that rules may name.

    Repeated 3-word windows are found inside the row: windows become 64-bit hashes, and only texts whose distinct hashes are
    fewer than their windows sort (hash, place) pairs to see which neighbours are equal; n log n in the text's words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = base.select("doc_id", "text", F.filter(F.split("text", f"{WS}+"), lambda w: w != "").alias("words"), F.split("text", "\n").alias("lines"))
    i = F.sequence(F.lit(0), F.size("words") - 3)
    hashes = F.when(F.size("words") >= 3, F.transform(i, lambda k: F.xxhash64(F.get("words", k), F.get("words", k + 1), F.get("words", k + 2)))).otherwise(F.array().cast("array<bigint>"))
    full = F.filter("lines", lambda x: x.rlike(NOT_WS))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(full, lambda x: F.xxhash64(x)).alias("line_hashes"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"^{WS}*[-*•]"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"(\.\.\.|…){WS}*$"))).alias("n_ellipses"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        F.length(F.regexp_replace("text", f"[^{LATIN}]+", "")).alias("n_latin"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).alias("n_letters"),
        hashes.alias("windows"),
    )
    places = F.sequence(F.lit(0), F.size("windows") - 1)
    pairs = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.arrays_zip(F.col("windows").alias("h"), places.alias("k"))))
    paired = counted.withColumn("pairs", pairs)
    h = lambda k: F.get("pairs", k)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda k: F.coalesce(h(k) == h(k + 1), F.lit(False)) | F.coalesce(h(k) == h(k - 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda k: F.sequence(F.get("pairs", k)["k"], F.get("pairs", k)["k"] + 2)))))
    lines = F.size("line_hashes")
    return paired.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (lines - F.size(F.array_distinct("line_hashes"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("pairs").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        F.when(2 * F.col("n_latin") >= F.col("n_letters"), ratio(F.col("n_stop_words"), F.col("n_words"))).alias("stop_word_share"),
        ratio(lines - F.size(F.array_distinct("line_hashes")), lines).alias("duplicate_line_share"),
        ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_share"),
        ratio(F.col("n_ellipses"), F.col("n_lines")).alias("ellipsis_line_share"),
    )


def compiled(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that do not)."""
    failed = []
    for name, low, high in thresholds:
        bad = reduce(lambda a, b: a | b, [*([F.col(name) < low] if low is not None else []), *([F.col(name) > high] if high is not None else [])], F.lit(False))
        failed.append(F.when(bad, F.lit(name)))
    return ~F.coalesce(*failed, F.lit("")).isin([n for n, _, _ in thresholds]), F.concat_ws(",", *failed)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Counts, ratios and verdicts of every whole text.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed_rules and the ratios. base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept:
    not base_failed, and within all thresholds. Null texts count as empty, which fail. Rows stay apart even if repeated;
    other columns are not read. An empty table gives an empty result.
    """
    holds, names = compiled(thresholds)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = measured(docs, id_col, text_col)
    ratios = [c for c in m.columns[6:]]
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & holds).alias("kept"), names.alias("failed_rules"), *ratios)
