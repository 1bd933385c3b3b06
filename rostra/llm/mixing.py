"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import NOT_WS, WS, written

#: Characters that lower a document's quality weight.
SYMBOLS = r"[#*$%&|<>!]"
WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Slices of the keys for each doubling of a key, and of such a slice again.
SLICES = 1024
#: Weights given by the caller count as this at least; so do null ones.
LEAST = 1e-6


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; null gives 0."""
    one_each = F.regexp_replace(text, f"{NOT_WS}+", "x")
    return F.coalesce(F.length(F.regexp_replace(one_each, f"{WS}+", "")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for prose, falling to 0.05 as symbols take over a quarter of the text."""
    length = F.greatest(F.length(text), F.lit(1))
    symbols = length - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 4.0 * symbols / length), F.lit(0.05))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    hex_digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 13)
    return (F.conv(hex_digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: str, *more: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"),
        (-F.log(uniform(F.lit(seed), F.col(id_col))) / (quality_weight(text) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(LEAST)))).alias("key"),
        F.xxhash64(text).alias("tie"),
        *more,
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Sources by code point, null last, take the weights in turn and share all words; a target
    stops at max_epochs times its source, and the excess is shared out by weight again until none is above.

    That settles at min(cap, level * weight) with one level for all: sources sorted by cap over weight stop first.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", picked.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # the level if this source and all later ones are below their caps
    free = levels.withColumn("rest", F.col("total") - F.col("cap_before")).withColumn("rest_weight", F.col("all_weight") - F.col("weight_before"))
    open_ = F.col("cap") * F.col("rest_weight") >= F.col("weight") * F.col("rest")
    # of sources with equal cap over weight the window's first: the others have it among the capped
    first_open = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull().alias("none"), "source", "rest", "rest_weight"))).over(everything)
    level = free.select("source", "source_size", "weight", "cap", first_open.alias("level"))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level.rest") / F.col("level.rest_weight"))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def slice_of(key: str = "key") -> tuple[Column, Column]:
    """(slice, part of it) of a key, both in the order of the keys. Slices are even in the key's logarithm, where keys of weight w
    have the same density as keys of weight 1, only moved: whatever the weights, a slice holds at most about one in 4000
    of a source's documents, and a part at most about one in 4 million."""
    place = F.log2(F.col(key)) * SLICES
    return F.floor(place).cast("int"), F.floor((place - F.floor(place)) * SLICES).cast("int")


def ending(sums: DataFrame, due: DataFrame, at: str) -> DataFrame:
    """s, `at`, before, rest: where each source's budget ends. sums: source, `at`, words; due: s, rest, and the words before
    all of sums."""
    running = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = sums.join(due, F.col("s").eqNullSafe(F.col("source"))).withColumn("upto", F.col("before") + F.sum("words").over(running))
    ends = joined.filter((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    return ends.select("s", at, (F.col("upto") - F.col("words")).alias("before"), "rest")


def plan(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, and where the fractional epoch ends (the last document's key, doc_id
    and tie, and the words that it gives).

    Sums by source and slice leave each task, a running sum over them finds the slice in which a source's budget ends; the same
    by parts of that slice finds the part, and only that part's rows are sorted.
    """
    coarse, fine = slice_of()
    stats = stats.withColumn("coarse", coarse).withColumn("fine", fine)
    by_slice = written(stats.groupBy("source", "coarse").agg(F.sum("size").alias("words")), "slices")
    sizes = by_slice.groupBy("source").agg(F.sum("words").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = source_targets(sizes, weights, max_epochs).withColumn("epochs", epochs)
    budgets = budgets.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long"))
    budgets = written(budgets, "budgets")
    of_source = F.col("s").eqNullSafe(F.col("source"))
    first = ending(by_slice, budgets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("before"), "rest"), "coarse")
    inside = stats.join(first.withColumnRenamed("coarse", "c"), of_source & (F.col("c") == F.col("coarse"))).drop("c", "coarse")
    inside = written(inside, "slice")
    parts = inside.groupBy("source", "fine").agg(F.sum("size").alias("words"))
    second = written(ending(parts, first.drop("coarse"), "fine"), "ends")
    last = inside.drop("s", "before", "rest").join(second.withColumnRenamed("fine", "f"), of_source & (F.col("f") == F.col("fine")))
    order = Window.partitionBy("s").orderBy("key", F.col("doc_id").isNull(), "doc_id", "tie")
    peers = Window.partitionBy("s", "key", "doc_id", "tie")
    cut = last.filter("size > 0").select("s", "key", "doc_id", "tie", "rest", "size", F.count(F.lit(1)).over(peers).alias("peers"), (F.col("before") + F.sum("size").over(order)).alias("upto"))
    first_word = F.col("upto") - F.col("size") * F.col("peers")
    cut = cut.filter((first_word < F.col("rest")) & (F.col("rest") <= F.col("upto"))).groupBy("s", "key", "doc_id", "tie").agg(F.max(F.floor((F.col("rest") - first_word) / F.col("peers"))).cast("long").alias("part"))
    cut = cut.select("s", F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tie").alias("last"), "part")
    return budgets.join(cut, of_source, "left").select("source", "source_size", "target", "epochs", "last", "part")


def taken(stats: DataFrame, sources: DataFrame) -> DataFrame:
    """stats with source_size, target, epochs, part (words of the fractional epoch) and taken."""
    p = sources.withColumnRenamed("source", "s")
    here = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    part = F.when(F.col("last").isNull(), 0).when(here < F.col("last"), F.col("size")).when(here == F.col("last"), F.col("part")).otherwise(0).cast("long")
    joined = stats.join(p, F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: doc_id, size, source_size, target, taken, epochs, source. Each document is taken whole
    `epochs` times; then documents in the order of -ln(u) / quality fill what is left of the source's target, the last of
    them with the words still due. u depends on doc_id and seed, so reruns agree. Null texts and empty texts have size 0
    and are taken 0 words; null sources are one source, last in order; a source without words has target 0. Repeated rows
    draw one key and share what is due alike. Other columns are not read. An empty table gives an empty result.
    """
    stats = written(sized(docs, id_col, text_col, source_col, quality, seed), "sizes")
    sources = written(plan(stats, weights, max_epochs), "mix")
    return taken(stats, sources).select("doc_id", "size", "source_size", "target", "taken", "epochs", "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it. Documents stay whole: the one at which a budget
    ends goes in if at least half of it is due. Rows without words are not taken. The columns are those of docs."""
    stats = written(sized(docs, id_col, text_col, source_col, quality, seed), "sizes")
    sources = written(plan(stats, weights, max_epochs), "mix")
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body")
    rows = sized(docs, id_col, text_col, source_col, quality, seed, body)
    counted = taken(rows, sources).withColumn("times", (F.col("epochs") + (F.col("part") * 2 >= F.col("size")).cast("long")).cast("int"))
    return counted.filter("size > 0 and times > 0").select("body", F.explode(F.sequence(F.lit(1), "times")).alias("n")).select("body.*")
