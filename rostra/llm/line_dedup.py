"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh_path, remove, text_or_empty, written

MIN_LENGTH, MIN_DOCS, BATCHES, FANOUT, HOT_SHARE = 40, 5, 4, 2, 10_000
#: Lines for each bucket of a run, and buckets that Spark allows.
BUCKET_ROWS, MAX_BUCKETS = 2_000_000, 100_000
STRIP = b" \t\n\x0b\x0c\r"
LINE_SCHEMA = "row_no long, doc_id long, h1 long, h2 long, places array<int>"


def hash_lines(min_length: int):
    """Arrow batches (row_no, doc_id, text) to one row per row and line key: its 128-bit hash and places in the text."""

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("row_no", "doc_id", "places")}
            digests = bytearray()
            for row_no, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text is None or len(text) < min_length:
                    continue
                found: dict[bytes, list[int]] = {}
                for place, line in enumerate(text.encode().split(b"\n")):
                    if len(line) >= min_length:
                        key = line.strip(STRIP).lower()
                        if len(key) >= min_length and (key.isascii() or len(key.decode()) >= min_length):
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
                for digest, places in found.items():
                    digests += digest
                    cols["places"].append(places)
                cols["row_no"] += [row_no] * len(found)
                cols["doc_id"] += [doc_id] * len(found)
            h = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cols["row_no"], pa.int64()), pa.array(cols["doc_id"], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(cols["places"], pa.list_(pa.int32()))], names=["row_no", "doc_id", "h1", "h2", "places"])

    return run


@contextmanager
def stored_order(spark: SparkSession):
    """Bucketed tables are read in the order in which they are stored, for the plans made inside."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class LineRuns:
    """A log-structured store of line hashes: sorted runs on levels, each run a table bucketed and sorted by hash.

    A run has one row per hash, with its owner: top, the largest doc_id that held the line when it came. add() merge-anti-joins
    a batch with the runs, one after the other and in their stored order, writes what is left as one run of level 0, and
    merges a level of `fanout` runs into one run of the next. So a hash is in one run, and the batch that brought it first
    decides its owner. Runs are immutable, so a lost executor costs a task only. close() drops all runs.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout, self.levels = spark, buckets, fanout, []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _table(self, rows: DataFrame) -> str:
        name = f"rostra_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, "run")
        with stored_order(self.spark):
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(*list(self.paths))
        self.levels = []

    @staticmethod
    def _both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs without a common hash as one, by a merge of what is sorted already."""
        return a.hint("merge").join(b.withColumnRenamed("top", "other"), ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("top", "other").alias("top"))

    def compact(self, level: int) -> None:
        """All runs of a level become one of the next."""
        old, self.levels[level] = self.levels[level], []
        with stored_order(self.spark):
            merged = self._table(reduce(self._both, [self.spark.table(n) for n in old]))
        self._drop(*old)
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged)

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, h1, h2. Batches come in falling order of doc_id, so the first one that brings a hash has its largest
        doc_id."""
        own = lines.groupBy("h1", "h2").agg(F.max("doc_id").alias("top")).repartition(self.buckets, "h1", "h2")
        name = self._table(own)
        runs = self.runs()
        if runs:
            with stored_order(self.spark):
                fresh = reduce(lambda left, run: left.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), runs, self.spark.table(name))
                batch, name = name, self._table(fresh)
            self._drop(batch)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def owners(self) -> DataFrame:
        """h1, h2, top of all hashes."""
        return reduce(DataFrame.unionByName, self.runs())


def batches(lines: DataFrame, n: int) -> list[DataFrame]:
    """Splits by doc_id at its quantiles, largest first; null doc_ids come last. All rows are in one batch."""
    found = lines.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else None
    cuts = sorted(set(found or []), reverse=True)
    parts, upper = [], None
    for cut in cuts:
        inside = F.col("doc_id") >= cut
        parts.append(lines.filter(inside if upper is None else inside & (F.col("doc_id") < upper)))
        upper = cut
    rest = F.col("doc_id").isNull() if upper is None else F.col("doc_id").isNull() | (F.col("doc_id") < upper)
    return [*parts, lines.filter(rest) if upper is not None else lines]


def repeated_places(lines: DataFrame, n_batches: int = BATCHES, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> DataFrame:
    """row_no, id (doc_id, 0 for null) and gone: the places (line numbers) that go. Hashes held by at least one in HOT_SHARE of all (document, line) pairs, of
    which there are HOT_SHARE at most, are looked up by broadcast, so no task gets all documents that share a line."""
    total = lines.count()
    store = LineRuns(lines.sparkSession, min(MAX_BUCKETS, max(8, -(-total // BUCKET_ROWS))), fanout)
    for batch in batches(lines, n_batches):
        store.add(batch)
    held = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    frequent = written(held.join(store.owners(), ["h1", "h2"]), "frequent")
    store.close()
    hot = F.broadcast(frequent.filter(F.col("n") * HOT_SHARE >= total).withColumn("hot", F.lit(True)))
    tagged = lines.join(hot, ["h1", "h2"], "left")
    stays = F.coalesce(F.col("doc_id") == F.col("top"), F.col("top").isNull())
    gone_hot = tagged.filter(F.col("hot") & ~stays)
    cold = frequent.filter(F.col("n") * HOT_SHARE < total)
    gone_cold = tagged.filter(F.col("hot").isNull()).drop("n", "top", "hot").join(cold, ["h1", "h2"]).filter(~stays)
    gone = gone_hot.select("row_no", "doc_id", "places").unionByName(gone_cold.select("row_no", "doc_id", "places"))
    return gone.groupBy("row_no", F.coalesce("doc_id", F.lit(0)).alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, n_batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drops lines that at least min_docs documents hold, except in the document with the largest doc_id.

    Lines are compared by key: stripped of white space, A-Z lower-cased, at least min_length code points; shorter lines
    stay. Returns all columns of docs with the text replaced, and n_lines, n_dropped and kept_sha256 (names that docs already
    has are taken over by these). Null and empty texts have one empty line and become empty texts. doc_ids are integers; rows
    are documents of their own even if a doc_id repeats, and all rows with the largest doc_id keep the line. A null doc_id
    is below all others; where only null doc_ids hold a line, it stays everywhere. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", "kept_sha256")]
    body = F.struct(*[F.col(f"`{c}`") for c in extra]).alias("body") if extra else F.struct(F.lit(1)).alias("body")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col)).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), body)
    lines = written(rows.select("row_no", "doc_id", "text").mapInArrow(hash_lines(min_length), LINE_SCHEMA), "lines")
    gone = repeated_places(lines, n_batches, min_docs, fanout)
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(0)))  # equal rows share id and row_no
    split = keyed.join(gone, ["row_no", "id"], "left").select("doc_id", "body", "text", "gone", F.split("text", "\n").alias("lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    placed = split.select("doc_id", "body", "text", "lines", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), keep).alias("keep"))
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.transform("keep", lambda k: F.get("lines", k)), "\n"))
    done = placed.select("body", "n_lines", F.when(F.col("keep").isNull(), 0).otherwise(F.col("n_lines") - F.size("keep")).cast("long").alias("n_dropped"), text.alias("new_text"))
    fields = [F.col("new_text").alias(c) if c == text_col else F.col(f"body.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_sha256")]
    return done.select(*fields, "n_lines", "n_dropped", F.sha2("new_text", 256).alias("kept_sha256"))
