"""run() against a plain version built from the stages' contracts."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rostra.llm import quality_classifier
from rostra.llm._shared import documents
from test_operators import WORD, plain_join, plain_lines, waterfill

DIR = "/root/testdata/sf0.001"


def plain_mix(table):
    """How often the mix takes each document of (doc_id, source, words, weight)."""
    sizes = Counter()
    for _, source, n, _ in table:
        sizes[source] += n
    times = Counter()
    for source, target in waterfill(dict(sizes)).items():
        mine = [r for r in table if r[1] == source]
        whole = math.floor(target / sizes[source]) if sizes[source] else 0
        left = math.floor(target - whole * sizes[source] + 0.5)
        u = lambda i: (int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for i, _, n, _ in sorted(mine, key=lambda r: -math.log(u(r[0])) / r[3]):
            part = min(left, n)
            left -= part
            times[i] += (whole + (2 * part >= n)) if n else 0
    return +times


def test_stages_agree_with_plain_versions(spark):
    docs = documents(spark, DIR)
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, DIR)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(docs, spark.read.parquet(f"{DIR}/labels.parquet")).select("body.doc_id", "score").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= corpus_pipeline.MIN_SCORE}

    cut = corpus_pipeline.lines(spark, kept, DIR)
    before, after = {r["doc_id"]: r["text"] for r in kept.collect()}, {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and after.keys() == before.keys()
    for r in plain_lines(list(before.items())):
        assert after[r["doc_id"]]["text"].count("\n") + 1 == max(1, r["n_lines"] - r["n_dropped"]) and after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])

    single = corpus_pipeline.near_duplicates(spark, cut, DIR)
    want = {r["doc_id"] for r in plain_join([(i, r["text"]) for i, r in after.items()]) if r["doc_id"] == r["component_id"]}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    mixed = corpus_pipeline.mix(spark, single, DIR)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(single, spark.read.parquet(f"{DIR}/labels.parquet")).select("body.doc_id", "score").collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and times == plain_mix([(r["doc_id"], r["source"], len(WORD.findall(r["text"] or "")), scores[r["doc_id"]]) for r in single.collect()])

    pieces = corpus_pipeline.pack(spark, mixed, DIR).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == times


def test_the_mix_runs_no_python_on_what_near_duplicates_left(spark, monkeypatch, tmp_path):
    docs = documents(spark, DIR).limit(80)
    corpus_pipeline.near_duplicates(spark, docs, DIR).write.parquet(f"{tmp_path}/single")
    single = spark.read.parquet(f"{tmp_path}/single")
    calls, learn = [], quality_classifier.quality_scores
    monkeypatch.setattr(quality_classifier, "quality_scores", lambda *a: calls.append(1) or learn(*a))
    mixed = corpus_pipeline.mix(spark, single, DIR)
    assert not calls and "Arrow" not in mixed._jdf.queryExecution().toString()
    got = Counter(r["doc_id"] for r in mixed.collect())
    fewer = single.filter(F.col("doc_id") != single.agg(F.min("doc_id")).first()[0])
    assert len(got) and corpus_pipeline.mix(spark, fewer, DIR).count() and len(calls) == 1  # other rows are scored anew
    corpus_pipeline._SCORED.clear()
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, single, DIR).collect()) == got and len(calls) == 2


def test_repeated_and_null_ids(spark):
    text = "some words that make one document of more than five words"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "")], "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()]
    assert sorted(got, key=str) == sorted([1, None, 3], key=str)


def test_clashing_columns_and_an_empty_table(spark):
    clash = ("_mark", "body", "score", "key", "i", "m", "id", "n_dropped", "held_out", "row_no", "times")
    docs = documents(spark, DIR).limit(60).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DIR)
            assert [c for c in now.columns if c not in ("n_dropped",)] == [c for c in docs.columns if c not in ("n_dropped",)], name
        assert (corpus_pipeline.pack(spark, now, DIR).count() > 0) == (table is docs)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_mixing", "op5_exact_dedup", "op7_ngram_join", "op8_quality_rules"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = ([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x[cols].itertuples(index=False)] for x in (got, want))
    assert Counter(map(str, a)) == Counter(map(str, b))
