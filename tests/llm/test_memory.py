"""What a Python worker holds during and after a task: workers wait for the next task beside the executor's heap."""

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm import packing, quality_classifier

#: Runs a function of Arrow batches in a fresh process: MB without mapped files after the imports, at most, and at the end.
WORKER = """
import pickle, re, sys, threading, time
import numpy, pyarrow, tokenizers, xxhash
def now():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def batches():
    with open(sys.argv[2], "rb") as f:
        yield from pyarrow.ipc.open_stream(f)
run = pickle.load(open(sys.argv[1], "rb"))
before, most = now(), 0
def watch():
    global most
    while True:
        most = max(most, now())
        time.sleep(0.005)
threading.Thread(target=watch, daemon=True).start()
for made in run(batches()):
    pass
del made
print(before, most, now())
"""


def functions(monkeypatch, make):
    """The functions that make() gives to mapInArrow, with their schemas."""
    found, real = [], DataFrame.mapInArrow
    for kind in {DataFrame, *DataFrame.__subclasses__()}:
        if "mapInArrow" in vars(kind):
            real = kind.mapInArrow
            monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, real=real: found.append((self.schema.names, f)) or real(self, f, schema))
    make()
    return found


@pytest.mark.parametrize("what,most,left", [("packing", 120, 60), ("training", 140, 70), ("scoring", 100, 60)])
def test_a_worker_gives_memory_back(spark, labels, monkeypatch, tmp_path, what, most, left):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(5000)
    texts = docs.toArrow()["text"].combine_chunks()
    texts = pa.concat_arrays([texts] * -(-20_000_000 // texts.nbytes))
    make = {"packing": lambda: packing.packing(docs), "training": lambda: quality_classifier.train(docs, labels), "scoring": lambda: quality_classifier.quality_scores(docs, labels)}[what]
    names, run = functions(monkeypatch, make)[-1]
    ids = pa.array(range(len(texts)), pa.int64())
    columns = {"doc_id": ids, "text": texts, "y": pa.array([i % 2 for i in range(len(texts))], pa.int32()), "body": pa.StructArray.from_arrays([ids, texts], names=["doc_id", "text"])}
    batch = pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
    with pa.ipc.new_stream(f"{tmp_path}/in", batch.schema) as out:
        out.write_batch(batch)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(run))
    got = subprocess.run([sys.executable, "-c", WORKER, f"{tmp_path}/run", f"{tmp_path}/in"], capture_output=True, text=True, env={"PYTHONPATH": ":".join(p for p in sys.path if p), "OMP_NUM_THREADS": "1"}, timeout=120, check=True)
    before, peak, after = map(float, got.stdout.split())
    assert peak - before < most and after - before < left


def test_scores_of_texts_that_are_no_strings(spark, odd, labels):
    """A text that is cast goes to Python beside the body, a string within it."""
    scores = lambda df: sorted(map(str, quality_classifier.quality_scores(df, labels).select("body.doc_id", "score").collect()))
    assert scores(odd) == scores(odd.withColumn("text", F.col("text").cast("binary"))) == scores(odd.select("text", "doc_id"))
