from pyspark.sql import functions as F
from test_fold import doc, table

from rostra.streaming.enrich_stream import enrich_stream


def test_batches_enrich_the_directory(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = table(spark, [doc(telephone="1"), doc("DUVAL"), doc(email="a@b.fr")])
    rows.filter("ordinal < 2").write.mode("append").parquet(source)
    for extra in (None, rows.filter("ordinal = 2")):
        if extra is not None:
            extra.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = enrich_stream(stream, out, "2026-01-01").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    last = spark.read.parquet(f"{out}/batch=1")
    assert {(r["nom"], r["telephone"], r["email"]) for r in last.collect()} == {("MARTIN", "1", "a@b.fr"), ("DUVAL", "", "")}
    assert last.filter(F.col("nom") == "").count() == 0
