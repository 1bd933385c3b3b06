"""Reports: cross-tab, totals, sorted directory, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.functions.text import soft_row, text


def specialty_rank(c: Column | str) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in dims.SPECIALTY_ORDER]), text(c))
    return F.when(place > 0, place - 1).otherwise(99)


def counts_by_city(records: DataFrame) -> DataFrame:
    """ville, specialite, named: records with a name; a city whose records all lack one has its rows with 0."""
    return records.groupBy(text("ville").alias("ville"), text("specialite").alias("specialite")).agg(F.count_if(text("nom") != "").alias("named"))


def crosstab_long(records: DataFrame) -> DataFrame:
    """ville, specialite, named with totals: specialite `Total` of a city, ville `TOTAL` of a specialty, and both. Blank
    specialties count in totals only."""
    rolled = counts_by_city(records).cube("ville", "specialite").agg(F.sum("named").alias("named"), F.grouping("ville").alias("gv"), F.grouping("specialite").alias("gs"))
    shown = rolled.filter("gs = 1 or specialite <> ''")
    return shown.select(F.when(F.col("gv") == 1, "TOTAL").otherwise(F.col("ville")).alias("ville"), F.when(F.col("gs") == 1, "Total").otherwise(F.col("specialite")).alias("specialite"), "named")


def crosstab(records: DataFrame) -> DataFrame:
    """The printed form: one row per city in order and a TOTAL row, one column per specialty present in rank order; a city's
    zero is null. All specialties are columns, also labels that no rule resolved; they are listed on the driver."""
    present = [r[0] for r in counts_by_city(records).filter("specialite <> ''").select("specialite").distinct().select("specialite", specialty_rank("specialite").alias("k")).orderBy("k", "specialite").select("specialite").collect()]
    wide = crosstab_long(records).groupBy("ville").pivot("specialite", ["Total", *present]).agg(F.sum("named"))
    last = F.col("ville") == "TOTAL"
    cell = lambda c: F.when(last, F.coalesce(F.col(f"`{c}`"), F.lit(0))).otherwise(F.nullif(F.col(f"`{c}`"), F.lit(0)))
    return wide.select("ville", F.coalesce("Total", F.lit(0)).alias("Total"), *[cell(c).alias(c) for c in present]).orderBy(last, "ville")


def sorted_directory(records: DataFrame) -> DataFrame:
    """Records in output order with `row_soft` (lightly shaded) and `cell_kinds` (field to marker kind)."""
    kinds = F.transform_values("markers", lambda _, m: m["kind"]) if "markers" in records.columns else F.create_map().cast("map<string,string>")
    shown = records.withColumn("row_soft", soft_row("notes")).withColumn("cell_kinds", kinds)
    return shown.orderBy("ville", "specialite", "secteur", "nom", "ordinal")


def journal(log: DataFrame) -> DataFrame:
    """The log's messages in order, or one row that says there are none."""
    none = log.sparkSession.createDataFrame([("Aucun avertissement",)], "message string")
    alone = none.join(log.select(F.lit(1).alias("x")).limit(1), F.lit(True), "left").filter("x is null").select(F.lit(9).alias("stage"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("seq"), "message")
    return log.select("stage", "ordinal", F.col("seq").cast("long").alias("seq"), "message").unionByName(alone).orderBy("stage", "ordinal", "seq").select("message")
