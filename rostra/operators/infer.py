"""Missing contact data from records at the same hospital, of built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import SECRETARIAT, hospital_key, strip_accents, text

INFERRED = ("adresse", "telephone", "email")


def site_key(ville: Column | str = "ville", hopital: Column | str = "hopital") -> Column:
    """struct(city, hospital), null without a hospital."""
    hospital = hospital_key(hopital)
    return F.when(hospital != "", F.struct(F.trim(strip_accents(F.lower(text(ville)))).alias("city"), hospital.alias("hospital")))


def shared_values(records: DataFrame) -> DataFrame:
    """One row per site with two records or more: site, display, first_ordinal, and for each field the sorted candidate values
    (one: shared; more: ambiguous; none: nothing to share).

    An address counts wherever it is known. A phone or e-mail counts if a record that speaks of a secretariat has it, else
    if two records have it. Values are counted before they are listed, so no task lists the records of a site.
    """
    keyed = records.withColumn("site", site_key()).filter("site is not null")
    sites = keyed.groupBy("site").agg(F.count(F.lit(1)).alias("members"), F.min_by("hopital", "ordinal").alias("display"), F.min("ordinal").alias("first_ordinal")).filter("members > 1")
    hint = F.concat_ws(" ", text("notes"), text("adresse")).rlike(SECRETARIAT)
    long = keyed.select("site", hint.alias("hint"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(text(f)).alias("value")) for f in INFERRED])).alias("x"))
    counted = long.filter("x.value <> ''").groupBy("site", "x.field", "x.value").agg(F.count(F.lit(1)).alias("c"), F.max("hint").alias("labelled"))
    of = lambda field, when: F.array_sort(F.collect_set(F.when((F.col("field") == field) & when, F.col("value"))))
    lists = counted.groupBy("site").agg(
        of("adresse", F.lit(True)).alias("adresse"),
        *[of(f, F.col("labelled")).alias(f"{f}_l") for f in INFERRED[1:]],
        *[of(f, F.col("c") >= 2).alias(f"{f}_r") for f in INFERRED[1:]],
    )
    picked = lists.select("site", F.col("adresse").alias("s_adresse"), *[F.when(F.size(f"{f}_l") > 0, F.col(f"{f}_l")).otherwise(F.col(f"{f}_r")).alias(f"s_{f}") for f in INFERRED[1:]])
    return sites.join(picked, "site", "left")


def _other_than(field: str):
    return lambda k, _: k != field


def infer(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with blanks filled, noted and marked; log of what is ambiguous)."""
    columns = records.columns
    shared = shared_values(records)
    joined = records.withColumn("_site", site_key()).join(shared, F.col("_site") == F.col("site"), "left")
    out, notes, markers, logs = joined, text("notes"), F.col("markers"), []
    for i, f in enumerate(INFERRED):
        values = F.col(f"s_{f}")
        blank = text(f) == ""
        fills = blank & (F.size(values) == 1)
        note = F.concat(F.lit(f"{f} infere depuis secretariat "), F.col("display"))
        marked = F.map_from_arrays(F.array(F.lit(f)), F.array(F.struct(F.lit("inferred").alias("kind"), F.concat(F.lit("Infere depuis secretariat "), F.col("display")).alias("comment"))))
        added = F.when(notes == "", note).otherwise(F.concat(notes, F.lit(" ; "), note))
        notes = F.when(F.coalesce(fills, F.lit(False)) & ~F.contains(notes, note), added).otherwise(notes)
        markers = F.when(F.coalesce(fills, F.lit(False)), F.map_concat(F.map_filter(markers, _other_than(f)), marked)).otherwise(markers)
        out = out.withColumn(f"_new_{f}", F.when(F.coalesce(fills, F.lit(False)), F.get(values, F.lit(0))).otherwise(F.col(f)))
        listed = F.concat(F.lit("("), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit(")"))
        message = F.concat(F.lit(f"[Inference] {f} ambigu pour "), text("titre"), F.lit(" "), text("nom"), F.lit(" ("), F.col("display"), F.lit("): valeurs "), listed, F.lit(" — laisse vide"))
        logs.append(F.when(blank & (F.size(values) > 1), F.struct(F.col("first_ordinal").alias("o"), F.col("ordinal").alias("r"), F.lit(i).alias("f"), message.alias("message"))))
    out = out.withColumn("_notes", notes).withColumn("_markers", markers)
    new = {**{f: f"_new_{f}" for f in INFERRED}, "notes": "_notes", "markers": "_markers"}
    log = joined.select(F.explode(F.filter(F.array(*logs), lambda x: x.isNotNull())).alias("x")).select(F.lit(1).alias("stage"), F.col("x.o").alias("ordinal"), (F.col("x.r") * 8 + F.col("x.f")).alias("seq"), "x.message")
    return out.select(*[F.col(new.get(c, c)).alias(c) for c in columns]), log
