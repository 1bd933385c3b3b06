"""Resolution of specialty labels: exact, by prefix, by one typing error, by sound."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import dims
from .metaphone import metaphone
from .text import lookup, once, strip_accents, text

_RESOLVED = "struct<specialite:string,method:string>"


def specialty_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.trim(text(c)))), ":+$", ""))


def classify_native(c: Column | str, exact: dict[str, str] = dims.SPECIALTIES, prefixes: dict[str, str] = dims.SPECIALTY_PREFIXES) -> Column:
    """struct(specialite, method) of all steps but the last; nulls inside where none finds anything."""
    found = lambda spec, how: F.struct(spec.alias("specialite"), F.lit(how).alias("method"))
    none = F.struct(F.lit(None).cast("string").alias("specialite"), F.lit(None).cast("string").alias("method"))

    def steps(key: Column) -> Column:
        listed = lookup(key, exact)
        begun = [F.when(key.startswith(p), found(F.lit(s), "prefix")) for p, s in prefixes.items()]
        near = [
            F.when((F.length(key) >= len(p)) & (F.levenshtein(F.substring(key, 1, len(p)), F.lit(p), 1) >= 0), found(F.lit(s), "fuzzy"))
            for p, s in prefixes.items()
            if len(p) >= 6
        ]
        return F.coalesce(F.when(listed.isNotNull(), found(listed, "exact")), *begun, *near, none)

    return F.when(text(c) == "", none).otherwise(once(specialty_key(c), steps))


def _heard(known: tuple[str, ...]):
    """All known specialties that sound like a label."""

    def run(labels: pd.Series) -> pd.Series:
        codes: dict[str, list[str]] = {}
        for s in known:
            codes.setdefault(metaphone(s), []).append(s)
        return labels.map(lambda label: codes.get(metaphone(label), []) if label else [])

    return F.pandas_udf(run, ArrayType(StringType()))


def by_sound(c: Column, known: tuple[str, ...] = tuple(dims.PHONETIC_SPECIALTIES)) -> Column:
    """The specialty that sounds like a label, null if none or several do."""
    found = _heard(known)(c)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def sound_conflicts(df: DataFrame, column: str, known: tuple[str, ...] = tuple(dims.PHONETIC_SPECIALTIES)) -> DataFrame:
    """message: one for each distinct label that only its sound could resolve and that sounds like several specialties."""
    labels = df.select(F.col(column).alias("label"), specialty_key(column).alias("key")).distinct().filter(classify_native("key")["specialite"].isNull() & (F.col("key") != ""))
    heard = labels.withColumn("found", _heard(known)("key")).filter("size(found) > 1")
    return heard.select(F.concat(F.lit("[Phonetique] '"), "label", F.lit("' correspond a plusieurs specialites ("), F.array_join("found", ", "), F.lit(") — non resolu")).alias("message"))


def classify(df: DataFrame, column: str, out: str = "resolved", exact: dict[str, str] = dims.SPECIALTIES, prefixes: dict[str, str] = dims.SPECIALTY_PREFIXES, known: tuple[str, ...] = tuple(dims.PHONETIC_SPECIALTIES), many: bool = False) -> DataFrame:
    """df with `out`: struct(specialite, method). Distinct labels are resolved once, and only those that the built-in steps leave
    open are heard by Python. many: distinct labels grow with the input, so they are dealt to all tasks; by size they would be one's."""
    keyed = df.withColumn("_key", specialty_key(column))
    labels = keyed.select("_key").filter("_key <> ''").distinct()
    if many:
        labels = labels.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    labels = labels.withColumn("_first", classify_native("_key", exact, prefixes))
    if many:
        from rostra.plans.scratch import written

        labels = written(labels, "labels")  # what follows names _first several times
    heard = labels.withColumn("_heard", by_sound(F.when(F.col("_first.specialite").isNull(), F.col("_key")).otherwise(""), known))
    sound = F.struct(F.col("_heard").alias("specialite"), F.lit("phonetic").alias("method"))
    table = heard.select("_key", F.when(F.col("_heard").isNotNull(), sound).otherwise(F.col("_first")).alias(out))
    if many:
        table = table.hint("merge")  # small as a file, but a row for each distinct word: not through the driver
    return keyed.join(table, "_key", "left").drop("_key")
