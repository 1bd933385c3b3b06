"""The whole consolidation: files to records, records to a directory, an existing directory enriched; command line."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.operators.fold import fold
from rostra.operators.infer import infer
from rostra.operators.report import crosstab, crosstab_long, journal, sorted_directory
from rostra.sources.ooxml import BODY, JOURNAL_WIDTH, PLAIN, Sheet, read_files, write_workbook

from .extract import MARKERS, from_free_text, from_sections, from_single_columns, from_tables, numbered
from .layout import SHEET, _log, split_layouts, union
from .scratch import written

DIRECTORY_SHEET = "Annuaire Complet"


def _joined(rows: DataFrame, keys: list[str], order: str, column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column.alias("text")))), lambda x: x["text"]), " ").alias("body"))


def extract_records(spark: SparkSession, paths: list[str], origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, log) of all files in order. source is the origin, else the file's name."""
    rows = written(read_files(spark, paths), "files")
    by = split_layouts(rows)
    tables, table_log, headless = from_tables(by["multi"], "Excel")
    words, word_log, headless_words = from_tables(by["tables"].filter("kind = 'table'").select(*SHEET, "row_idx", "values"), "Word")
    single, single_log = from_single_columns(by["single"])
    sections, section_log = from_sections(by["sectioned"])
    sheet_text = _joined(headless, SHEET, "row_idx", F.coalesce(F.get("values", F.lit(0)), F.lit(""))).select("file_idx", "sheet_idx", "sheet", F.lit("Excel").alias("source"), "body")
    lost = headless_words.select("file_idx").distinct()
    paragraphs = by["free"].select("file_idx", "row_idx", "values").unionByName(by["tables"].filter("kind = 'paragraph'").join(lost, "file_idx", "left_semi").select("file_idx", "row_idx", "values"))
    document_text = _joined(paragraphs.filter(F.get("values", F.lit(0)) != ""), ["file_idx"], "row_idx", F.get("values", F.lit(0))).select("file_idx", F.lit(0).alias("sheet_idx"), F.lit("freetext").alias("sheet"), F.lit("Word").alias("source"), "body")
    free, free_log = from_free_text(union(sheet_text, document_text))
    found = union(tables, words, single, sections, free)
    log = union(table_log, word_log, single_log, section_log, free_log, _log(by["errors"], F.get("values", F.lit(0))))
    return written(stamped(found, [origin or p.rstrip("/").rsplit("/", 1)[-1] for p in paths]), "extracted"), written(log, "log")


def stamped(found: DataFrame, labels: list[str]) -> DataFrame:
    """Extracted records, numbered in the order of their places, with their file's label as source. labels: by file number."""
    names = found.sparkSession.createDataFrame(list(enumerate(labels)), "f long, stamp string")
    return numbered(found).withColumn("f", F.col("place.file")).join(names, "f").withColumn("source", F.col("stamp")).select("ordinal", *dims.FIELDS, "markers")


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, log) of a directory workbook: its sheet `Annuaire Complet`, else the first; the header is the first of five
    rows with three known headers or more. Rows without name and notes go; markers are not kept in a workbook."""
    rows = written(read_files(spark, [path]).filter("kind = 'row'"), "directory")
    best = rows.select("sheet_idx", "sheet").distinct().orderBy(F.col("sheet") != DIRECTORY_SHEET, "sheet_idx").limit(1)
    sheet = rows.join(best, ["sheet_idx", "sheet"], "left_semi").withColumn("row", F.col("row_idx"))
    fields = F.create_map(*[F.lit(x) for kv in zip(dims.HEADERS, dims.FIELDS, strict=True) for x in kv])
    cells = sheet.select("row", F.posexplode("values").alias("col", "value")).withColumn("value", F.trim("value")).filter("value <> ''")
    heads = cells.filter("row < 5").withColumn("field", F.element_at(fields, F.col("value"))).filter("field is not null")
    head = heads.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").agg(F.min("row").alias("head"))
    columns = heads.join(head, F.col("row") == F.col("head")).select("col", "field", "head")
    data = cells.join(F.broadcast(columns), "col").filter("row > head")
    wide = data.groupBy("row").pivot("field", dims.FIELDS).agg(F.max_by("value", "col"))
    found = wide.select((F.col("row").cast("long") - 1_000_000_000).alias("ordinal"), *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in dims.FIELDS], F.create_map().cast(MARKERS).alias("markers")).filter("nom <> '' or notes <> ''")
    other = best.filter(F.col("sheet") != DIRECTORY_SHEET).select(F.lit(0).alias("file_idx"), "sheet_idx", F.concat(F.lit(f"Feuille '{DIRECTORY_SHEET}' non trouvee, utilisation de '"), F.col("sheet"), F.lit("'")).alias("m"))
    none = head.filter("head is null").select(F.lit(0).alias("file_idx"), F.lit(0).alias("sheet_idx"), F.lit("Aucun en-tete reconnu dans le fichier annuaire").alias("m"))
    return found, union(_log(other, F.col("m")), _log(none, F.col("m")))


def consolidate(records: DataFrame, run_date: str) -> tuple[DataFrame, DataFrame]:
    """(directory, log): records merged among themselves, then blanks inferred."""
    merged, log = fold(records, None, run_date)
    filled, more = infer(merged)
    return filled, union(_same(log), _same(more))


def enrich(existing: DataFrame, records: DataFrame, run_date: str) -> tuple[DataFrame, DataFrame]:
    """(directory, log): existing records updated and extended. Nothing new: existing as it is, without inference."""
    if not records.limit(1).count():
        return existing, existing.sparkSession.createDataFrame([], "stage int, ordinal long, seq long, message string")
    merged, log = fold(records, existing, run_date)
    filled, more = infer(merged)
    return filled, union(_same(log), _same(more))


def _same(log: DataFrame) -> DataFrame:
    return log.select(F.col("stage").cast("int"), F.col("ordinal").cast("long"), F.col("seq").cast("long"), "message")


def write_directory(directory: DataFrame, log: DataFrame, path: str) -> None:
    """One workbook: directory with legend, marker fills and comments, and filters; cross-tab; journal. path may be the address of a
    file in a store. Rows stream through the driver."""
    # The legend above the header.
    legend = [("Legende:", PLAIN), ("Conflit hopital (revue manuelle)", "conflict"), ("Valeur inferee depuis un confrere", "inferred"), ("Specialite resolue phonetiquement", "phonetic")]

    def people():
        yield legend
        yield [(h, "header") for h in dims.HEADERS]
        for r in sorted_directory(directory).toLocalIterator():
            style = lambda f: r["cell_kinds"].get(f) or ("soft" if r["row_soft"] else BODY)  # noqa: B023, E731
            yield [(r[f], style(f), (r["markers"].get(f) or {"comment": ""})["comment"]) for f in dims.FIELDS]

    def table(df: DataFrame, heads: list[str]):
        yield [(h, "header") for h in heads]
        for r in df.toLocalIterator():
            yield [("" if v is None else str(v), PLAIN) for v in r]

    tab = crosstab(directory)
    write_workbook(path, [Sheet(DIRECTORY_SHEET, people(), 2, filter_row=2), Sheet("Par Ville", table(tab, ["Ville", *tab.columns[1:]]), 1, 1), Sheet("Journal Import", table(journal(log), ["Message"]), width=JOURNAL_WIDTH)])


def write_tables(directory: DataFrame, log: DataFrame, folder: str) -> None:
    """The same three parts as Parquet tables in a folder, written by all tasks: directory (with markers), par_ville, journal."""
    sorted_directory(directory).write.mode("overwrite").parquet(f"{folder}/directory")
    crosstab_long(directory).write.mode("overwrite").parquet(f"{folder}/par_ville")
    log.write.mode("overwrite").parquet(f"{folder}/journal")


def generate(spark: SparkSession, paths: list[str], origin: str | None = None, existing: str | None = None, run_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(directory, log) of files, on top of an existing directory workbook if one is given."""
    run_date = run_date or datetime.date.today().isoformat()
    found, log = extract_records(spark, paths, origin)
    found = found.withColumn("date_import", F.lit(run_date))
    if existing:
        old, old_log = read_directory(spark, existing)
        done, more = enrich(old, found, run_date)
        log = union(_same(log), _same(old_log))
    else:
        done, more = consolidate(found, run_date)
    return written(done, "directory"), union(_same(log), more)


def named_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("nom") != "").alias("named"), F.count(F.lit(1)).alias("records"))


def main() -> None:
    p = argparse.ArgumentParser(description="Consolidate contact lists into one directory workbook.")
    p.add_argument("files", nargs="+")
    p.add_argument("--origin")
    p.add_argument("--existing")
    p.add_argument("--out", required=True)
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    directory, log = generate(spark, a.files, a.origin, a.existing)
    write_directory(directory, log, a.out)
    print(named_count(directory).first())


if __name__ == "__main__":
    main()
