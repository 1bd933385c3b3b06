"""Layout inference: which sheets are tables, labelled columns, styled sections or free text, and where their data begin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.functions.text import any_of, plain, strip_accents, text

SHEET = ["file_idx", "path", "sheet_idx", "sheet"]
HEADER_ROWS = 10


def header_field(c: Column | str, synonyms: list[tuple[str, str, bool]] = dims.HEADER_SYNONYMS) -> Column:
    """The field that a column header names: the longest synonym found in it, the first on ties; null for none."""
    raw, key = text(c), F.lower(strip_accents(F.trim(text(c))))

    def found(i: int, field: str, pattern: str, is_regex: bool) -> Column:
        length = F.length(F.regexp_extract(raw, f"(?iU){pattern}", 0)) if is_regex else F.when(F.contains(key, F.lit(plain(pattern.lower()))), len(pattern)).otherwise(0)
        return F.struct(length.alias("length"), F.lit(-i).alias("prio"), F.lit(field).alias("field"))

    best = F.array_max(F.array(*[found(i, *s) for i, s in enumerate(synonyms)]))
    return F.when(best["length"] > 0, best["field"])


def _log(rows: DataFrame, message: Column) -> DataFrame:
    return rows.select(F.lit(-1).alias("stage"), F.col("file_idx").alias("ordinal"), F.col("sheet_idx").cast("long").alias("seq"), message.alias("message"))


def single_columns(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, sheets) of sheets that use one column. cells: SHEET, pos (number among non-empty cells), text. sheets: SHEET,
    n_cells, ville_text, type_centre, responsable, data_start; header rows count only where recognised."""
    order = Window.partitionBy(*SHEET).orderBy("row_idx")
    cells = grid.select(*SHEET, "row_idx", F.get("values", F.lit(0)).alias("text")).filter("text <> ''").withColumn("pos", F.row_number().over(order) - 1).drop("row_idx")
    at = lambda k: F.max(F.when(F.col("pos") == k, F.col("text"))).alias(f"c{k}")
    heads = cells.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_cells"), *[at(k) for k in range(5)])
    centre = any_of(F.lower(text("c1")), "centre", "compétence", "référence")
    heads = heads.withColumn("d1", F.when(centre, 2).otherwise(1))
    cell = lambda k: F.get(F.array("c0", "c1", "c2", "c3", "c4"), k)
    lead = text(cell(F.col("d1"))).rlike(r"(?iU)^Responsable\s*:")
    heads = heads.withColumn("d2", F.col("d1") + lead.cast("int"))
    address = text(cell(F.col("d2"))).rlike(r"(?iU)^Adresse postale\s*:")
    sheets = heads.select(
        *SHEET,
        "n_cells",
        F.col("c0").alias("ville_text"),
        F.when(F.col("d1") == 2, F.col("c1")).otherwise("").alias("type_centre"),
        F.when(F.col("d2") > F.col("d1"), F.trim(F.regexp_extract(text(cell(F.col("d1"))), r"(?iU)^Responsable\s*:\s*(.*)", 1))).otherwise("").alias("responsable"),
        (F.col("d2") + address.cast("int")).alias("data_start"),
        text("c4").alias("fifth"),
    )
    return cells, sheets


# What shows a sheet's or a document's kind of content.
NUMBERED, SECTOR, SEVERAL = r"(?U)^(\d+)\.?\s+", r"(?iU)^Secteur\s+", r"(?U)[A-ZÀ-Ý]{2,}\s+\w+\s*[-–/&]\s*[A-ZÀ-Ý]"
LABELS = {"nom": r"(?iU)NOM\s*[–\-]\s*PRENOM\s*:", "hopital": r"(?iU)H[oô]pital\s+de\s+rattachement\s*:", "telephone": r"(?iU)T[ée]l[ée]phone\s*:"}
LOOSE_LABELS = {"adresse": "adresse postale", "email": "adresse mail"}
SAMPLED_ROWS = 30
SHOWN = {"nom": r"(?iU)(Dr|Pr|Professeur)\s+[\w\-À-ÿ]+", "telephone": r"(?iU)(?:T[ée]l|0\d[\d\s\.]{8,})", "email": r"(?U)[\w\.\-]+@[\w\.\-]+\.\w+"}


def sheet_flags(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """SHEET and what describes a labelled sheet: numbered, sectors, several (names in a cell), idem, and labels, the fields whose labels
    are among its first data cells. cells and sheets: of single_columns(). Nothing else depends on these."""
    data = cells.join(sheets.filter("n_cells >= 4").select(*SHEET, "data_start"), SHEET).filter("pos >= data_start")
    some = F.col("pos") < F.col("data_start") + SAMPLED_ROWS
    has = {f: F.col("text").rlike(p) for f, p in LABELS.items()} | {f: F.contains(F.lower("text"), F.lit(p)) & F.contains(F.col("text"), F.lit(":")) for f, p in LOOSE_LABELS.items()}
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    labels = F.array_compact(F.array(*[F.when(F.max(some & has[f]), F.lit(f)) for f in ("nom", "hopital", "adresse", "telephone", "email")]))
    return data.groupBy(*SHEET).agg(F.max(F.col("text").rlike(NUMBERED)).alias("numbered"), F.max(F.col("text").rlike(SECTOR)).alias("sectors"), whole.rlike(SEVERAL).alias("several"), F.contains(F.lower(whole), F.lit("idem")).alias("idem"), labels.alias("labels"))


def document_flags(paragraphs: DataFrame) -> DataFrame:
    """file_idx and fields: which of name, phone and e-mail a document's paragraphs show. Nothing else depends on these."""
    words = paragraphs.filter("kind = 'paragraph'").select("file_idx", "row_idx", F.get("values", F.lit(0)).alias("text")).filter("text <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda x: x["text"]), " ")
    return words.groupBy("file_idx").agg(F.array_compact(F.array(*[F.when(whole.rlike(p), F.lit(f)) for f, p in SHOWN.items()])).alias("fields"))


def table_headers(grid: DataFrame, fixed: bool) -> DataFrame:
    """SHEET, header_row, and one row per recognised column (col, field). The header is the first of ten rows with the most
    recognised cells, two at least; fixed: row 0 of the first table, one at least."""
    cells = grid.filter(F.col("row_idx") < (1 if fixed else HEADER_ROWS)).select(*SHEET, "row_idx", F.posexplode("values").alias("col", "label"))
    named = cells.withColumn("field", header_field("label")).filter("field is not null")
    scores = named.groupBy(*SHEET, "row_idx").agg(F.count(F.lit(1)).alias("score")).filter(F.col("score") >= (1 if fixed else 2))
    best = scores.groupBy(*SHEET).agg(F.max_by("row_idx", F.struct("score", -F.col("row_idx"))).alias("row_idx"))
    return named.join(best, [*SHEET, "row_idx"]).withColumnRenamed("row_idx", "header_row").drop("label")


def split_layouts(rows: DataFrame) -> dict[str, DataFrame]:
    """The decoded rows by layout.

    single, multi: workbook rows of sheets that use one column or more; sectioned (with `header_style`), tables, free:
    document rows; errors. Document tables count only where no paragraph has a list style."""
    grid = rows.filter("kind = 'row'").drop("kind", "style")
    used = F.size(F.col("values")) - F.coalesce(F.array_position(F.transform(F.reverse("values"), lambda v: v != ""), True), F.lit(0)).cast("int") + 1
    filled = F.when(F.exists("values", lambda v: v != ""), used).otherwise(0)
    widths = grid.groupBy(*SHEET).agg(F.max(filled).alias("width"))
    wide = grid.join(widths, SHEET)
    words = rows.filter("kind in ('paragraph', 'table')")
    shown = (F.col("kind") == "paragraph") & (F.get("values", F.lit(0)) != "")
    facts = words.groupBy("file_idx").agg(
        F.max((F.col("kind") == "table").cast("int")).alias("tables"),
        F.max((shown & (F.col("style") == "List Paragraph")).cast("int")).alias("listed"),
        F.min_by("style", F.when(shown & F.col("style").startswith("Heading"), F.col("row_idx"))).alias("heading"),
        F.max((shown & F.col("style").startswith("Heading")).cast("int")).alias("headed"),
    )
    layout = F.when((F.col("tables") == 1) & (F.col("listed") == 0), "tables").when(F.col("listed") == 1, "sectioned").when(F.col("headed") == 1, "sectioned").otherwise("free")
    style = F.when(F.col("listed") == 1, "List Paragraph").otherwise(F.col("heading"))
    known = words.join(facts.select("file_idx", layout.alias("layout"), style.alias("header_style")), "file_idx")
    return {
        "single": wide.filter("width <= 1").drop("width"),
        "multi": wide.filter("width > 1").drop("width"),
        "sectioned": known.filter("layout = 'sectioned' and kind = 'paragraph'"),
        "tables": known.filter("layout = 'tables'"),
        "free": known.filter("layout = 'free' and kind = 'paragraph'"),
        "errors": rows.filter("kind = 'error'"),
    }


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
