"""Driver queries of layout inference, extraction and the fold, and what they must give as DuckDB SQL.

The driver's tables hold no files, so the lines of sheets and documents are made from `customer`: a sheet or document for each
nation, some lines for each customer, by planted variants. The SQL does not read those lines. It states the record that each
variant must give, by hand, and carries sections and sectors on with windows of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.operators import fold as folding
from rostra.plans import extract, layout
from rostra.plans.extract import MARKERS
from rostra.plans.pipeline import stamped

CITIES = [k.title() for k in dims.REGIONS]
SURNAMES = ["BERNARD", "PÉRIVIER", "LE GALL", "DUMOULIN", "FAURE", "GARCIA", "HARAMBAT", "ISIDOR", "JOUBERT", "KLEIN", "LEFORT", "MOREAU", "NIVELLE", "OLLIVIER", "PETIT-JEAN", "QUENTIN", "RIGOTHIER", "SCHNEIDER", "THÉVENOT", "VASSEUR"]
#: A person as written, and the title, surname and first name that this must give.
PERSONS = [
    ("Jean Dupont", "", "DUPONT", "Jean"), ("MARTIN Sophie", "", "MARTIN", "Sophie"), ("Pr Claire DURAND", "Pr", "DURAND", "Claire"), ("LEFORT, Bruno", "", "LEFORT", "Bruno"),
    ("ISIDOR", "", "ISIDOR", ""), ("Smith Jones", "", "SMITH", "Jones"), ("HACHON LE CAMUS Caroline", "", "HACHON LE CAMUS", "Caroline"), ("ROUX ANNE", "", "ROUX", "ANNE"),
    ("Professeur Leroy Thomas", "Pr", "LEROY", "Thomas"), ("Mathilde Durand", "", "DURAND", "Mathilde"), ("Valentin Petit", "", "PETIT", "Valentin"), ("Dr Sarah Lopez", "Dr", "LOPEZ", "Sarah"),
    ("Raphael Blanc", "", "BLANC", "Raphael"), ("Pierre Jean", "", "PIERRE", "Jean"), ("Jean-Marc Duval", "", "DUVAL", "Jean-Marc"), ("dr Corentin Morin", "Dr", "MORIN", "Corentin"),
]
#: A line that begins a section: specialty, detail, how it was found, from what, sector on the same line. Empty: no such line.
HEADINGS = [
    ("1. DERMATOLOGUES", "DERMATOLOGIE", "", "", "", ""), ("", "", "", "", "", ""), ("2 AUTRES SPECIALITES, préciser : Neurologie pédiatrique", "NEUROLOGIE", "Neurologie pédiatrique", "", "", ""),
    ("Cardiologie", "CARDIOLOGIE", "", "", "", ""), ("3. dermathologue", "DERMATOLOGIE", "", "fuzzy", "dermathologue", ""), ("", "", "", "", "", ""),
    ("4. Médecine du sport : Genou", "MÉDECINE DU SPORT", "Genou", "", "", ""), ("5. UROLOGUES Secteur Adulte", "UROLOGIE", "", "", "", "Adulte"), ("nefrologie", "NEPHROLOGIE", "", "phonetic", "nefrologie", ""),
    ("", "", "", "", "", ""), ("6. GENETICIENS, préciser: Ophtalmologie", "GENETIQUE", "Ophtalmologie", "", "", ""), ("", "", "", "", "", ""),
]
#: A line that begins a sector, and the sector.
SECTORS = [("Secteur Pédiatrie :", "Pediatrie"), ("Secteur enfants et adultes", "Pediatrie et Adulte"), ("", ""), ("", ""), ("Secteur : Adulte", "Adulte")]
LABELS = [("Dermatologues", "DERMATOLOGIE"), ("dermathologue", "DERMATOLOGIE"), ("cardio pediatrique", "CARDIOLOGIE"), ("Médecine interne", "MÉDECINE INTERNE"), ("", ""), ("Génétique", "GENETIQUE"), ("nefrologie", "NEPHROLOGIE")]


def _rows(items, alias: str, *names: str) -> str:
    quoted = ["(" + ", ".join([str(i), *["'" + str(x).replace("'", "''") + "'" for x in (item if isinstance(item, tuple) else (item,))]]) + ")" for i, item in enumerate(items)]
    return f"(VALUES {', '.join(quoted)}) AS {alias}(k, {', '.join(names)})"


#: Each customer and the variants that follow from its key; Spark and DuckDB read this alike.
PLANTED = f"""SELECT c.c_custkey AS id, c.c_nationkey AS sheet, v.city, v.region, s.surname, h.heading, h.spec, h.detail, h.how, h.src, h.inline, z.line AS sector_line, z.sector, c.c_custkey % 8 AS w,
  p.person, p.titre, p.nom, p.prenom, l.label, l.resolved, CAST(c.c_custkey % 90 + 10 AS VARCHAR(2)) AS nn
FROM customer c JOIN {_rows([(c, dims.REGIONS[c.lower()]) for c in CITIES], 'v', 'city', 'region')} ON v.k = c.c_nationkey JOIN {_rows(SURNAMES, 's', 'surname')} ON s.k = (c.c_custkey * 7) % {len(SURNAMES)}
JOIN {_rows(HEADINGS, 'h', 'heading', 'spec', 'detail', 'how', 'src', 'inline')} ON h.k = c.c_custkey % {len(HEADINGS)} JOIN {_rows(SECTORS, 'z', 'line', 'sector')} ON z.k = c.c_custkey % {len(SECTORS)}
JOIN {_rows(PERSONS, 'p', 'person', 'titre', 'nom', 'prenom')} ON p.k = (c.c_custkey * 3) % {len(PERSONS)} JOIN {_rows(LABELS, 'l', 'label', 'resolved')} ON l.k = c.c_custkey % {len(LABELS)}"""
_P = f"WITH p AS ({PLANTED})"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLANTED.replace("FROM customer c", "FROM {customer} c"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _lines(rows: DataFrame, order: list[str], lines) -> DataFrame:
    """sheet, row_idx, line: the non-empty ones of each row's lines, numbered within a sheet."""
    from pyspark.sql import Window

    spread = rows.select("sheet", *order, F.posexplode(F.filter(F.array(*lines), lambda x: x != "")).alias("nth", "line"))
    return spread.select("sheet", (F.row_number().over(Window.partitionBy("sheet").orderBy(*order, "nth")) - 1).alias("row_idx"), "line")


def _grid(rows: DataFrame, values) -> DataFrame:
    return rows.select(F.lit(0).cast("long").alias("file_idx"), F.lit("book.xlsx").alias("path"), F.col("sheet").cast("int").alias("sheet_idx"), F.concat(F.lit("S"), F.col("sheet")).alias("sheet"), F.col("row_idx").cast("int").alias("row_idx"), values.alias("values"))


# -- single columns --------------------------------------------------------------------------------------------------------


def single_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planted(spark, sf_dir)
    when = lambda test, text: F.when(test, text).otherwise("")
    heads = p.select("sheet", "city").distinct().select("*", F.lit(-1).cast("long").alias("id"))
    n = F.col("sheet")
    top = [F.upper("city"), when(n % 2 == 0, F.lit("Centre de référence")), when(n % 3 == 0, F.lit("Responsable : Pr DURAND Alain")), when(n % 4 == 0, F.lit("Adresse postale : 1 rue"))]
    w, s = F.col("w"), F.col("surname")
    name = F.concat(F.lit("NOM – PRENOM : "), F.when(w == 0, F.concat(s, F.lit(" Marie"))).when(w == 1, F.concat(F.lit("Pr "), s, F.lit(" Claire & MOREAU Julie"))).when(w == 2, "idem pédiatrie").when(w == 3, "pas de référent").when(w == 4, F.concat(s, F.lit(" Eva ou collègue"))).when(w == 6, F.concat(s, F.lit(" Luc ou idem"))).otherwise(""))
    has = w != 7
    details = [F.concat(F.lit("Hôpital de rattachement : CHU de "), "city", F.lit(" Adresse postale : : "), F.col("id").cast("string"), F.lit(" rue Y")), F.concat(F.lit("Téléphone : 04.77.82.81."), "nn"), F.concat(F.lit("Adresse mail : c"), F.col("id").cast("string"), F.lit("@chu.fr (secrétariat)"))]
    body = [F.col("heading"), F.col("sector_line"), when(has, name), *[when(has, d) for d in details], when(has & (F.col("id") % 3 == 0), F.lit("Consultation lundi"))]
    both = heads.select("sheet", "id", F.array(*top).alias("x")).unionByName(p.select("sheet", "id", F.array(*body).alias("x")))
    from pyspark.sql import Window

    spread = both.select("sheet", "id", F.posexplode(F.filter("x", lambda x: x != "")).alias("nth", "line"))
    numbered = spread.select("sheet", (F.row_number().over(Window.partitionBy("sheet").orderBy("id", "nth")) - 1).alias("row_idx"), "line")
    return _grid(numbered, F.array("line"))


def q_sheet_headers(spark, sf):
    sheets = layout.single_columns(single_sheets(spark, sf))[1]
    return sheets.select("sheet_idx", F.col("n_cells").cast("long").alias("n_cells"), "ville_text", "type_centre", "responsable", F.col("data_start").cast("long").alias("data_start"))


def q_sheet_flags(spark, sf):
    flags = layout.sheet_flags(*layout.single_columns(single_sheets(spark, sf)))
    return flags.select("sheet_idx", "numbered", "sectors", "idem", F.array_join("labels", ",").alias("labels"))


def _shown(records: DataFrame) -> DataFrame:
    marked = F.array_join(F.transform(F.map_entries("markers"), lambda e: F.concat(e["key"], F.lit("|"), e["value"]["kind"], F.lit("|"), e["value"]["comment"])), ",")
    return records.select(F.col("place.sheet").alias("sheet_idx"), *[f for f in dims.FIELDS if f != "date_import"], marked.alias("marked"))


def q_single_columns(spark, sf):
    return _shown(extract.from_single_columns(single_sheets(spark, sf))[0])


def q_single_columns_log(spark, sf):
    return extract.from_single_columns(single_sheets(spark, sf))[1].select(F.col("seq").alias("sheet_idx"), "message")


_SINGLE = f"""{_P}, c AS (
  SELECT *, CASE WHEN heading <> '' THEN id END AS h_id, CASE WHEN sector_line <> '' THEN sector WHEN inline <> '' THEN inline END AS z FROM p),
d AS (SELECT c.*, last_value(h_id IGNORE NULLS) OVER w AS section, coalesce(last_value(z IGNORE NULLS) OVER w, '') AS secteur FROM c WINDOW w AS (PARTITION BY sheet ORDER BY id)),
e AS (SELECT d.* EXCLUDE (spec, detail, how, src, titre, nom, prenom), coalesce(x.spec, '') AS spec, coalesce(x.detail, '') AS detail, coalesce(x.how, '') AS how, coalesce(x.src, '') AS src FROM d LEFT JOIN p x ON x.id = d.section WHERE d.w NOT IN (5, 7)),
f AS (
  SELECT *, 0 AS nth, CASE WHEN w = 1 THEN 'Pr' ELSE '' END AS titre, CASE WHEN w IN (2, 3) THEN '' ELSE surname END AS nom, CASE w WHEN 0 THEN 'Marie' WHEN 1 THEN 'Claire' WHEN 4 THEN 'Eva' WHEN 6 THEN 'Luc' ELSE '' END AS prenom,
    CASE w WHEN 2 THEN 'idem pédiatrie' WHEN 3 THEN 'pas de référent' WHEN 4 THEN 'ou collègue' WHEN 6 THEN surname || ' Luc ou idem' ELSE '' END AS remark FROM e
  UNION ALL SELECT *, 1, '', 'MOREAU', 'Julie', '' FROM e WHERE w = 1),
g AS (SELECT *, CASE WHEN id % 3 <> 0 THEN remark WHEN remark = '' THEN 'Consultation lundi' ELSE remark || ' ; Consultation lundi' END AS notes FROM f),
r AS (SELECT sheet, spec, arg_min({{'titre': titre, 'nom': nom, 'prenom': prenom}}, id * 2 + nth) AS ref FROM g WHERE secteur = 'Pediatrie' AND nom <> '' GROUP BY ALL),
t AS (SELECT g.*, ref, w = 2 AND ref IS NOT NULL AS takes FROM g LEFT JOIN r USING (sheet, spec))"""


# -- loose sheets, tables, documents ---------------------------------------------------------------------------------------


def q_loose_sheets(spark, sf):
    p = planted(spark, sf).groupBy("sheet", "city").agg(F.min("id").alias("id"), F.min_by("surname", "id").alias("surname"))
    who = F.element_at(F.split(F.initcap(F.regexp_replace("surname", "[ -]", "")), " "), 1)
    lines = [F.upper("city"), F.lit("Centre de compétence"), F.lit("Note"), F.lit("Autre"), F.concat(F.when(F.col("sheet") % 2 == 0, "Dr ").otherwise("Pr "), who, F.lit(" Paul, dermatologue")), F.concat(F.lit("contact c"), F.col("id").cast("string"), F.lit("@chu.fr")), F.when(F.col("sheet") % 3 == 0, "pédiatre et adulte").otherwise("patients adultes")]
    return _shown(extract.from_single_columns(_grid(_lines(p, ["id"], lines), F.array("line")))[0])


def _table_values(p: DataFrame, flipped) -> F.Column:
    first = F.when(F.col("id") % 2 == 0, "Anne").otherwise("")
    cells = [first, F.col("person"), F.concat(F.lit("05.34.55.84."), "nn"), F.col("label"), F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@x.fr (perso)")), F.concat(F.lit("CHU "), "city"), F.concat("city", F.when(F.col("id") % 4 == 0, " Nord").otherwise(""))]
    blank, unnamed = F.col("id") % 11 == 0, F.col("id") % 11 == 1
    cells = [F.when(blank | (unnamed & F.lit(i < 2)), "").otherwise(c) for i, c in enumerate(cells)]
    return F.when(flipped, F.array(cells[1], cells[0], *cells[2:])).otherwise(F.array(*cells))


def q_tables(spark, sf):
    """Sheets of columns: odd sheets have the first name right of the name; the header is in row 0 to 2."""
    p = planted(spark, sf)
    odd = F.col("sheet") % 2 == 1
    titles = F.when(odd, F.array(*map(F.lit, ["NOM – PRENOM", "Prénom", "Téléphone", "Discipline", "Courriel", "Etablissement", "Site"]))).otherwise(F.array(*map(F.lit, ["Prénom", "Nom", "Tel.", "Spécialité", "Adresse mail", "Hopital", "Ville"])))
    heads = p.select("sheet").distinct().select("sheet", (F.col("sheet") % 3).cast("long").alias("row_idx"), titles.alias("cells"))
    above = p.filter("sheet % 3 = 2").select("sheet").distinct().select("sheet", F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Liste"), F.lit("de 2026")).alias("cells"))
    data = p.select("sheet", (F.col("id") + 10).alias("row_idx"), _table_values(p, odd).alias("cells"))
    return _shown(extract.from_tables(_grid(heads.unionByName(above).unionByName(data), F.col("cells")), "Excel")[0])


def q_word_tables(spark, sf):
    """Documents of two tables; the first one's header names the columns of both, the second one's first row is skipped."""
    p = planted(spark, sf)
    head = F.array(*map(F.lit, ["Nom", "Prénom", "Tel.", "Spécialité", "Mail", "Service", "Ville"]))
    heads = p.select("sheet").distinct().crossJoin(spark.range(2).select(F.col("id").cast("int").alias("table"))).select("sheet", "table", F.lit(0).cast("long").alias("row_idx"), F.when(F.col("table") == 0, head).otherwise(F.reverse(head)).alias("cells"))
    data = p.select("sheet", (F.col("id") % 2).cast("int").alias("table"), (F.col("id") + 1).alias("row_idx"), _table_values(p, F.lit(True)).alias("cells"))
    grid = heads.unionByName(data).select(F.col("sheet").cast("long").alias("file_idx"), F.lit("d.docx").alias("path"), F.col("table").alias("sheet_idx"), F.lit("").alias("sheet"), F.col("row_idx").cast("int").alias("row_idx"), F.col("cells").alias("values"))
    found = extract.from_tables(grid, "Word")[0]
    return found.select(F.col("place.file").alias("file_idx"), *[f for f in _shown(found).columns if f not in ("sheet_idx", "marked")])


def _document(p: DataFrame, lines: F.Column) -> DataFrame:
    """lines: array of struct(style, text); one document for each nation."""
    from pyspark.sql import Window

    spread = p.select("sheet", "id", F.posexplode(lines).alias("nth", "x"))
    number = (F.row_number().over(Window.partitionBy("sheet").orderBy("id", "nth")) - 1).cast("int")
    return spread.select(F.col("sheet").cast("long").alias("file_idx"), F.lit("d.docx").alias("path"), F.lit("paragraph").alias("kind"), F.lit(0).alias("sheet_idx"), F.lit("").alias("sheet"), number.alias("row_idx"), F.col("x.style").alias("style"), F.array("x.text").alias("values"))


def _paragraph(style: str, *parts) -> F.Column:
    return F.struct(F.lit(style).alias("style"), F.concat(*[F.lit(x[1:]) if x.startswith("=") else F.col(x).cast("string") for x in parts]).alias("text"))


def sectioned(p: DataFrame, style: str) -> DataFrame:
    kind = F.col("id") % 4
    tail = [_paragraph("Normal", "=Tél : 04 72 00 00 ", "nn"), _paragraph("Normal", "=c", "id", "=@x.fr")]
    who = [
        F.when(kind == 0, _paragraph("Normal", "=Dr Anne Dupont (dermatologue), enfants")).when(kind == 1, _paragraph("Normal", "=Pr Luc ", "surname", "=, neurologue et Dr Eva MARTIN")).when(kind == 2, _paragraph("Normal", "=Référent cardiologie : Dr Julie Roy")).otherwise(_paragraph("Normal", "=", "surname", "= Julie, adultes"))
    ]
    return _document(p, F.array(_paragraph(style, "=CHU de ", "city"), *who, *tail))


def q_document_layouts(spark, sf):
    """Which documents are sectioned (by what style), tables or free text."""
    p = planted(spark, sf)
    n = F.col("file_idx") % 4
    words = sectioned(p, "X").withColumn("style", F.when((F.col("style") == "X") & (n == 0), "List Paragraph").when((F.col("style") == "X") & (n == 2), F.concat(F.lit("Heading "), (F.col("row_idx") % 8 + 1).cast("string"))).otherwise("Normal"))
    tables = words.filter((n == 1) | (F.col("file_idx") % 8 == 0)).withColumn("kind", F.lit("table")).withColumn("style", F.lit(""))
    by = layout.split_layouts(words.unionByName(tables))
    styled = by["sectioned"].select("file_idx", F.lit("sectioned").alias("layout"), "header_style").distinct()
    return styled.unionByName(by["tables"].select("file_idx", F.lit("tables").alias("layout"), F.lit("").alias("header_style")).distinct()).unionByName(by["free"].select("file_idx", F.lit("free").alias("layout"), F.lit("").alias("header_style")).distinct())


def q_document_sections(spark, sf):
    found = extract.from_sections(sectioned(planted(spark, sf), "List Paragraph").withColumn("header_style", F.lit("List Paragraph")))[0]
    return found.select(F.col("place.file").alias("file_idx"), *[f for f in _shown(found).columns if f not in ("sheet_idx", "marked")])


def q_document_flags(spark, sf):
    """Documents of one customer each; every third has no contact lines."""
    p = planted(spark, sf).select(F.col("id").alias("sheet"), F.lit(0).alias("id"), F.col("id").alias("n"), "surname", "nn")
    lines = F.array(_paragraph("Normal", "=Service"), F.when(F.col("n") % 2 == 0, _paragraph("Normal", "=Dr ", "surname")).otherwise(_paragraph("Normal", "=rien")), F.when(F.col("n") % 3 == 0, _paragraph("Normal", "=")).otherwise(_paragraph("Normal", "=02 98 00 00 ", "nn", "= c@x.fr")))
    return layout.document_flags(_document(p, lines)).select("file_idx", F.array_join("fields", ",").alias("fields"))


def q_title_and_phones(spark, sf):
    """Titles as written in one column, and all numbers of a text, each once."""
    from rostra.functions import text

    p = planted(spark, sf)
    number = F.concat(F.lit("+33 4 72 00 00 "), "nn")
    said = F.concat(F.lit("Appeler "), number, F.lit(", 04.72.00.00."), "nn", F.lit(" ou 0577000099 ; fax 123"))
    title = F.element_at(F.array(*map(F.lit, ["professeur", "Dr", "PR", "docteur", ""])), (F.col("id") % 5 + 1).cast("int"))
    return p.select("id", text.title_of(title).alias("title"), F.array_join(text.phones(said), "|").alias("phones"))


def q_union_stamp(spark, sf):
    """Records of two files together, numbered by file and place, each with its file's label."""
    p = planted(spark, sf)
    of = lambda file, name: extract.records(p.select("*", F.lit(file).alias("file_idx"), F.lit(0).alias("sheet_idx"), (F.lit(-1) * F.col("id")).alias("pos"), F.lit(0).alias("sub"), F.lit(0).alias("nth")).withColumn("place", extract.place()), nom=name, source=F.lit("Excel"))
    return stamped(layout.union(of(1, "surname"), of(0, "nom")), ["a.xlsx", "Import B"]).select("ordinal", "nom", "source")


def q_free_text(spark, sf):
    p = planted(spark, sf)
    body = F.concat(F.lit("Au CHU de "), "city", F.lit(", Dr Luc Morel, cardiologue, 02 98 00 00 "), "nn", F.lit(", c"), F.col("id").cast("string"), F.lit("@x.fr ; Pr Anne DUPONT, interne"))
    texts = p.select(F.col("id").alias("file_idx"), F.lit(0).alias("sheet_idx"), F.lit("freetext").alias("sheet"), F.lit("Word").alias("source"), F.when(F.col("id") % 9 == 0, " ").otherwise(body).alias("body"))
    found = extract.from_free_text(texts)[0]
    return found.select(F.col("place.file").alias("file_idx"), *[f for f in _shown(found).columns if f not in ("sheet_idx", "marked")])


# -- the fold on pairs -----------------------------------------------------------------------------------------------------

#: Two records of one name for each customer, whose fold has a closed form. Names are so far apart that no other two match.
PAIRS = """SELECT c_custkey AS id, c_custkey % 6 AS k, upper(md5(CAST(c_custkey AS VARCHAR(20)))) AS nom, 'Lyon' AS a_ville, 'CHU Lyon' AS a_hop, '04 77 82 81 18' AS a_tel,
  CASE c_custkey % 6 WHEN 1 THEN 'Nice' WHEN 3 THEN 'Lille' ELSE 'Lyon' END AS b_ville, CASE c_custkey % 6 WHEN 1 THEN 'CHU Nice' WHEN 2 THEN 'CHU Bron' WHEN 3 THEN '' ELSE 'CHU de Lyon' END AS b_hop,
  CASE c_custkey % 6 WHEN 0 THEN '05 34 55 84 58' ELSE '' END AS b_tel, 'c' || CAST(c_custkey AS VARCHAR(20)) || '@x.fr' AS b_mail, CASE c_custkey % 6 WHEN 4 THEN 'XY' ELSE '' END AS typo,
  CASE c_custkey % 6 WHEN 5 THEN 'UROLOGIE' ELSE 'NEPHROLOGIE' END AS b_spec, CASE c_custkey % 6 WHEN 1 THEN 'Muté en 2026' ELSE '' END AS b_notes, CASE c_custkey % 6 WHEN 4 THEN 'Eva' ELSE '' END AS b_prenom,
  CASE c_custkey % 6 WHEN 4 THEN '1 rue' ELSE '' END AS b_adr, CASE c_custkey % 6 WHEN 4 THEN '' ELSE '04 77 82 81 18' END AS first_tel
FROM customer"""
DAY = "2026-03-01"


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = spark.sql(PAIRS.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    full = lambda side, given: p.select((F.col("id") * 2 + side).alias("ordinal"), *[(given[f] if f in given else F.lit("")).alias(f) for f in dims.FIELDS], F.create_map().cast(MARKERS).alias("markers"))
    c = F.col
    a = full(0, {"ville": c("a_ville"), "region": F.lit("Auvergne-Rhone-Alpes"), "specialite": F.lit("NEPHROLOGIE"), "nom": c("nom"), "hopital": F.when(c("k") == 4, "").otherwise(c("a_hop")), "telephone": c("first_tel"), "source": F.lit("Import 1"), "date_import": F.lit("2026-01-01")})
    b = full(1, {"ville": c("b_ville"), "specialite": c("b_spec"), "nom": F.concat("nom", "typo"), "prenom": c("b_prenom"), "hopital": c("b_hop"), "adresse": c("b_adr"), "telephone": c("b_tel"), "email": c("b_mail"), "notes": c("b_notes"), "source": F.lit("Import 2"), "date_import": F.lit("2026-02-01")})
    return a, b


_FOLDED = ["ordinal", "ville", "region", "specialite", "nom", "prenom", "hopital", "adresse", "telephone", "email", "notes", "source", "date_import"]


def _marked(df: DataFrame) -> DataFrame:
    return df.select(*_FOLDED, F.coalesce(F.col("markers")["hopital"]["comment"], F.lit("")).alias("marked"))


def q_merge_pairs(spark, sf):
    a, b = pairs(spark, sf)
    return _marked(folding.fold(a.unionByName(b), None, DAY)[0])


def q_merge_pairs_log(spark, sf):
    a, b = pairs(spark, sf)
    return folding.fold(a.unionByName(b), None, DAY)[1].select("ordinal", "message")


def q_enrich_pairs(spark, sf):
    a, b = pairs(spark, sf)
    return _marked(folding.fold(b, a, DAY)[0])


def q_enrich_pairs_log(spark, sf):
    a, b = pairs(spark, sf)
    return folding.fold(b, a, DAY)[1].select("ordinal", "message")


QUERIES = {f.__name__: f for f in (q_sheet_headers, q_sheet_flags, q_document_flags, q_title_and_phones, q_union_stamp, q_single_columns, q_single_columns_log, q_loose_sheets, q_tables, q_word_tables, q_document_layouts, q_document_sections, q_free_text, q_merge_pairs, q_merge_pairs_log, q_enrich_pairs, q_enrich_pairs_log)}


# -- DuckDB ----------------------------------------------------------------------------------------------------------------


def _record(**given: str) -> str:
    return ", ".join(f"{given.get(f, chr(39) * 2)} AS {f}" for f in dims.FIELDS if f != "date_import")


_TABLE = {
    "region": "region", "ville": "city || CASE WHEN id % 4 = 0 THEN ' Nord' ELSE '' END", "specialite": "resolved", "titre": "titre", "nom": "nom", "hopital": "'CHU ' || city",
    "telephone": "'05 34 55 84 ' || nn", "email": "'c' || id || '@x.fr'",
}
_KEPT = "FROM p WHERE id % 11 > 1"


def _pair_sql(enriching: bool) -> str:
    """First record of each pair, then the second where it stays."""
    tel = "CASE WHEN k = 0 THEN b_tel ELSE first_tel END" if enriching else "first_tel"
    hop = "CASE k WHEN 0 THEN b_hop WHEN 4 THEN b_hop WHEN 1 THEN b_hop ELSE a_hop END" if enriching else "CASE WHEN k IN (1, 4) THEN b_hop ELSE a_hop END"
    date = f"CASE WHEN k IN ({'0, 1, 3, 4' if enriching else '1'}) THEN '{DAY}' ELSE '2026-01-01' END"
    conflict = "CASE WHEN k = 2 THEN 'Affiliation multiple possible — voir aussi CHU {}' ELSE {} END"
    return f"""WITH q AS ({PAIRS})
SELECT id * 2 AS ordinal, CASE WHEN k = 1 THEN b_ville ELSE a_ville END AS ville, CASE WHEN k = 1 THEN 'Provence-Alpes-Cote d''Azur' ELSE 'Auvergne-Rhone-Alpes' END AS region, 'NEPHROLOGIE' AS specialite, nom, b_prenom AS prenom, {hop} AS hopital,
  b_adr AS adresse, {tel} AS telephone, CASE WHEN k IN (2, 5) THEN '' ELSE b_mail END AS email, CASE k WHEN 1 THEN 'Transfere de Lyon (CHU Lyon)' WHEN 2 THEN 'Affiliation multiple possible — voir aussi CHU Bron' ELSE '' END AS notes,
  CASE WHEN k IN (2, 5) THEN 'Import 1' ELSE 'Import 1 + Import 2' END AS source, {date} AS date_import, CASE WHEN k = 2 THEN 'Conflit: voir aussi CHU Bron' ELSE '' END AS marked FROM q
UNION ALL SELECT id * 2 + 1, b_ville, '', b_spec, nom, '', b_hop, '', b_tel, b_mail, CASE WHEN k = 2 THEN 'Affiliation multiple possible — voir aussi CHU Lyon' ELSE '' END, 'Import 2', '2026-02-01', CASE WHEN k = 2 THEN 'Conflit: voir aussi CHU Lyon' ELSE '' END FROM q WHERE k IN (2, 5)"""


_SAID = f"""SELECT id * 2 + 1 AS ordinal, 'Transfert detecte :  ' || nom || '  (NEPHROLOGIE) : Lyon -> Nice' AS message FROM q WHERE k = 1
UNION ALL SELECT id * 2 + 1, '[Conflit hopital]  ' || nom || '  (NEPHROLOGIE): CHU Lyon et CHU Bron — revue manuelle requise' FROM q WHERE k = 2"""

SQL = {
    "q_sheet_headers": f"""{_P} SELECT sheet::INTEGER AS sheet_idx, (1 + (sheet % 2 = 0)::INTEGER + (sheet % 3 = 0)::INTEGER + (sheet % 4 = 0)::INTEGER + sum((heading <> '')::INTEGER + (sector_line <> '')::INTEGER + CASE WHEN w <> 7 THEN 4 + (id % 3 = 0)::INTEGER ELSE 0 END))::BIGINT AS n_cells,
  upper(any_value(city)) AS ville_text, CASE WHEN sheet % 2 = 0 THEN 'Centre de référence' ELSE '' END AS type_centre, CASE WHEN sheet % 3 = 0 THEN 'Pr DURAND Alain' ELSE '' END AS responsable,
  (1 + (sheet % 2 = 0)::INTEGER + (sheet % 3 = 0)::INTEGER + (sheet % 4 = 0)::INTEGER)::BIGINT AS data_start FROM p GROUP BY sheet""",
    "q_sheet_flags": f"""{_P} SELECT sheet::INTEGER AS sheet_idx, bool_or(regexp_matches(heading, '^[0-9]')) AS numbered, bool_or(sector_line <> '') AS sectors, bool_or(w IN (2, 6)) AS idem,
  array_to_string(list_filter([CASE WHEN bool_or(n AND w <> 7) THEN 'nom' END, CASE WHEN bool_or(h AND w <> 7) THEN 'hopital' END, CASE WHEN bool_or(h AND w <> 7) THEN 'adresse' END, CASE WHEN bool_or(t AND w <> 7) THEN 'telephone' END, CASE WHEN bool_or(m AND w <> 7) THEN 'email' END], lambda x: x IS NOT NULL), ',') AS labels
FROM (SELECT *, before + own < 30 AS n, before + own + 1 < 30 AS h, before + own + 2 < 30 AS t, before + own + 3 < 30 AS m FROM (SELECT *, (heading <> '')::INTEGER + (sector_line <> '')::INTEGER AS own,
  coalesce(sum((heading <> '')::INTEGER + (sector_line <> '')::INTEGER + CASE WHEN w <> 7 THEN 4 + (id % 3 = 0)::INTEGER ELSE 0 END) OVER (PARTITION BY sheet ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)) GROUP BY sheet""",
    "q_document_flags": f"""{_P} SELECT id AS file_idx, array_to_string(list_filter([CASE WHEN id % 2 = 0 THEN 'nom' END, CASE WHEN id % 3 <> 0 THEN 'telephone' END, CASE WHEN id % 3 <> 0 THEN 'email' END], lambda x: x IS NOT NULL), ',') AS fields FROM p""",
    "q_union_stamp": f"""{_P} SELECT row_number() OVER (ORDER BY id DESC) - 1 AS ordinal, nom, 'a.xlsx' AS source FROM p UNION ALL SELECT 68719476736 + row_number() OVER (ORDER BY id DESC) - 1, surname, 'Import B' FROM p""",
    "q_title_and_phones": f"""{_P} SELECT id, CASE id % 5 WHEN 0 THEN 'Pr' WHEN 2 THEN 'Pr' WHEN 4 THEN '' ELSE 'Dr' END AS title, '04 72 00 00 ' || nn || '|05 77 00 00 99' AS phones FROM p""",
    "q_single_columns": f"""{_SINGLE} SELECT sheet::BIGINT AS sheet_idx, {_record(region='region', ville='city', type_centre="CASE WHEN sheet % 2 = 0 THEN 'Centre de référence' ELSE '' END", responsable_centre="CASE WHEN sheet % 3 = 0 THEN 'Pr DURAND Alain' ELSE '' END",
      specialite='spec', specialite_detail='detail', secteur='secteur', titre='CASE WHEN takes THEN ref.titre ELSE titre END', nom='CASE WHEN takes THEN ref.nom ELSE nom END', prenom='CASE WHEN takes THEN ref.prenom ELSE prenom END', hopital="'CHU de ' || city",
      adresse="id || ' rue Y'", telephone="'04 77 82 81 ' || nn", email="'c' || id || '@chu.fr'", notes="CASE WHEN takes THEN 'Meme medecin que secteur Pediatrie' ELSE notes END", source="'Excel'")},
  CASE WHEN how <> '' THEN 'specialite|' || how || '|Resolu depuis: ' || src ELSE '' END AS marked FROM t WHERE takes OR nom <> '' OR notes <> ''""",
    "q_single_columns_log": f"{_SINGLE} SELECT sheet::BIGINT AS sheet_idx, '[S' || sheet || '] Reference ''idem pediatrie'' pour ' || spec || ' mais aucun medecin pediatrie trouve' AS message FROM t WHERE w = 2 AND NOT takes",
    "q_loose_sheets": f"""{_P}, s AS (SELECT sheet, any_value(city) AS city, any_value(region) AS region, min(id) AS id, arg_min(surname, id) AS surname FROM p GROUP BY sheet),
x AS (SELECT *, CASE WHEN sheet % 2 = 0 THEN 'Dr' ELSE 'Pr' END AS t, replace(replace(surname, ' ', ''), '-', '') AS n, CASE WHEN sheet % 3 = 0 THEN 'pédiatre et adulte' ELSE 'patients adultes' END AS last FROM s)
SELECT sheet::BIGINT AS sheet_idx, {_record(region='region', ville='city', type_centre="'Centre de compétence'", specialite="'DERMATOLOGIE'", secteur="CASE WHEN sheet % 3 = 0 THEN 'Pediatrie' ELSE 'Adulte' END", titre='t', nom='n', prenom="'Paul'", email="'c' || id || '@chu.fr'",
      notes="t || ' ' || upper(n[1]) || lower(n[2:]) || ' Paul, dermatologue contact c' || id || '@chu.fr ' || last", source="'Excel'")}, '' AS marked FROM x""",
    "q_tables": f"""{_P} SELECT sheet::BIGINT AS sheet_idx, {_record(**_TABLE, prenom="CASE WHEN sheet % 2 = 1 AND id % 2 = 0 THEN 'Anne' ELSE prenom END", source="'Excel'")}, '' AS marked {_KEPT}""",
    "q_word_tables": f"""{_P} SELECT sheet::BIGINT AS file_idx, {_record(**_TABLE, prenom="CASE WHEN id % 2 = 0 THEN 'Anne' ELSE prenom END", source="'Word'")} {_KEPT}""",
    "q_document_layouts": f"""{_P} SELECT DISTINCT sheet::BIGINT AS file_idx, CASE sheet % 4 WHEN 0 THEN 'sectioned' WHEN 1 THEN 'tables' WHEN 2 THEN 'sectioned' ELSE 'free' END AS layout, CASE sheet % 4 WHEN 0 THEN 'List Paragraph' WHEN 2 THEN 'Heading 1' ELSE '' END AS header_style FROM p""",
    "q_document_sections": f"""{_P}, x AS (
  SELECT *, 0 AS nth, CASE id % 4 WHEN 0 THEN 'Dr' WHEN 1 THEN 'Pr' WHEN 2 THEN 'Dr' ELSE '' END AS t, CASE id % 4 WHEN 0 THEN 'DUPONT' WHEN 2 THEN 'ROY' ELSE surname END AS n, CASE id % 4 WHEN 0 THEN 'Anne' WHEN 1 THEN 'Luc' ELSE 'Julie' END AS f FROM p
  UNION ALL SELECT *, 1, 'Dr', 'MARTIN', 'Eva' FROM p WHERE id % 4 = 1)
SELECT sheet::BIGINT AS file_idx, {_record(region='region', ville='city', specialite="CASE id % 4 WHEN 0 THEN 'DERMATOLOGIE' WHEN 1 THEN 'NEUROLOGIE' WHEN 2 THEN 'CARDIOLOGIE' ELSE '' END", secteur="CASE id % 4 WHEN 0 THEN 'Pediatrie' WHEN 3 THEN 'Adulte' ELSE '' END", titre='t', nom='n', prenom='f',
      telephone="'04 72 00 00 ' || nn", email="'c' || id || '@x.fr'", source="'Word'")} FROM x""",
    "q_free_text": f"""{_P}, x AS (SELECT *, 'Dr' AS t, 'MOREL' AS n, 'Luc' AS f FROM p UNION ALL SELECT *, 'Pr', 'DUPONT', 'Anne' FROM p)
SELECT id AS file_idx, {_record(region='region', ville="CASE WHEN city LIKE 'Paris%' THEN 'Paris' ELSE city END", specialite="'CARDIOLOGIE'", titre='t', nom='n', prenom='f', telephone="'02 98 00 00 ' || nn", email="'c' || id || '@x.fr'", source="'Word'")} FROM x WHERE id % 9 <> 0""",
    "q_merge_pairs": _pair_sql(False),
    "q_merge_pairs_log": f"""WITH q AS ({PAIRS}) {_SAID}
UNION ALL SELECT id * 2 + 1, 'Conflit pour ' || nom || '  (Lyon): hopital: ''CHU Lyon'' vs ''CHU de Lyon''' || CASE WHEN k = 0 THEN '; telephone: ''04 77 82 81 18'' vs ''05 34 55 84 58''' ELSE '' END FROM q WHERE k = 0""",
    "q_enrich_pairs": _pair_sql(True),
    "q_enrich_pairs_log": f"""WITH q AS ({PAIRS}) {_SAID}
UNION ALL SELECT id * 2 + 1, 'Mise a jour ' || nom || '  (Lyon): hopital: ''CHU Lyon'' -> ''CHU de Lyon''; telephone: ''04 77 82 81 18'' -> ''05 34 55 84 58''' FROM q WHERE k = 0
UNION ALL SELECT id * 2 + 1, 'Nouveau medecin ajoute :  ' || nom || '  (' || b_ville || ', ' || b_spec || ')' FROM q WHERE k = 5""",
}
