"""Extraction of records from the four layouts, with built-in expressions (specialties by sound apart)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.functions.names import is_upper, normalize_name, split_labels, split_names
from rostra.functions.specialty import classify
from rostra.functions.text import any_of, clean_email, detect_sector, emails, is_sector_line, lookup, normalize_phone, normalize_ville, phones, region_of, section_city, sector_value, text, title_case, title_of

from .layout import SHEET, _log, single_columns, table_headers, union
from .scratch import written

MARKERS = "map<string,struct<kind:string,comment:string>>"

# Patterns of the domain.
HEADING = r"(?U)^(\d+)\.?\s+(.*)"
NO_NAME = ["idem", "pas de référent", "pas de referent", "pas de correspondant"]
LOOSE_NAME = r"(?U)(Dr|Pr)\s+(\w[\w\-]+)\s+(\w[\w\-]+)"
TITLED = r"(?iU)(Dr|Pr|Professeur)\s+([\w\-À-ÿ]+(?:\s+[\w\-À-ÿ]+){0,3}?)(?=\s*[\(,;:\n]|\s+(?:et|&)\s|\s+(?:Service|Prise|Consultation|Tél%s)|\s*$)"
TITLED_IN_SECTION = TITLED % "|tél|Centre|prise|suivi|Suivi|de\\s+(?:dermato|neuro|pneumo|géné|néphro)"
TITLED_IN_TEXT = TITLED % ""
REFERENT = r"(?iU)(?:Référent|Référente|référent)\w*\s+(?:en\s+)?(?:\w+\s+)*?:\s*(Dr|Pr)?\s*([\w\-À-ÿ]+(?:\s+[\w\-À-ÿ]+)*)"
CAPITALS = r"(?U)\b([A-ZÀ-Ö]{2,})\s+([A-Za-zÀ-ÿ\-]+)\b"
LABELLED_PHONE = r"(?iU)(?:Tél\.?\s*(?:secrétariat\s*)?:?\s*|tél\s*:?\s*)([\d\s\.]+)"
BARE_PHONE = r"(?U)\b(0[\d\s\.]{9,14})\b"


def place(pos: str | int = "pos", sub: str | int = "sub", nth: str | int = "nth") -> Column:
    """Where a record stands: file, sheet, line, part of the line, name in the part. Records are numbered in this order."""
    at = lambda c, name: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("long").alias(name)
    return F.struct(at("file_idx", "file"), at("sheet_idx", "sheet"), at(pos, "pos"), at(sub, "sub"), at(nth, "nth"))


#: Records that a file may hold before its numbers run into the next file's.
FILE_ROOM = 1 << 36


def numbered(found: DataFrame) -> DataFrame:
    """records with `ordinal` in the order of their places, which they keep as `place`. Files are numbered apart."""
    within = F.row_number().over(Window.partitionBy("place.file").orderBy("place")).cast("long")
    return found.withColumn("ordinal", F.col("place.file") * FILE_ROOM + within - 1)


def records(df: DataFrame, **fields: Column | str) -> DataFrame:
    """place, all fields ('' where not given) and markers."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}
    markers = given.pop("markers", F.create_map().cast(MARKERS))
    return df.select("place", *[F.coalesce(given[f], F.lit("")).alias(f) if f in given else F.lit("").alias(f) for f in dims.FIELDS], markers.alias("markers"))


def first_specialty(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, specialite: of the first word that resolves."""
    words = df.select(*key, F.posexplode(F.split(F.lower(column), r"\s+")).alias("at", "word"))
    return classify(words, "word", many=True).filter("resolved.specialite is not null").groupBy(*key).agg(F.min_by("resolved.specialite", "at").alias("specialite"))


# -- tables ----------------------------------------------------------------------------------------------------------------


def from_tables(grid: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, log, rows of sheets without a header). Later columns win over earlier ones of the same field; a first-name
    column right of the name column overrides the name's own first name. source: `Excel` (each sheet has its header) or
    `Word` (the first table's first row heads all tables)."""
    word = source == "Word"
    head_of = grid.filter("sheet_idx = 0") if word else grid
    headers = table_headers(head_of, fixed=word)
    keys = ["file_idx"] if word else SHEET
    columns = headers.select(*keys, "header_row", "col", "field")
    starts = columns.select(*keys, "header_row").distinct()
    lost = grid.join(starts, keys, "left_anti")
    data = grid.join(starts, keys).filter("row_idx > header_row" if not word else "row_idx > 0").drop("header_row")
    cells = data.select(*SHEET, "row_idx", F.posexplode("values").alias("col", "value")).filter("value <> ''").join(columns.drop("header_row"), [*keys, "col"])
    at = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("col"))).alias(f)
    column = lambda f: F.max(F.when(F.col("field") == f, F.col("col"))).alias(f"{f}_at")
    fields = ["nom", "prenom", "hopital", "adresse", "telephone", "email", "specialite", "secteur", "ville"]
    rows = cells.groupBy(*SHEET, "row_idx").agg(*[at(f) for f in fields], column("nom"), column("prenom"))
    name = normalize_name("nom")
    own_first = (F.col("prenom_at") > F.coalesce("nom_at", F.lit(-1))).cast("boolean")
    shaped = classify(rows.withColumn("name", name).withColumn("place", place("row_idx", 0, 0)), "specialite")
    found = records(
        shaped,
        region=region_of("ville"),
        ville="ville",
        specialite=F.coalesce("resolved.specialite", F.upper("specialite")),
        secteur="secteur",
        titre="name.titre",
        nom="name.nom",
        prenom=F.when(own_first, F.col("prenom")).otherwise(F.col("name.prenom")),
        hopital="hopital",
        adresse="adresse",
        telephone=normalize_phone("telephone"),
        email=F.trim(F.regexp_replace(text("email"), r"\(.*?\)", "")),
        source=F.lit(source),
    )
    sheets = lost.select(*SHEET).distinct()
    what = F.lit("[Scanner/Word] Tableau sans en-tetes reconnus") if word else F.concat(F.lit("[Scanner/"), F.col("sheet"), F.lit("] Tableau multi-colonnes sans en-tetes reconnus"))
    return found.filter("nom <> '' or notes <> ''"), _log(sheets.filter("sheet_idx = 0") if word else sheets, what), lost


# -- single columns --------------------------------------------------------------------------------------------------------


def headings(cells: DataFrame) -> DataFrame:
    """cells with heading: null, or struct(specialite, detail, origin, sector) of the section that begins there. Numbered lines
    are headings; so are short lines without a colon that resolve."""
    number = F.col("text").rlike(HEADING)
    bare = F.trim(F.regexp_replace(F.trim("text"), ":+$", ""))
    short = (bare != "") & (F.length(bare) < 80) & ~F.contains(F.col("text"), F.lit(":"))
    tried = classify(cells.withColumn("_try", F.when(~number & short, bare).otherwise("")), "_try", "_alone")
    spec = F.when(number, F.trim(F.regexp_extract("text", HEADING, 2))).when(F.col("_alone.specialite").isNotNull(), F.col("_try"))
    inline = r"(?iU)\s+Secteur\s+(.*)"
    cut = tried.withColumn("_spec", spec).withColumn("_sector", F.when(F.col("_spec").rlike(inline), sector_value(F.regexp_extract("_spec", inline, 1))))
    cut = written(cut, "headings")  # what follows names these columns many times
    cut = cut.withColumn("_spec", F.when(F.col("_sector").isNotNull(), F.trim(F.regexp_replace("_spec", inline, ""))).otherwise(F.col("_spec")))
    parts = F.coalesce(*[F.when(F.contains(F.col("_spec"), F.lit(s)), F.struct(F.trim(F.substring_index("_spec", s, 1)).alias("name"), F.trim(F.expr(f"substring(_spec, locate('{s}', _spec) + {len(s)})")).alias("detail"))) for s in (", préciser :", ", préciser:", ":")], F.struct(F.col("_spec").alias("name"), F.lit("").alias("detail")))
    named = cut.withColumn("_parts", parts).withColumn("_name", F.when(F.col("_spec").isNotNull(), F.col("_parts.name"))).withColumn("_detail", F.when(F.col("_spec").isNotNull(), F.col("_parts.detail")))
    named = classify(classify(named, "_name", "_by_name"), "_detail", "_by_detail")
    upper = F.regexp_replace(F.trim(F.upper("_name")), ":+$", "")
    listed = lookup(upper, dims.HEADING_SPECIALTIES)
    first = F.coalesce(listed, "_by_name.specialite", upper)
    final = F.when((first == "AUTRE") & F.col("_by_detail.specialite").isNotNull(), F.col("_by_detail.specialite")).otherwise(first)
    origin = F.when(listed.isNull() & F.col("_by_name.method").isin("fuzzy", "phonetic"), F.struct(F.col("_by_name.method").alias("kind"), F.concat(F.lit("Resolu depuis: "), F.col("_name")).alias("comment")))
    heading = F.when(F.col("_spec").isNotNull(), F.struct(final.alias("specialite"), F.col("_detail").alias("detail"), origin.alias("origin"), F.col("_sector").alias("sector")))
    return named.select(*cells.columns, heading.alias("heading"))


def from_single_columns(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, log) of sheets with one column: a city header, then sections of labelled lines.

    Windows over a sheet's lines carry the section and the sector on and number the segments; a segment is a record if a
    name label with a value opens it. Sheets that give no record are read as free text.
    """
    cells, sheets = single_columns(grid)
    few = _log(sheets.filter("n_cells < 4"), F.concat(F.lit("["), F.col("sheet"), F.lit("] Trop peu de lignes ("), F.col("n_cells").cast("string"), F.lit(")")))
    usable = sheets.filter("n_cells >= 4").withColumn("ville", normalize_ville("ville_text")).withColumn("region", region_of("ville"))
    data = cells.join(usable.select(*SHEET, "data_start"), SHEET).filter("pos >= data_start").drop("data_start")
    lines = written(headings(data), "lines")
    pieces = F.when(F.col("heading").isNotNull(), F.array(F.struct(F.lit("heading").alias("label"), F.lit("").alias("value")))).otherwise(split_labels("text"))
    parts = lines.select(*SHEET, "pos", "heading", F.posexplode(pieces).alias("sub", "p")).select(*SHEET, "pos", "sub", "heading", F.col("p.label").alias("label"), F.trim("p.value").alias("value"))
    loose = F.col("label").isin("prefix", "raw")
    sector_line = (F.col("label") == "secteur") | (loose & is_sector_line("value"))
    sector = F.when(sector_line, sector_value(F.when(loose, F.regexp_extract("value", r"(?iU)^Secteur\s+(.*)", 1)).otherwise(F.col("value")))).otherwise(F.col("heading.sector"))
    bound = (F.col("label").isin("heading", "nom") | sector_line).cast("int")
    order = Window.partitionBy(*SHEET).orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = parts.select("*", F.last("heading", ignorenulls=True).over(order).alias("section"), F.last(sector, ignorenulls=True).over(order).alias("sector"), F.sum(bound).over(order).alias("segment"), sector_line.alias("is_sector"))
    mine = lambda label: F.max_by(F.when(F.col("label") == label, F.col("value")), F.when(F.col("label") == label, F.struct("pos", "sub"))).alias(label)
    opening = lambda c, name: F.min_by(c, F.when(F.col("label") == "nom", F.struct("pos", "sub"))).alias(name)
    said = F.when(loose & ~F.col("is_sector") & (F.col("value") != "") & (F.col("value") != ":"), F.struct("pos", "sub", "value"))
    segments = carried.groupBy(*SHEET, "segment").agg(
        opening(F.col("value"), "who"), opening(F.col("section"), "section"), opening(F.col("sector"), "sector"), opening(F.col("pos"), "pos"), opening(F.col("sub"), "sub"),
        mine("hopital"), mine("adresse"), mine("telephone"), mine("email"),
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["value"]), " ; ").alias("said"),
    ).filter("who <> ''")
    low = F.lower("who")
    vague = any_of(low, *NO_NAME)
    half = F.trim(F.substring_index("who", " ou ", 1))
    either = F.contains(F.col("who"), F.lit(" ou "))
    single = F.when(vague & F.contains(F.col("who"), F.lit("ou ")) & ~low.startswith("pas "), F.array(half)).when(vague, F.array(F.lit(""))).otherwise(split_names(F.when(either, half).otherwise(F.col("who"))))
    single = F.when(F.size(single) == 0, F.array(F.lit(""))).otherwise(single)
    remark = F.when(vague, F.col("who")).when(either, F.concat(F.lit("ou "), F.trim(F.expr("substring(who, locate(' ou ', who) + 4)")))).otherwise("")
    notes = F.array_join(F.filter(F.array(remark, text("said")), lambda x: x != ""), " ; ")
    segments = written(segments, "segments")
    people = segments.withColumn("notes", notes).select("*", F.posexplode(single).alias("nth", "one")).withColumn("name", normalize_name("one"))
    people = people.join(usable, SHEET).withColumn("place", place())
    marked = F.when(F.col("section.origin").isNotNull(), F.map_from_arrays(F.array(F.lit("specialite")), F.array("section.origin"))).otherwise(F.create_map().cast(MARKERS))
    found = records(
        people.withColumn("sheet_key", F.struct(*SHEET)),
        region="region", ville="ville", type_centre="type_centre", responsable_centre="responsable",
        specialite=F.col("section.specialite"), specialite_detail=F.col("section.detail"), secteur="sector",
        titre="name.titre", nom="name.nom", prenom="name.prenom", hopital="hopital", adresse=F.trim(F.regexp_replace(text("adresse"), "^:+", "")),
        telephone=normalize_phone("telephone"), email=clean_email("email"), notes="notes", source=F.lit("Excel"), markers=marked,
    )
    resolved, missing = resolve_idem(found.select("*", "place.file", F.col("place.sheet").alias("number")), usable.select("file_idx", "sheet_idx", "sheet", F.col("file_idx").alias("file"), F.col("sheet_idx").cast("long").alias("number")), ["file", "number"], "place")
    resolved = resolved.filter("nom <> '' or notes <> ''")
    told = resolved.select(F.col("file").alias("file_idx"), F.col("number").cast("int").alias("sheet_idx")).distinct()
    empty = usable.join(told, ["file_idx", "sheet_idx"], "left_anti")
    loose_records, loose_log = from_loose_text(cells, empty)
    return union(resolved.drop("file", "number"), loose_records), union(few, missing, loose_log)


def resolve_idem(found: DataFrame, sheets: DataFrame, sheet: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Nameless records that say `idem` take the identity of the sheet's first named paediatric record of their specialty. sheet: the
    columns of both tables that tell sheets apart."""
    borrowed = ["nom", "prenom", "titre", "hopital", "adresse", "telephone", "email"]
    first = found.filter("secteur = 'Pediatrie' and nom <> ''").groupBy(*sheet, "specialite").agg(F.min_by(F.struct(*borrowed), order).alias("ref"))
    joined = found.join(first, [*sheet, "specialite"], "left")
    idem = F.contains(F.lower("notes"), F.lit("idem")) & (F.col("nom") == "")
    takes = idem & F.col("ref").isNotNull()
    own = {f: F.when(takes, F.col(f"ref.{f}")).otherwise(F.col(f)) for f in borrowed[:3]}
    own |= {f: F.when(takes & (F.col(f) == ""), F.col(f"ref.{f}")).otherwise(F.col(f)) for f in borrowed[3:]}
    own["notes"] = F.when(takes, F.lit("Meme medecin que secteur Pediatrie")).otherwise(F.col("notes"))
    lost = joined.filter(idem & F.col("ref").isNull()).join(sheets.select(*{*sheet, "file_idx", "sheet_idx", "sheet"}), sheet)
    log = _log(lost, F.concat(F.lit("["), F.col("sheet"), F.lit("] Reference 'idem pediatrie' pour "), F.col("specialite"), F.lit(" mais aucun medecin pediatrie trouve")))
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in found.columns]), log


def from_loose_text(cells: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """At most one record of a sheet of loose lines: a titled name in the fifth line, details from there on."""
    body = cells.filter("pos >= 4").groupBy(*SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("body"))
    whole = sheets.join(body, SHEET, "left").withColumn("body", text("body"))
    spoken = first_specialty(whole, SHEET, "body")
    shaped = whole.join(spoken, SHEET, "left").withColumn("place", place(0, 0, 0))
    nom = F.upper(F.regexp_extract("fifth", LOOSE_NAME, 2))
    sector = F.when(F.lower("body").rlike("(?:neuro)?p[ée]diatre"), "Pediatrie").otherwise(detect_sector("body"))
    found = records(
        shaped, region="region", ville="ville", type_centre="type_centre", responsable_centre="responsable", specialite="specialite", secteur=sector,
        titre=title_of(F.regexp_extract("fifth", LOOSE_NAME, 1)), nom=nom, prenom=F.regexp_extract("fifth", LOOSE_NAME, 3),
        email=F.get(emails("body"), F.lit(0)), notes=F.substring("body", 1, 500), source=F.lit("Excel"),
    )
    none = shaped.filter(nom == "")
    return found.filter("nom <> ''"), _log(none, F.concat(F.lit("["), F.col("sheet"), F.lit("] Feuille en texte libre, aucun medecin extrait")))


# -- documents -------------------------------------------------------------------------------------------------------------


def _names(c: str, pattern: str, stop: list[str]) -> Column:
    """array<struct<title, name>> of all places where the pattern's two groups match."""
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("title"), F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda s: F.trim(s)).alias("name"))
    return F.filter(both, lambda x: (x["name"] != "") & ~F.lower(x["name"]).isin(stop))


def _person(name: Column) -> Column:
    """Given names first where no word is in capitals: the last word is then the surname."""
    words = F.split(name, r"\s+")
    parsed = normalize_name(name)
    swapped = (F.size(words) > 1) & ~F.exists(words, is_upper)
    given = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    return F.struct(F.when(swapped, F.upper(F.element_at(words, -1))).otherwise(parsed["nom"]).alias("nom"), F.when(swapped, given).otherwise(parsed["prenom"]).alias("prenom"))


def from_sections(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, log) of documents whose paragraphs of one style name cities; each block of text below gives one record per
    name found in it, all with the block's specialty, phones and e-mails. Text before the first city is dropped."""
    lines = paragraphs.select("file_idx", "row_idx", F.get("values", F.lit(0)).alias("text"), (F.col("style") == F.col("header_style")).alias("head")).filter("text <> ''")
    order = Window.partitionBy("file_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = lines.withColumn("block", F.sum(F.col("head").cast("int")).over(order)).filter("block > 0").groupBy("file_idx", "block").agg(
        F.max(F.when(F.col("head"), F.col("text"))).alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("row_idx", "text")))), lambda x: x["text"]), " ").alias("body"),
        F.count_if(~F.col("head")).alias("n"),
    ).filter("n > 0").withColumn("ville", section_city("header")).filter("ville <> ''")
    low = F.lower("body")
    hits = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(s)) for p, s in dims.SPECIALTY_PREFIXES.items()]), lambda x: x.isNotNull())))
    specialty = F.when(F.array_contains(hits, "DERMATOLOGIE"), "DERMATOLOGIE").otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit("")))
    of = lambda pattern: F.filter(F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), normalize_phone), lambda p: p != "")
    labelled = of(LABELLED_PHONE)
    numbers = F.concat(labelled, F.array_except(of(BARE_PHONE), labelled))
    titled = _names("body", TITLED_IN_SECTION, ["dr", "pr", "de", "du", "la", "le", "les", "des", "en"])
    referents = _names("body", REFERENT, ["de", "du", "la"])
    capitals = F.transform(F.regexp_extract_all("body", F.lit(CAPITALS), F.lit(0)), lambda x: F.struct(F.lit("").alias("title"), F.regexp_replace(x, r"(?U)\s+", " ").alias("name")))
    found = F.when(F.size(titled) > 0, titled).when(F.size(referents) > 0, referents).otherwise(capitals)
    shaped = blocks.select("*", found.alias("found"), specialty.alias("specialite"), detect_sector("body").alias("secteur"), F.array_join(numbers, " / ").alias("telephone"), F.array_join(emails("body"), " ; ").alias("email"))
    people = shaped.select("*", F.posexplode("found").alias("nth", "x")).withColumn("sheet_idx", F.lit(0)).withColumn("place", place("block", 0)).withColumn("who", _person(F.col("x.name")))
    out = records(people, region=region_of("ville"), ville="ville", specialite="specialite", secteur="secteur", titre=title_of("x.title"), nom="who.nom", prenom="who.prenom", telephone="telephone", email="email", source=F.lit("Word"))
    none = shaped.filter(F.size("found") == 0).withColumn("sheet_idx", F.col("block"))
    return out, _log(none, F.concat(F.lit("[Word] Aucun medecin extrait pour "), F.col("ville")))


def from_free_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, log). texts: file_idx, sheet_idx, sheet, source, body. One record per titled name, all with the first known
    city, the first word that resolves as a specialty, the first phone and the first e-mail."""
    key = ["file_idx", "sheet_idx"]
    # by number: short texts are few bytes and much work; again after the join, which may read its side by few tasks
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    full = dealt(texts.filter(F.trim("body") != ""))
    low = F.lower("body")
    city = F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in dims.REGIONS], F.lit(""))
    shaped = dealt(full.join(first_specialty(full, key, "body"), key, "left")).withColumn("ville", title_case(city)).withColumn("found", _names("body", TITLED_IN_TEXT, ["dr", "pr", "de", "du", "la", "le"]))
    people = shaped.select("*", F.posexplode("found").alias("nth", "x")).withColumn("place", place(0, 0)).withColumn("who", _person(F.col("x.name")))
    out = records(people, region=region_of("ville"), ville="ville", specialite="specialite", titre=title_of("x.title"), nom="who.nom", prenom="who.prenom", telephone=F.get(phones("body"), F.lit(0)), email=F.get(emails("body"), F.lit(0)), source="source")
    blank = _log(texts.filter(F.trim("body") == ""), F.concat(F.lit("["), F.col("sheet"), F.lit("] Aucun texte a analyser")))
    none = _log(shaped.filter(F.size("found") == 0), F.concat(F.lit("["), F.col("sheet"), F.lit("] Aucun medecin extrait du texte libre")))
    return out, union(blank, none)
