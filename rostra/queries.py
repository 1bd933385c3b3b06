"""Driver queries of the directory operators, and the same results as DuckDB SQL.

The driver's tables hold no practitioners, so both sides start from DOCTORS, one SELECT that Spark and DuckDB read alike: each
customer becomes a record with planted spellings, blanks, phones and notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.file_queries import PERSONS
from rostra.functions import dims, names, specialty, text
from rostra.operators import fold as folding
from rostra.operators import infer as inferring
from rostra.operators import match, report
from rostra.plans.extract import MARKERS, resolve_idem
from rostra.plans.pipeline import consolidate, enrich, named_count

_CITIES = [k.title() for k in dims.REGIONS]
_NAMES = ["BERNARD", "PÉRIVIER", "LE GALL", "DUMOULIN", "FAURE", "GARCIA", "HARAMBAT", "ISIDOR", "JOUBERT", "KLEIN", "LEFORT", "MOREAU", "NIVELLE", "OLLIVIER", "PETIT-JEAN", "QUENTIN", "RIGOTHIER", "SCHNEIDER", "THÉVENOT", "VASSEUR"]
_PEOPLE = [p[0] for p in PERSONS]
#: Which of them begin with a first name.
_FIRST = [p[0] for p in PERSONS if p[0].split()[0] in ("Jean", "Mathilde", "Valentin", "Raphael", "Pierre", "Jean-Marc")]
_LABELS = ["Dermatologues", "dermathologue", "nephrologie :", "cardio pediatrique", "XYZABC", "", "Neurologie", "PSYCHIATRES", "Génétique", "pneumologuee", "ophtalmologie", "Autres spécialités", "nefrologie"]


def _values(items: list[str], alias: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(items)) + f") AS {alias}(k, x)"


DOCTORS = f"""
SELECT c.c_custkey AS ordinal,
  v.x || CASE WHEN c.c_custkey % 13 = 3 THEN ' Nord' ELSE '' END AS ville,
  l.x AS label,
  s.x || CASE c.c_custkey % 7 WHEN 1 THEN 'X' WHEN 2 THEN '-' WHEN 3 THEN 'ZZZZ' ELSE '' END AS nom,
  p.x AS person,
  CASE c.c_custkey % 5 WHEN 0 THEN 'CHU de ' || v.x WHEN 1 THEN 'CHRU ' || v.x WHEN 2 THEN 'Hôpital ' || v.x || ' Sud' WHEN 3 THEN '' ELSE 'Centre Hospitalier de ' || v.x END AS hopital,
  CASE WHEN c.c_custkey % 4 = 0 OR c.c_custkey % 37 > 20 THEN '' ELSE '1 rue ' || v.x END AS adresse,
  CASE c.c_custkey % 8 WHEN 0 THEN '0477828118' WHEN 1 THEN '05.34.55.84.58' WHEN 2 THEN '+33 5 34 55 74 23' WHEN 3 THEN 'pas de telephone' WHEN 4 THEN '(secrétariat) 04 72 00 00 01 / 04 72 00 00 02' WHEN 5 THEN '0477828118 ou 0477828118' ELSE '' END AS telephone,
  CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE 'c' || CAST(c.c_custkey % 40 AS VARCHAR(9)) || '@chu.fr' END AS email,
  CASE c.c_custkey % 17 WHEN 0 THEN 'Tel secretariat' WHEN 1 THEN 'Transféré depuis Toulouse' WHEN 2 THEN 'idem pediatrie' WHEN 3 THEN 'Mute en 2026' ELSE '' END AS notes,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Import 1 + Manuel' ELSE 'Import 1' END AS source,
  CASE c.c_custkey % 6 WHEN 0 THEN 'Pédiatrie :' WHEN 1 THEN 'Adulte' WHEN 2 THEN 'enfants et adultes' WHEN 3 THEN '' WHEN 4 THEN 'ado' ELSE 'Mixte' END AS secteur
FROM customer c
JOIN {_values(_CITIES, 'v')} ON v.k = c.c_nationkey
JOIN {_values(_NAMES, 's')} ON s.k = (c.c_custkey * 7) % {len(_NAMES)}
JOIN {_values(_PEOPLE, 'p')} ON p.k = c.c_custkey % {len(_PEOPLE)}
JOIN {_values(_LABELS, 'l')} ON l.k = c.c_custkey % {len(_LABELS)}"""


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.sql(DOCTORS.replace("FROM customer c", "FROM {customer} c"), customer=customer)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doctors as full records: specialty resolved, phone normalised, region looked up."""
    d = specialty.classify(doctors(spark, sf_dir), "label")
    cols = {
        "ville": F.col("ville"), "region": text.region_of("ville"), "specialite": F.coalesce("resolved.specialite", F.upper("label")), "secteur": text.sector_value("secteur"),
        "nom": F.col("nom"), "prenom": F.substring("person", 1, 5), "hopital": F.col("hopital"), "adresse": F.col("adresse"), "telephone": text.normalize_phone("telephone"),
        "email": F.col("email"), "notes": F.col("notes"), "source": F.col("source"), "date_import": F.lit("2026-01-01"),
    }
    return d.select("ordinal", *[cols.get(f, F.lit("")).alias(f) for f in dims.FIELDS], F.create_map().cast(MARKERS).alias("markers"))


def _q(expr):
    return lambda spark, sf: doctors(spark, sf).select("ordinal", *expr())


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def q_emails(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(text.emails("text"), "|").alias("emails"))


def q_edit_pairs(spark, sf):
    keys = doctors(spark, sf).select(text.compare_key("nom").alias("k"))
    return match.name_pairs(keys).select("a", "b", F.col("distance").cast("int").alias("distance"))


def q_match_best(spark, sf):
    r = records(spark, sf)
    return match.best_match(r, r, True, True).select("ordinal", "match", F.col("distance").cast("int").alias("distance"))


def q_components(spark, sf):
    keys = doctors(spark, sf).select(text.compare_key("nom").alias("k")).distinct()
    pairs = match.name_pairs(keys)
    ids = keys.select("k", F.xxhash64("k").alias("i"))
    edges = pairs.join(ids.toDF("a", "u"), "a").join(ids.toDF("b", "v"), "b").select("u", "v")
    labels = match.min_labels(edges)
    grouped = ids.join(labels, ids["i"] == labels["u"], "left").select("k", F.coalesce("label", "i").alias("g"))
    first = grouped.groupBy("g").agg(F.min("k").alias("first_key"), F.count(F.lit(1)).alias("members"))
    return grouped.join(first, "g").select("k", "first_key", "members")


def _shared(spark, sf):
    return inferring.shared_values(records(spark, sf)).select(
        F.col("site.city").alias("city"), F.col("site.hospital").alias("hospital"), "members",
        *[F.coalesce(F.array_join(f"s_{f}", "|"), F.lit("")).alias(f) for f in inferring.INFERRED],
    )


def q_infer(spark, sf):
    done, _ = inferring.infer(records(spark, sf))
    kinds = F.array_join(F.array_sort(F.map_keys("markers")), ",")
    return done.select("ordinal", *inferring.INFERRED, "notes", kinds.alias("marked"))


def q_infer_log(spark, sf):
    return inferring.infer(records(spark, sf))[1].select("ordinal", "message")


def q_crosstab_long(spark, sf):
    return report.crosstab_long(records(spark, sf))


def q_crosstab(spark, sf):
    return report.crosstab(records(spark, sf))


def q_sorted_directory(spark, sf):
    return report.sorted_directory(records(spark, sf)).select("ordinal", "ville", "specialite", "secteur", "nom", "row_soft")


def q_merge_all(spark, sf):
    return consolidate(records(spark, sf), "2026-03-01")[0].select("ordinal", *dims.FIELDS)


def q_merge_log(spark, sf):
    return consolidate(records(spark, sf), "2026-03-01")[1]


def q_enrich(spark, sf):
    r = records(spark, sf)
    return enrich(r.filter("ordinal % 3 = 0"), r.filter("ordinal % 3 <> 0"), "2026-03-01")[0].select("ordinal", *dims.FIELDS)


def q_component_fold_keys(spark, sf):
    """How large the independent parts of the fold are."""
    return folding.match_groups(records(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("parts"))


def q_idem(spark, sf):
    r = records(spark, sf).withColumn("nom", F.when(F.col("notes") == "idem pediatrie", "").otherwise(F.col("nom"))).withColumn("number", F.col("ordinal") % 10)
    sheets = r.select("number").distinct().select("number", F.lit(0).cast("long").alias("file_idx"), F.col("number").cast("int").alias("sheet_idx"), F.lit("s").alias("sheet"))
    return resolve_idem(r, sheets, ["number"], "ordinal")[0].select("ordinal", "nom", "notes", "hopital")


def q_label_split(spark, sf):
    cell = F.concat(F.lit("Note NOM – PRENOM : "), "person", F.lit(" Hôpital de rattachement : "), "hopital", F.lit(" Téléphone : "), "telephone", F.lit(" Adresse mail : "), "email")
    parts = doctors(spark, sf).select("ordinal", F.posexplode(names.split_labels(cell)).alias("nth", "p"))
    return parts.select("ordinal", "nth", "p.label", "p.value")


def q_header_fields(spark, sf):
    from rostra.plans.layout import header_field

    labels = spark.createDataFrame([(x,) for x in ["NOM – PRENOM", "Prénom", "Tel.", "Adresse mail", "Adresse", "Service", "xyz", "", "Site", "Spécialité", "Centre hospitalier"]], "label string")
    return labels.select("label", F.coalesce(header_field("label"), F.lit("")).alias("field"))


def q_specialty_all(spark, sf):
    d = specialty.classify(doctors(spark, sf), "label")
    return d.select("ordinal", "resolved.specialite", "resolved.method")


def q_split_names(spark, sf):
    cell = F.concat_ws(" - ", "person", F.concat(F.lit("MOREAU Julie & "), "nom"))
    return doctors(spark, sf).select("ordinal", F.array_join(names.split_names(cell), "|").alias("names"))


QUERIES = {
    "q_clean_text": lambda s, d: _documents(s, d).select("doc_id", text.clean_text("text").alias("clean")),
    "q_strip_accents": lambda s, d: _documents(s, d).select("doc_id", text.strip_accents("text").alias("plain")),
    "q_emails": q_emails,
    "q_phone_normalized": _q(lambda: [text.normalize_phone("telephone").alias("phone")]),
    "q_name_keys": _q(lambda: [text.compare_key("nom").alias("name_key"), text.dedup_key("ville", "nom", "label")["ville"].alias("city_key")]),
    "q_dedup_exact": lambda s, d: doctors(s, d).groupBy(text.dedup_key("ville", "nom", "label").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).select("k.ville", "k.nom", "k.specialite", "n", "first"),
    "q_hospital_key": _q(lambda: [text.hospital_key("hopital").alias("hospital")]),
    "q_edit_pairs": q_edit_pairs,
    "q_region_lookup": _q(lambda: [text.region_of("ville").alias("region")]),
    "q_specialty_native": _q(lambda: [F.coalesce(specialty.classify_native("label")["specialite"], F.lit("")).alias("specialite"), F.coalesce(specialty.classify_native("label")["method"], F.lit("")).alias("method")]),
    "q_specialty_phonetic": q_specialty_all,
    "q_name_parse": _q(lambda: [names.normalize_name("person")[k].alias(k) for k in ("titre", "nom", "prenom")]),
    "q_first_name": _q(lambda: [names.is_first_name(F.substring_index("person", " ", 1)).alias("is_first")]),
    "q_split_names": q_split_names,
    "q_label_split": q_label_split,
    "q_header_fields": q_header_fields,
    "q_sector": _q(lambda: [text.sector_value("secteur").alias("sector"), text.detect_sector("secteur").alias("detected")]),
    "q_title_city": _q(lambda: [text.normalize_ville(F.upper("ville")).alias("city"), text.normalize_city("hopital").alias("bare")]),
    "q_completeness": _q(lambda: [text.completeness("nom", "hopital", "adresse", "telephone", "email").cast("int").alias("score")]),
    "q_source_union": _q(lambda: [text.union_sources("source", F.when(F.col("ordinal") % 3 == 0, "Annuaire").otherwise("")).alias("sources")]),
    "q_transfer": _q(lambda: [text.is_transfer("notes", "source").alias("transfer")]),
    "q_crosstab_long": q_crosstab_long,
    "q_crosstab": q_crosstab,
    "q_totals": lambda s, d: named_count(records(s, d)),
    "q_sorted_directory": q_sorted_directory,
    "q_shared_values": _shared,
    "q_infer": q_infer,
    "q_infer_log": q_infer_log,
    "q_match_best": q_match_best,
    "q_components": q_components,
    "q_component_sizes": q_component_fold_keys,
    "q_idem": q_idem,
    "q_merge_all": q_merge_all,
    "q_merge_log": q_merge_log,
    "q_enrich": q_enrich,
}

# -- DuckDB ----------------------------------------------------------------------------------------------------------------

_D = f"WITH d AS ({DOCTORS})"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), '[\s\x0B\x1c-\x1f]+', ' ', 'g'))"


def _key(x: str) -> str:
    return f"replace(replace(strip_accents(upper({x})), '-', ''), ' ', '')"


def _hospital(x: str) -> str:
    kind = r"\b(?:chu|chru|hopital|hopitaux|centre\s+hospitalier|centre\s+de\s+reference|centre\s+de\s+competence)\b"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '{kind}', ' ', 'g'), '\bd[''\s]', ' ', 'g'), '\bde\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _phone(x: str) -> str:
    bare = rf"regexp_replace({_clean(x)}, '(?i)\(?(?:secrétariat|secretariat|accueil|standard|rdv)\b\)?', '', 'g')"
    digits = r"regexp_replace(m, '\D', '', 'g')"
    national = f"CASE WHEN {digits} LIKE '33%' AND length({digits}) >= 11 THEN '0' || substr({digits}, 3) ELSE {digits} END"
    ten = rf"CASE WHEN length({national}) >= 10 AND substr({national}, 1, 1) = '0' THEN trim(regexp_replace(substr({national}, 1, 10), '(..)', '\1 ', 'g')) END"
    found = rf"list_filter(list_transform(regexp_extract_all({bare}, '(?:\+33\s*[\s.\-]?\s*|0)[\d\s.\-]{{8,}}'), lambda m: {ten}), lambda p: p IS NOT NULL)"
    return f"array_to_string(list_transform(list_sort(list_transform(list_distinct({found}), lambda p: {{'i': list_position({found}, p), 'p': p}})), lambda s: s.p), ' / ')"


def _sq(x: str) -> str:
    return x.replace("'", "''")


_REGION_ROWS = ", ".join(f"({i}, '{_sq(k)}', '{_sq(v)}')" for i, (k, v) in enumerate(dims.REGIONS.items()))


def _specialty(x: str, heard: bool = True) -> str:
    """CASE giving specialty|method of a label; heard: with the one planted label that resolves by sound only."""
    key = f"trim(regexp_replace(strip_accents(lower(trim({x}))), ':+$', ''))"
    cases = [f"WHEN {key} = '{k}' THEN '{v}|exact'" for k, v in dims.SPECIALTIES.items()]
    cases += [f"WHEN starts_with({key}, '{p}') THEN '{v}|prefix'" for p, v in dims.SPECIALTY_PREFIXES.items()]
    cases += [f"WHEN length({key}) >= {len(p)} AND levenshtein(substr({key}, 1, {len(p)}), '{p}') <= 1 THEN '{v}|fuzzy'" for p, v in dims.SPECIALTY_PREFIXES.items() if len(p) >= 6]
    cases += [f"WHEN {key} = 'nefrologie' THEN 'NEPHROLOGIE|phonetic'"] * heard
    return f"CASE WHEN {x} = '' THEN '|' " + " ".join(cases) + " ELSE '|' END"


_SECTOR = """CASE WHEN contains(low, 'adulte') AND (contains(low, 'péd') OR contains(low, 'ped') OR contains(low, 'enfant')) THEN 'Pediatrie et Adulte'
  WHEN contains(low, 'péd') OR contains(low, 'ped') OR contains(low, 'enfant') OR contains(low, 'ado') THEN 'Pediatrie'
  WHEN contains(low, 'adulte') THEN 'Adulte' WHEN t = '' THEN 'Non precise' ELSE t END"""
_R = f"""{_D}, e AS (SELECT *, trim(regexp_replace(trim(secteur), ':+$', '')) AS t, lower(trim(regexp_replace(trim(secteur), ':+$', ''))) AS low, {_specialty('label')} AS sm FROM d),
r AS (SELECT ordinal, ville, CASE WHEN sm = '|' THEN upper(label) ELSE string_split(sm, '|')[1] END AS specialite, {_SECTOR} AS secteur, nom, hopital, adresse, {_phone('telephone')} AS telephone, email, notes, source FROM e)"""
_SITES = f"""{_R}, m AS (SELECT *, trim(strip_accents(lower(ville))) AS city, {_hospital('hopital')} AS hospital, regexp_matches(notes || ' ' || adresse, '(?i)secretariat|accueil|standard') AS hint FROM r),
g AS (SELECT city, hospital, count(*) AS members, arg_min(hopital, ordinal) AS display, min(ordinal) AS first_ordinal FROM m WHERE hospital <> '' GROUP BY 1, 2 HAVING count(*) > 1),
x AS (SELECT city, hospital, hint, unnest([{{'f': 'adresse', 'v': trim(adresse)}}, {{'f': 'telephone', 'v': trim(telephone)}}, {{'f': 'email', 'v': trim(email)}}]) AS fv FROM m),
c AS (SELECT city, hospital, fv.f AS f, fv.v AS v, count(*) AS n, bool_or(hint) AS lab FROM x WHERE fv.v <> '' GROUP BY 1, 2, 3, 4),
p AS (SELECT city, hospital, f, CASE WHEN f = 'adresse' THEN list_sort(list(v)) WHEN bool_or(lab) THEN list_sort(list(v) FILTER (lab)) ELSE list_sort(list(v) FILTER (n >= 2)) END AS vs FROM c GROUP BY 1, 2, 3),
s AS (SELECT g.*, coalesce(a.vs, []) AS s_adresse, coalesce(t.vs, []) AS s_telephone, coalesce(e.vs, []) AS s_email FROM g
  LEFT JOIN p a ON a.city = g.city AND a.hospital = g.hospital AND a.f = 'adresse' LEFT JOIN p t ON t.city = g.city AND t.hospital = g.hospital AND t.f = 'telephone' LEFT JOIN p e ON e.city = g.city AND e.hospital = g.hospital AND e.f = 'email')"""


def _fill(f: str) -> str:
    return f"({f} = '' AND len(s_{f}) = 1)"


_NOTE = "infere depuis secretariat ' || display"
_PAIRS = f"""{_D}, k AS (SELECT DISTINCT {_key('nom')} AS k FROM d), pairs AS (SELECT a.k AS a, b.k AS b, levenshtein(a.k, b.k)::INTEGER AS distance FROM k a JOIN k b ON a.k < b.k AND a.k <> '' AND levenshtein(a.k, b.k) <= 2)"""

SQL = {
    "q_clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "q_strip_accents": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
    "q_emails": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\pL\pN\pM_.\-]+@[\pL\pN\pM_.\-]+\.[\pL\pN\pM_]+'), '|') AS emails FROM documents",
    "q_phone_normalized": f"{_D} SELECT ordinal, {_phone('telephone')} AS phone FROM d",
    "q_name_keys": f"{_D} SELECT ordinal, {_key('nom')} AS name_key, strip_accents(upper(ville)) AS city_key FROM d",
    "q_dedup_exact": f"{_D} SELECT strip_accents(upper(ville)) AS ville, {_key('nom')} AS nom, label AS specialite, count(*) AS n, min(ordinal) AS first FROM d GROUP BY 1, 2, 3",
    "q_hospital_key": f"{_D} SELECT ordinal, {_hospital('hopital')} AS hospital FROM d",
    "q_edit_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "q_region_lookup": f"""{_D}, t(i, k, v) AS (VALUES {_REGION_ROWS}), x AS (SELECT ordinal, trim(lower(ville)) AS c FROM d)
SELECT ordinal, coalesce(arg_min(v, CASE WHEN k = c THEN -1 ELSE i END) FILTER (starts_with(c, k) OR starts_with(k, c)), '') AS region FROM x CROSS JOIN t GROUP BY ordinal""",
    "q_specialty_native": f"{_D} SELECT ordinal, string_split({_specialty('label', False)}, '|')[1] AS specialite, string_split({_specialty('label', False)}, '|')[2] AS method FROM d",
    "q_specialty_phonetic": f"{_D} SELECT ordinal, nullif(string_split({_specialty('label')}, '|')[1], '') AS specialite, nullif(string_split({_specialty('label')}, '|')[2], '') AS method FROM d",
    # what each person must give is stated by hand, not read from the lexicon
    "q_name_parse": f"""{_D}, x(person, titre, nom, prenom) AS (VALUES {", ".join("('" + "', '".join(p) + "')" for p in PERSONS)}) SELECT ordinal, titre, x.nom AS nom, prenom FROM d JOIN x USING (person)""",
    "q_first_name": f"""{_D} SELECT ordinal, person IN ({", ".join(f"'{p}'" for p in _FIRST)}) AS is_first FROM d""",
    "q_split_names": f"""{_D} SELECT ordinal, person || '|MOREAU Julie' || CASE WHEN contains(nom, ' ') THEN '|' ELSE ', ' END || nom AS names FROM d""",
    "q_component_sizes": _R.replace("WITH d", "WITH RECURSIVE d", 1) + f""", n AS (SELECT DISTINCT {_key('nom')} AS k, specialite AS s, {_key('nom')} || '|' || specialite AS i FROM r),
ed AS (SELECT a.i AS x, b.i AS y FROM n a JOIN n b ON a.i <> b.i AND abs(length(a.k) - length(b.k)) <= 2 AND levenshtein(a.k, b.k) <= 2 AND (a.s = b.s OR a.s = '' OR b.s = '')),
reach(x, y) AS (SELECT i, i FROM n UNION SELECT reach.x, ed.y FROM reach JOIN ed ON ed.x = reach.y),
c AS (SELECT x AS i, min(y) AS first FROM reach GROUP BY x)
SELECT members, count(*) AS parts FROM (SELECT first, count(*) AS members FROM r JOIN c ON c.i = {_key('nom')} || '|' || specialite GROUP BY first) GROUP BY members""",
    "q_label_split": f"""{_D}, a AS (SELECT ordinal, unnest([{{'nth': 0, 'label': 'prefix', 'value': 'Note'}}, {{'nth': 1, 'label': 'nom', 'value': person}}, {{'nth': 2, 'label': 'hopital', 'value': hopital}}, {{'nth': 3, 'label': 'telephone', 'value': telephone}}, {{'nth': 4, 'label': 'email', 'value': email}}]) AS x FROM d)
SELECT ordinal, x.nth AS nth, x.label AS label, x.value AS value FROM a""",
    "q_header_fields": "SELECT * FROM (VALUES ('NOM – PRENOM', 'nom'), ('Prénom', 'prenom'), ('Tel.', 'telephone'), ('Adresse mail', 'email'), ('Adresse', 'adresse'), ('Service', 'hopital'), ('xyz', ''), ('', ''), ('Site', 'ville'), ('Spécialité', 'specialite'), ('Centre hospitalier', 'hopital')) t(label, field)",
    "q_sector": f"""{_D}, e AS (SELECT ordinal, lower(secteur) AS full_low, trim(regexp_replace(trim(secteur), ':+$', '')) AS t, lower(trim(regexp_replace(trim(secteur), ':+$', ''))) AS low FROM d)
SELECT ordinal, {_SECTOR} AS sector, CASE WHEN child AND adult THEN 'Pediatrie et Adulte' WHEN child THEN 'Pediatrie' WHEN adult THEN 'Adulte' ELSE '' END AS detected
FROM (SELECT *, contains(full_low, 'enfant') OR contains(full_low, 'pédiat') OR contains(full_low, 'pediatr') AS child, contains(full_low, 'adulte') AS adult FROM e)""",
    "q_title_city": f"""{_D} SELECT ordinal, ville AS city, trim(regexp_replace(hopital, '(?i)^(?:CHU\\s+(?:de\\s+)?|CHRU\\s+(?:de\\s+)?|Centre\\s+Hospitalier\\s+(?:de\\s+)?|Hôpital\\s+|Hopital\\s+)', '')) AS bare FROM d""",
    "q_completeness": f"{_D} SELECT ordinal, (nom <> '')::INTEGER + (hopital <> '')::INTEGER + (adresse <> '')::INTEGER + (telephone <> '')::INTEGER + (email <> '')::INTEGER AS score FROM d",
    "q_source_union": f"{_D} SELECT ordinal, CASE WHEN ordinal % 3 <> 0 THEN source ELSE array_to_string(list_sort(list_append(string_split(source, ' + '), 'Annuaire')), ' + ') END AS sources FROM d",
    "q_transfer": f"{_D} SELECT ordinal, regexp_matches(strip_accents(notes || ' ' || source), '(?i)transfer[eé]+\\s+(?:de|depuis)\\b|\\bmut[eé]+\\b|ancienn?e?\\s+affect') AS transfer FROM d",
    "q_crosstab_long": f"""{_R} SELECT CASE WHEN grouping(ville) = 1 THEN 'TOTAL' ELSE ville END AS ville, CASE WHEN grouping(specialite) = 1 THEN 'Total' ELSE specialite END AS specialite, count(*) FILTER (nom <> '') AS named
FROM r GROUP BY CUBE (ville, specialite) HAVING grouping(specialite) = 1 OR specialite <> ''""",
    "q_crosstab": f"""{_R}, c AS (SELECT ville, count(*) FILTER (nom <> '') AS "Total", {", ".join(f"nullif(count(*) FILTER (nom <> '' AND specialite = '{x}'), 0) AS \"{x}\"" for x in [*dims.SPECIALTY_ORDER[:5], *dims.SPECIALTY_ORDER[5:8], "AUTRE", "XYZABC"])} FROM r GROUP BY ville)
SELECT * FROM c UNION ALL SELECT 'TOTAL', sum("Total")::BIGINT, {", ".join(f'coalesce(sum("{x}"), 0)::BIGINT' for x in [*dims.SPECIALTY_ORDER[:8], "AUTRE", "XYZABC"])} FROM c""",
    "q_totals": f"{_D} SELECT count(*) FILTER (nom <> '') AS named, count(*) AS records FROM d",
    "q_sorted_directory": f"{_R} SELECT ordinal, ville, specialite, secteur, nom, regexp_matches(lower(notes), 'pas de|idem|meme medecin') AS row_soft FROM r ORDER BY ville, specialite, secteur, nom, ordinal",
    "q_shared_values": f"{_SITES} SELECT city, hospital, members, array_to_string(s_adresse, '|') AS adresse, array_to_string(s_telephone, '|') AS telephone, array_to_string(s_email, '|') AS email FROM s",
    "q_infer": f"""{_SITES} SELECT ordinal, {", ".join(f"CASE WHEN {_fill(f)} THEN s_{f}[1] ELSE {f} END AS {f}" for f in inferring.INFERRED)},
  array_to_string(list_filter([CASE WHEN notes <> '' THEN notes END, {", ".join(f"CASE WHEN {_fill(f)} THEN '{f} {_NOTE} END" for f in inferring.INFERRED)}], lambda n: n IS NOT NULL), ' ; ') AS notes,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {_fill(f)} THEN '{f}' END" for f in ("adresse", "email", "telephone"))}], lambda n: n IS NOT NULL), ',') AS marked FROM m LEFT JOIN s ON s.city = m.city AND s.hospital = m.hospital""",
    "q_infer_log": f"""{_SITES}, b AS (SELECT m.*, s.* EXCLUDE (city, hospital) FROM m JOIN s ON s.city = m.city AND s.hospital = m.hospital)
{" UNION ALL ".join(f"SELECT first_ordinal AS ordinal, '[Inference] {f} ambigu pour  ' || nom || ' (' || display || '): valeurs (' || array_to_string(list_transform(s_{f}, lambda v: chr(39) || v || chr(39)), ', ') || ') — laisse vide' AS message FROM b WHERE {f} = '' AND len(s_{f}) > 1" for f in inferring.INFERRED)}""",
    "q_match_best": f"""{_R}, k AS (SELECT ordinal AS o, {_key('nom')} AS n, specialite AS sp, {_key('ville')} AS c, {_hospital('hopital')} AS h FROM r),
x AS (SELECT a.o AS ordinal, b.o AS match, levenshtein(a.n, b.n)::INTEGER AS distance FROM k a JOIN k b ON a.o <> b.o AND a.n <> '' AND b.n <> '' AND abs(length(a.n) - length(b.n)) <= 2 AND levenshtein(a.n, b.n) <= 2 AND levenshtein(a.c, b.c) <= 3
  AND (a.sp = b.sp OR a.sp = '' OR b.sp = '') AND (a.h = b.h OR a.h = '' OR b.h = ''))
SELECT ordinal, match, distance FROM (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY distance, match) AS n FROM x) WHERE n = 1""",
    "q_components": _PAIRS.replace("WITH d", "WITH RECURSIVE d", 1) + """, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), reach(x, y) AS (SELECT k, k FROM k UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT x AS k, min(y) AS first_key, count(*) AS members FROM reach GROUP BY x""",
    "q_idem": f"""{_R}, z AS (SELECT *, ordinal % 10 AS sheet, CASE WHEN notes = 'idem pediatrie' THEN '' ELSE nom END AS name FROM r),
f AS (SELECT sheet, specialite, arg_min(name, ordinal) AS ref, arg_min(hopital, ordinal) AS ref_hop FROM z WHERE secteur = 'Pediatrie' AND name <> '' GROUP BY 1, 2)
SELECT ordinal, CASE WHEN name = '' AND ref IS NOT NULL THEN ref ELSE name END AS nom, CASE WHEN name = '' AND ref IS NOT NULL THEN 'Meme medecin que secteur Pediatrie' ELSE notes END AS notes,
  CASE WHEN name = '' AND ref IS NOT NULL AND hopital = '' THEN ref_hop ELSE hopital END AS hopital FROM z LEFT JOIN f USING (sheet, specialite)""",
}
