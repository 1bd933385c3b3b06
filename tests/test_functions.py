import pytest
from pyspark.sql import functions as F

from rostra.functions import dims, names, specialty, text
from rostra.functions.metaphone import metaphone
from rostra.operators import report


def values(spark, inputs, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr("c")).collect()]


CASES = [
    (text.clean_text, [("hello\xa0world", "hello world"), ("a​b", "ab"), (None, ""), ("  x \t\n y ", "x y"), ("", "")]),
    (text.strip_accents, [("éàüîç", "eauic"), ("Saint-Étienne", "Saint-Etienne"), ("é", "e"), (None, "")]),
    (
        text.normalize_phone,
        [
            ("0477828118", "04 77 82 81 18"),
            ("05.34.55.84.58", "05 34 55 84 58"),
            ("+33 5 34 55 74 23", "05 34 55 74 23"),
            ("(secrétariat) 05 34 55 84 58", "05 34 55 84 58"),
            ("0534558458 ou 0534557423", "05 34 55 84 58 / 05 34 55 74 23"),
            ("0534558458 / 0534558458", "05 34 55 84 58"),
            ("pas de téléphone", ""),
            (None, ""),
            ("04 77 82 81 18 99", "04 77 82 81 18"),
        ],
    ),
    (text.compare_key, [("Le Camus-Hachon", "LECAMUSHACHON"), ("PÉRIVIER", "PERIVIER")]),
    (text.hospital_key, [("CHU de Bordeaux", "bordeaux"), ("CHU Bordeaux", "bordeaux"), ("CHU", ""), ("Hôpital d'Angers", "angers"), ("Centre  Hospitalier de Pau", "pau"), ("", "")]),
    (text.normalize_ville, [("LYON", "Lyon"), ("saint-etienne", "Saint-Etienne"), ("PARIS ROBERT DEBRÉ", "Paris Robert Debre"), ("clermont-ferrand", "Clermont-Ferrand"), ("l'isle", "L'Isle")]),
    (text.normalize_city, [("CHU de Toulouse", "Toulouse"), ("Hôpital Necker", "Necker"), ("Nice", "Nice")]),
    (text.section_city, [("CHU de Nice (Hôpital Archet 2)", "Nice"), ("CHU de Grenoble", "Grenoble"), ("CHU d'Orleans", "Orleans"), ("Hôpital Avicenne, Bobigny", "Bobigny")]),
    (text.region_of, [("MARSEILLE", "Provence-Alpes-Cote d'Azur"), ("Paris Robert Debre", "Ile-de-France"), ("Paris Nord", "Ile-de-France"), ("Timbuktu", ""), ("", ""), (" ", "Ile-de-France")]),
    (text.sector_value, [("Pédiatrie :", "Pediatrie"), ("Adulte", "Adulte"), ("Enfants et adultes", "Pediatrie et Adulte"), ("Ado", "Pediatrie"), ("", "Non precise"), ("Autre", "Autre")]),
    (text.detect_sector, [("Prise en charge enfants et adultes", "Pediatrie et Adulte"), ("pédiatrique", "Pediatrie"), ("", "")]),
    (text.title_of, [("professeur", "Pr"), ("DR", "Dr"), ("", "")]),
    (text.clean_email, [("a@b.fr (secretariat)", "a@b.fr"), (": a@b.fr", "a@b.fr")]),
    (lambda c: F.array_join(text.emails(c), "|"), [("x a.b-c@d.e.fr, q@r.com", "a.b-c@d.e.fr|q@r.com"), ("none", "")]),
    (
        lambda c: F.array_join(F.array(*[names.normalize_name(c)[k] for k in ("titre", "nom", "prenom")]), "|"),
        [
            ("HACHON LE CAMUS Caroline", "|HACHON LE CAMUS|Caroline"),
            ("Pr Jérome HARAMBAT", "Pr|HARAMBAT|Jérome"),
            ("Professeur RIGOTHIER CLAIRE", "Pr|RIGOTHIER|CLAIRE"),
            ("LEFORT, Bruno", "|LEFORT|Bruno"),
            ("ISIDOR", "|ISIDOR|"),
            ("Jean Dupont", "|DUPONT|Jean"),
            ("Martin Jean-Pierre", "|MARTIN|Jean-Pierre"),
            ("Smith Jones", "|SMITH|Jones"),
            ("Pierre Jean", "|PIERRE|Jean"),
            ("Dr ", "|DR|"),
            (None, "||"),
        ],
    ),
    (
        lambda c: F.array_join(names.split_names(c), "|"),
        [
            ("SERRANO Emilie - CHERIET Farah", "SERRANO Emilie|CHERIET Farah"),
            ("Pr LEROY Thomas & MOREAU Julie", "Pr LEROY Thomas|MOREAU Julie"),
            ("A B / C D et E F, G H", "A B|C D|E F|G H"),
            ("LEFORT, Bruno", "LEFORT, Bruno"),
            ("ou médecin de l'hôpital", "ou médecin de l'hôpital"),
            ("", ""),
        ],
    ),
    (
        lambda c: F.array_join(F.transform(names.split_labels(c), lambda p: F.concat(p["label"], F.lit("="), p["value"])), "|"),
        [
            ("Hôpital de rattachement : Robert-Debré Adresse postale : 48 bd", "hopital=Robert-Debré|adresse=48 bd"),
            ("Intro NOM – PRENOM : X Téléphone\xa0: 01 Adresse mail: a@b.c", "prefix=Intro|nom=X|telephone=01|email=a@b.c"),
            ("just text", "raw=just text"),
            ("", ""),
        ],
    ),
    (
        lambda c: F.concat_ws("|", specialty.classify_native(c)["specialite"], specialty.classify_native(c)["method"]),
        [("dermatologie", "DERMATOLOGIE|exact"), ("Dermato", "DERMATOLOGIE|prefix"), ("dermathologue", "DERMATOLOGIE|fuzzy"), ("XYZABC", ""), ("", ""), ("Néphrologues :", "NEPHROLOGIE|exact")],
    ),
]


@pytest.mark.parametrize("expr,cases", CASES)
def test_functions(spark, expr, cases):
    assert values(spark, [a for a, _ in cases], expr) == [b for _, b in cases]


def test_phonetic(spark):
    df = spark.createDataFrame([("nefrologie",), ("XYZABC",), ("cardio",), ("",), (None,)], "label string")
    got = {r["label"]: (r["resolved"]["specialite"], r["resolved"]["method"]) if r["resolved"] else (None, None) for r in specialty.classify(df, "label").collect()}
    assert got == {"nefrologie": ("NEPHROLOGIE", "phonetic"), "XYZABC": (None, None), "cardio": ("CARDIOLOGIE", "prefix"), "": (None, None), None: (None, None)}


def test_metaphone():
    assert metaphone("nefrologie") == metaphone("nephrologie") != metaphone("nefro logie")
    assert [metaphone(w) for w in ("Thumb", "which", "physics", "", "ae 12", "wrapped")] == ["0M", "WX", "FSKS", "", "E", "RPT"]


def test_sound_conflicts(spark):
    df = spark.createDataFrame([("nefrologie",), ("fysik",), ("dermato",), (None,)], "label string")
    known = ("PHYSIK", "FISIC", "NEPHROLOGIE")
    assert [r["message"] for r in specialty.sound_conflicts(df, "label", known).collect()] == ["[Phonetique] 'fysik' correspond a plusieurs specialites (PHYSIK, FISIC) — non resolu"]
    got = {r["label"]: r["resolved"]["specialite"] if r["resolved"] else None for r in specialty.classify(df, "label", known=known).collect()}
    assert got == {"nefrologie": "NEPHROLOGIE", "fysik": None, "dermato": "DERMATOLOGIE", None: None}


def test_dictionaries_are_parameters(spark):
    assert values(spark, ["Gotham", "Nice"], lambda c: text.region_of(c, {"gotham": "Jersey"})) == ["Jersey", ""]
    assert values(spark, ["dentistes", "dermato"], lambda c: specialty.classify_native(c, {"dentistes": "DENTISTERIE"}, {})["specialite"]) == ["DENTISTERIE", None]


def test_rules(spark):
    df = spark.createDataFrame([("Transféré depuis Toulouse", ""), ("Mute en 2026", ""), ("Ancienne affectation : Toulouse", ""), ("autre", "X")], "notes string, source string")
    assert [r[0] for r in df.select(text.is_transfer("notes", "source")).collect()] == [True, True, True, False]
    df = spark.createDataFrame([("B + A", "C"), ("A", "A"), ("", "Z"), ("B", "")], "a string, b string")
    assert [r[0] for r in df.select(text.union_sources("a", "b")).collect()] == ["A + B + C", "A", "Z", "B"]


def test_first_names_of_the_whole_lexicon(spark):
    """Surnames follow first names from all over the reference's list."""
    first = ["Raphael", "Marguerite", "Corentin", "Bastien", "Zoe", "Timothée"]
    df = spark.createDataFrame([(f"{x} Blanc",) for x in first], "person string")
    got = [r[0].asDict() for r in df.select(names.normalize_name("person")).collect()]
    assert [(g["nom"], g["prenom"]) for g in got] == [("BLANC", x) for x in first] and len(set(dims.FIRST_NAMES)) == 548


def test_crosstab_has_all_specialties(spark):
    n = 1003
    df = spark.createDataFrame([("Nice", f"LABEL {i:04d}", "X") for i in range(n)], "ville string, specialite string, nom string")
    got = {r["ville"]: r.asDict() for r in report.crosstab(df).collect()}
    assert set(got) == {"Nice", "TOTAL"}
    assert all(len(r) == n + 2 and r["Total"] == n == sum(v for k, v in r.items() if k.startswith("LABEL")) for r in got.values())


def test_keys_are_computed_once(spark):
    """In each of a hundred branches a label's key took a millisecond or more."""
    import time

    labels = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("@x.fr")).alias("label"))
    work = lambda n: labels.limit(n).select(F.sum(F.length(F.coalesce(specialty.classify_native("label")["specialite"], F.lit("")))), F.sum(F.length(text.region_of(F.concat(F.lit("x"), "label"))))).collect()
    work(10)
    began = time.time()
    assert work(60_000) == [(0, 0)]
    assert time.time() - began < 30
