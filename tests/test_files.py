import files
import pytest

from rostra.functions import dims
from rostra.plans import pipeline
from rostra.sources.ooxml import read_files


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("ordinal").collect()]


def test_network_workbook(spark, tmp_path):
    found, log = pipeline.extract_records(spark, [files.network(tmp_path / "reseau.xlsx")])
    got = rows(found, "ville", "specialite", "secteur", "titre", "nom", "prenom")
    assert got == [
        ("Lyon", "NEPHROLOGIE", "Pediatrie", "", "BERNARD", "Sophie"),
        ("Lyon", "NEPHROLOGIE", "Adulte", "", "PETIT", "Marc"),
        ("Lyon", "DERMATOLOGIE", "Pediatrie", "", "DURAND", "Claire"),
        ("Lyon", "DERMATOLOGIE", "Adulte", "", "DURAND", "Claire"),
        ("Lyon", "NEUROLOGIE", "Adulte", "Pr", "LEROY", "Thomas"),
        ("Lyon", "NEUROLOGIE", "Adulte", "", "MOREAU", "Julie"),
        ("Strasbourg", "CARDIOLOGIE", "", "", "", ""),
        ("Strasbourg", "NEPHROLOGIE", "", "", "KLEIN", "Eva"),
        ("Lille", "DERMATOLOGIE", "Pediatrie", "Dr", "LAMBERT", "Paul"),
    ]
    first = found.orderBy("ordinal").first()
    assert (first["telephone"], first["email"], first["adresse"], first["hopital"]) == ("04 72 00 00 01", "sophie@chu.fr", "2 rue B", "Hôpital Mère-Enfant")
    assert (first["region"], first["type_centre"], first["responsable_centre"], first["source"]) == ("Auvergne-Rhone-Alpes", "Centre de référence", "Pr DUPONT Alain", "reseau.xlsx")
    notes = {r["nom"]: r["notes"] for r in found.collect()}
    assert notes["KLEIN"] == "ou collègue" and notes[""] == "pas de référent"
    markers = {r["nom"]: r["markers"] for r in found.collect()}
    assert markers["KLEIN"]["specialite"]["kind"] in ("fuzzy", "phonetic")
    assert found.filter("notes = 'Meme medecin que secteur Pediatrie'").count() == 1


def test_sectioned_document(spark, tmp_path):
    found, _ = pipeline.extract_records(spark, [files.care(tmp_path / "prise.docx")], origin="Import")
    assert rows(found, "ville", "specialite", "titre", "nom", "prenom", "telephone", "secteur", "source") == [
        ("Grenoble", "DERMATOLOGIE", "Dr", "GARCIA", "Francois", "04 76 00 00 01", "", "Import"),
        ("Lyon", "", "Pr", "DURAND", "Claire", "04 72 11 11 11", "Pediatrie et Adulte", "Import"),
        ("Lyon", "", "Dr", "FAURE", "Nicolas", "04 72 11 11 11", "Pediatrie et Adulte", "Import"),
        ("Clermont-Ferrand", "NEUROLOGIE", "Dr", "THOMAS", "Anne", "", "", "Import"),
    ]


def test_tables_and_free_text(spark, tmp_path):
    table = [["Liste", "", "", ""], ["Prénom", "Nom", "Tel.", "Spécialité"], ["Ann", "Dr ROY", "0477828118", "cardiologues"], ["", "", "", ""], ["", "Jean Dupont", "", "Inconnue"]]
    book = files.workbook(tmp_path / "t.xlsx", Feuille=table, Libre=[["a", "b"], ["Dr Luc Morel", "x"]])
    doc = files.document(tmp_path / "t.docx", [[["Nom", "Ville", "Adresse mail"], ["LEGRAND Paul", "Nice", "p@x.fr (perso)"]], [["Nom", "Ville", "Mail"], ["BLANC Eva", "Tours", ""]]])
    free = files.document(tmp_path / "f.docx", [("", "Au CHU de Brest, Dr Luc Morel, cardiologue, 02 98 00 00 01, luc@x.fr")])
    other = tmp_path / "x.pdf"
    other.write_bytes(b"%PDF")
    broken = tmp_path / "b.xlsx"
    broken.write_bytes(b"no zip")
    found, log = pipeline.extract_records(spark, [book, doc, free, str(other), str(broken)])
    assert rows(found, "ville", "specialite", "titre", "nom", "prenom", "telephone", "email") == [
        ("", "CARDIOLOGIE", "Dr", "ROY", "", "04 77 82 81 18", ""),
        ("", "INCONNUE", "", "DUPONT", "Jean", "", ""),
        ("", "", "Dr", "MOREL", "Luc", "", ""),
        ("Nice", "", "", "LEGRAND", "Paul", "", "p@x.fr"),
        ("Tours", "", "", "BLANC", "Eva", "", ""),
        ("Brest", "CARDIOLOGIE", "Dr", "MOREL", "Luc", "02 98 00 00 01", "luc@x.fr"),
    ]
    messages = {r["message"] for r in log.collect()}
    assert "Format non reconnu: .pdf" in messages and any(m.startswith("Fichier illisible: b.xlsx") for m in messages)
    assert "[Scanner/Libre] Tableau multi-colonnes sans en-tetes reconnus" in messages


def test_generate_write_read_enrich(spark, tmp_path):
    book = files.network(tmp_path / "reseau.xlsx")
    directory, log = pipeline.generate(spark, [book, files.care(tmp_path / "p.docx")], run_date="2026-01-01")
    out = str(tmp_path / "annuaire.xlsx")
    pipeline.write_directory(directory, log, out)
    back, _ = pipeline.read_directory(spark, out)
    fields = [f for f in dims.FIELDS if f != "notes"]
    a = sorted(tuple(r[f] for f in fields) for r in directory.collect())
    assert sorted(tuple(r[f] for f in fields) for r in back.collect()) == a
    cells = read_files(spark, [out])
    assert {r["sheet"] for r in cells.select("sheet").distinct().collect()} == {"Annuaire Complet", "Par Ville", "Journal Import"}
    again, more = pipeline.generate(spark, [book], existing=out, run_date="2026-02-01")
    assert again.count() == directory.count()
    keys = [tuple(r) for r in again.filter("nom <> ''").select("ville", "nom", "specialite", "secteur").collect()]
    assert len(keys) == len(set(keys))


@pytest.mark.parametrize("paths", [[]])
def test_empty(spark, tmp_path, paths):
    book = files.workbook(tmp_path / "e.xlsx", Seule=files.column("LYON", "x"))
    found, log = pipeline.extract_records(spark, [book])
    assert found.count() == 0 and [r["message"] for r in log.collect()] == ["[Seule] Trop peu de lignes (2)"]


def test_names_with_any_characters_and_missing_files(spark, tmp_path):
    names = ["liste [1].xlsx", "liste 1.xlsx", "a{b,c}*?.xlsx"]
    paths = [files.workbook(tmp_path / n, Feuille=[["Nom", "Ville"], [f"ROY Ann{i}", "Nice"]]) for i, n in enumerate(names)]
    found, log = pipeline.extract_records(spark, [paths[0], str(tmp_path / "gone.xlsx"), *paths[1:], paths[0]])
    assert rows(found, "prenom", "source") == [("Ann0", names[0]), ("Ann1", names[1]), ("Ann2", names[2]), ("Ann0", names[0])]
    assert [r["message"] for r in log.collect()] == ["Fichier introuvable: gone.xlsx"]
    assert read_files(spark, [str(tmp_path / "none.xlsx")]).count() == 1 and read_files(spark, []).count() == 0


def test_places_beyond_a_million_lines(spark):
    """Records of far lines, parts and files keep their order and their file."""
    from pyspark.sql import functions as F

    from rostra.plans.extract import numbered, place

    far = [(0, 3, 1_048_575, 0, 0), (0, 3, 1_048_575, 60, 25), (0, 2000, 0, 0, 0), (1, 0, 0, 0, 0), (70_000, 0, 5, 0, 0)]
    df = spark.createDataFrame(far[::-1], "file_idx long, sheet_idx int, pos int, sub int, nth int").select(place().alias("place"), F.col("pos").cast("string").alias("nom"))
    got = [tuple(r["place"]) for r in numbered(df).orderBy("ordinal").collect()]
    assert got == far and numbered(df).select("ordinal").distinct().count() == 5


def test_cells_and_names_beyond_old_limits(spark):
    from rostra.functions import names

    person = "Jean " + " ".join(f"x{i}" for i in range(1200)) + " Dupont"
    cell = " ".join(f"Téléphone : {i}" for i in range(10_050))
    df = spark.createDataFrame([(person, cell)], "p string, c string")
    r = df.select(names.normalize_name("p")["prenom"].alias("p"), names.split_labels("c").alias("c")).first()
    assert len(r["p"].split()) == 1201 and len(r["c"]) == 10_050


def test_workbook_comments_filters_and_widths(spark, tmp_path):
    import zipfile

    from test_fold import doc, table

    both = table(spark, [doc(hopital="CHU A"), doc(hopital="CHU B"), doc("DUVAL", notes="pas de référent")])
    done, log = pipeline.consolidate(both, "2026-01-01")
    path = str(tmp_path / "out.xlsx")
    pipeline.write_directory(done, log, "file://" + path)
    with zipfile.ZipFile(path) as z:
        sheet, notes = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/comments1.xml").decode()
        assert '<autoFilter ref="A2:Q5"/>' in sheet and "legacyDrawing" in sheet and sheet.count("<col ") == 17 and 'width="40"' in sheet
        assert notes.count("<comment ref=") == 2 and "Conflit: voir aussi CHU B" in notes and 'ref="K' in notes
        assert 'width="100"' in z.read("xl/worksheets/sheet3.xml").decode() and 'xSplit="1" ySplit="1" topLeftCell="B2"' in z.read("xl/worksheets/sheet2.xml").decode()
    back, _ = pipeline.read_directory(spark, path)
    assert back.count() == 3
    pipeline.write_tables(done, log, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/directory")).count() == 3 and spark.read.parquet(str(tmp_path / "tables/journal")).count() == log.count()
