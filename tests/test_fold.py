import random
import time

import pytest
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.operators import fold as folding
from rostra.operators import infer, match
from rostra.plans import pipeline
from rostra.plans.extract import MARKERS

DAY = "2026-05-01"


def table(spark, rows):
    base = dict.fromkeys(dims.FIELDS, "")
    full = [(i, *[(base | r)[f] for f in dims.FIELDS]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "ordinal long, " + ", ".join(f"{f} string" for f in dims.FIELDS))
    return df.withColumn("markers", F.create_map().cast(MARKERS))


def doc(nom="MARTIN", ville="Lyon", specialite="NEPHROLOGIE", **more):
    return {"nom": nom, "ville": ville, "specialite": specialite} | more


def run(spark, new, existing=None):
    if existing is None:
        done, log = folding.fold(table(spark, new), None, DAY)
    else:
        both = table(spark, existing + new)
        done, log = folding.fold(both.filter(F.col("ordinal") >= len(existing)), both.filter(F.col("ordinal") < len(existing)), DAY)
    return [r.asDict(True) for r in done.orderBy("ordinal").collect()], [r["message"] for r in log.orderBy("ordinal", "seq").collect()]


def test_enrich_fills_updates_and_adds(spark):
    got, log = run(spark, [doc(email="a@b.fr", telephone="2", source="Import 2"), doc("DUVAL", "Bordeaux"), {"notes": "no name"}], [doc(telephone="1", source="Import 1")])
    assert len(got) == 2 and (got[0]["email"], got[0]["telephone"], got[0]["source"], got[0]["date_import"]) == ("a@b.fr", "2", "Import 1 + Import 2", DAY)
    assert log == ["Mise a jour MARTIN  (Lyon): telephone: '1' -> '2'", "Nouveau medecin ajoute :  DUVAL  (Bordeaux, NEPHROLOGIE)"]


@pytest.mark.parametrize("note", ["Transfere depuis Toulouse", "Muté en 2026", "Ancienne affectation : Toulouse"])
def test_transfer(spark, note):
    got, log = run(spark, [doc(ville="Nice", hopital="CHU Nice", notes=note)], [doc(ville="Toulouse", hopital="CHU Toulouse")])
    assert [(r["ville"], r["region"], r["notes"], r["markers"]) for r in got] == [("Nice", "Provence-Alpes-Cote d'Azur", "Transfere de Toulouse (CHU Toulouse)", {})]
    assert log[0].startswith("Transfert detecte")


def test_conflict_and_other_specialty(spark):
    got, log = run(spark, [doc(hopital="CHU A"), doc(hopital="CHU B"), doc(specialite="UROLOGIE", hopital="CHU C")])
    assert [sorted(r["markers"]) for r in got] == [["hopital"], ["hopital"], []]
    assert got[0]["notes"] == "Affiliation multiple possible — voir aussi CHU B" and log[0].startswith("[Conflit hopital]")


def test_generation_keeps_first_values(spark):
    got, log = run(spark, [doc(telephone="1"), doc("MARTEN", telephone="2", email="x", adresse="y", prenom="Eva"), {"notes": "pas de referent"}])
    assert [(r["nom"], r["telephone"], r["email"], r["prenom"]) for r in got] == [("MARTIN", "1", "x", "Eva"), ("", "", "", "")]
    assert log == ["Conflit pour MARTIN Eva (Lyon): telephone: '1' vs '2'"]


@pytest.mark.parametrize("enriching", [False, True])
def test_components_fold_like_the_whole(spark, enriching):
    rng = random.Random(7)
    rows = [
        doc(
            rng.choice(["MARTIN", "MARTEN", "MARTENS", "DUVAL", "DUVALL", "LE ROY", "LEROY", "X", "", "KLEIN-B"]), rng.choice(["Lyon", "Nice", "Nancy", "Lille"]), rng.choice(["NEPHROLOGIE", "UROLOGIE", ""]),
            hopital=rng.choice(["", "CHU A", "CHU de A", "CHU B"]), telephone=rng.choice(["", "1", "2"]), prenom=rng.choice(["", "Eva"]), notes=rng.choice(["", "", "Muté en 2026", "x"]), source=rng.choice(["A", "B"]),
        )
        for _ in range(120)
    ]
    cut = 40 if enriching else 0
    got, log = run(spark, rows[cut:], rows[:cut]) if enriching else run(spark, rows)
    whole = folding.Fold(DAY, enriching)
    for r in folding.keyed(table(spark, rows)).orderBy("ordinal").collect():
        whole.add(folding.plain_row(r.asDict()), r["ordinal"] < cut)
    kept = [{k: v for k, v in r.items() if k not in folding.KEYS} for r in whole.kept]
    assert sorted(got, key=lambda r: r["ordinal"]) == sorted(kept, key=lambda r: r["ordinal"])
    assert log == [m for _, _, m in whole.log]
    assert_like_a_search_of_all(rng, whole)


def plain_find(kept, r, strict):
    """The best match by looking at every kept record."""
    found = []
    for i, k in enumerate(kept):
        if not k["nom"] or (r["specialite"] and k["specialite"] and r["specialite"] != k["specialite"]):
            continue
        if strict and ((r["hospital"] and k["hospital"] and r["hospital"] != k["hospital"]) or folding._distance(r["city_key"], k["city_key"], 3) > 3):
            continue
        if r["name_key"] and (d := folding._distance(r["name_key"], k["name_key"], 2)) <= 2:
            found.append((d, i))
    return min(found)[1] if found else None


def assert_like_a_search_of_all(rng, whole):
    for _ in range(200):
        r = dict(rng.choice(whole.kept)) | {"specialite": rng.choice(["NEPHROLOGIE", "", "UROLOGIE"]), "hospital": rng.choice(["", "a", "b"]), "city_key": rng.choice(["LYON", "NICE", "NANCI", "X"])}
        assert [whole.index.find(r, s) for s in (False, True)] == [plain_find(whole.kept, r, s) for s in (False, True)]


def test_one_component_of_100000_records(spark):
    """Near names, in many cities and hospitals; one task folds them in seconds."""
    letters = "ABCDEFGHIJ"
    rows = spark.range(100_000).select(
        F.col("id").alias("ordinal"), F.concat(F.lit("MARTIN"), F.element_at(F.array(*[F.lit(x + y) for x in letters for y in letters]), (F.col("id") % 30 + 1).cast("int"))).alias("nom"),
        F.concat(F.lit("VILLE "), F.hex(F.xxhash64(F.col("id") % 397))).alias("ville"), F.lit("NEPHROLOGIE").alias("specialite"), F.concat(F.lit("CHU "), (F.col("id") % 4999).cast("string")).alias("hopital"),
    )
    full = rows.select("ordinal", *[f if f in rows.columns else F.lit("").alias(f) for f in dims.FIELDS], F.create_map().cast(MARKERS).alias("markers"))
    began = time.time()
    done, log = folding.fold(full, None, DAY)
    assert done.count() + log.count() > 0 and match.match_groups(full).select("component").distinct().count() == 1
    assert time.time() - began < 120


def test_inference(spark):
    site = {"ville": "Bordeaux", "hopital": "CHU de Bordeaux"}
    rows = [doc("A", **site | {"adresse": "1 rue", "email": "s@x", "telephone": "9", "notes": "Tel secretariat hopital"}), doc("B", **site | {"hopital": "CHU Bordeaux", "email": "s@x"}), doc("C", **site), doc("D", "Pau"), doc("E", "Pau")]
    done, log = infer.infer(table(spark, rows))
    got = {r["nom"]: r for r in done.collect()}
    assert (got["C"]["adresse"], got["C"]["email"], got["C"]["telephone"]) == ("1 rue", "s@x", "9") and set(got["C"]["markers"]) == {"adresse", "email", "telephone"}
    assert got["B"]["notes"].startswith("adresse infere depuis secretariat CHU de Bordeaux") and got["D"]["adresse"] == "" and log.count() == 0
    done, log = infer.infer(table(spark, [doc("A", **site | {"adresse": "1"}), doc("B", **site | {"adresse": "2"}), doc("C", **site)]))
    assert [r["message"] for r in log.collect()] == ["[Inference] adresse ambigu pour  C (CHU de Bordeaux): valeurs ('1', '2') — laisse vide"]


def test_pairs_are_complete(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(0, 7))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "k string")
    got = {(r["a"], r["b"]): r["distance"] for r in match.name_pairs(df).collect()}
    want = {(a, b): d for a in words for b in words if "" < a < b and (d := folding._distance(a, b, 2)) <= 2}
    assert got == want


def test_pairs_of_long_names_are_complete(spark, monkeypatch):
    """Names on both sides of LONG, edits at all places, and parts that more names have than HOT."""
    rng = random.Random(5)
    words = set()
    for i in range(60):
        base = "".join(rng.choice("ABCD") for _ in range(rng.randint(12, 36)))
        words.add(base)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "D"])
            words.add("".join(w))
    words = sorted(words | {"CENTREHOSPITALIER" + "".join(rng.choice("ABC") for _ in range(4)) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "k string")
    want = {(a, b): d for a in words for b in words if a < b and (d := folding._distance(a, b, 2)) <= 2}
    for hot in (match.HOT, 3):
        monkeypatch.setattr(match, "HOT", hot)
        found = match.name_pairs(df).collect()
        assert {(r["a"], r["b"]): r["distance"] for r in found} == want and len(found) == len(want)


def test_pairs_broadcast_no_spread_rows(spark):
    names = spark.range(200).select(F.upper(F.md5(F.col("id").cast("string"))).alias("k"))
    assert "Broadcast" not in match.name_pairs(names)._jdf.queryExecution().executedPlan().toString()


def test_3000_small_components(spark):
    """Components share batches; as data frames of their own they took 40 ms each."""
    base = dict.fromkeys(dims.FIELDS, F.lit(""))
    rows = spark.range(6_000).select(F.col("id").alias("ordinal"), *[c.alias(f) for f, c in (base | {"nom": F.upper(F.md5((F.col("id") / 2).cast("int").cast("string"))), "telephone": (F.col("id") % 2).cast("string"), "specialite": F.lit("UROLOGIE")}).items()], F.create_map().cast(MARKERS).alias("markers"))
    folding.fold(rows.limit(10), None, DAY)
    began = time.time()
    done, log = folding.fold(rows, None, DAY)
    assert (done.count(), log.count()) == (3_000, 3_000) and done.filter("telephone = '0' and ordinal % 2 = 0").count() == 3_000
    assert time.time() - began < 50


def test_best_match_like_a_search_of_all(spark):
    rng = random.Random(11)
    row = lambda: doc(rng.choice(["MARTIN", "MARTEN", "MARTENS", "DUVAL", "", "KLEIN-B"]), rng.choice(["Lyon", "Lyon Sud", "Lille", "Nancy"]), rng.choice(["NEPHROLOGIE", "UROLOGIE", ""]), hopital=rng.choice(["", "CHU A", "CHU de A", "CHU B"]))
    both = table(spark, [row() for _ in range(90)])
    left, pool = both.filter("ordinal < 60"), both.filter("ordinal >= 30")
    all_rows = {r["ordinal"]: r.asDict() for r in folding.keyed(both).collect()}
    for a, b, ways in ((left, pool, [(True, False)]), (both, both, [(True, True), (False, True)])):
        for city, hospital in ways:
            want = set()
            for o in [r["ordinal"] for r in a.collect()]:
                x, found = all_rows[o], []
                for p in [r["ordinal"] for r in b.collect()]:
                    y, blank = all_rows[p], lambda f, x=x, p=p: "" in (x[f], all_rows[p][f]) or x[f] == all_rows[p][f]  # noqa: B023
                    if o != p and x["name_key"] and y["name_key"] and blank("specialite") and (not hospital or blank("hospital")) and (not city or folding._distance(x["city_key"], y["city_key"], 3) <= 3):
                        found.append((folding._distance(x["name_key"], y["name_key"], 2), p))
                if found and min(found)[0] <= 2:
                    want.add((o, min(found)[1], min(found)[0]))
            got = match.best_match(a, b, city, hospital).collect()
            assert {(r["ordinal"], r["match"], r["distance"]) for r in got} == want and len(got) == len(want)


def test_best_match_of_many_alike(spark):
    """40,000 records of one name are 1.6e9 pairs."""
    rows = spark.range(40_000).select(F.col("id").alias("ordinal"), *[F.lit({"nom": "MARTIN", "ville": "Lyon"}.get(f, "")).alias(f) for f in dims.FIELDS])
    began = time.time()
    assert {tuple(r) for r in match.best_match(rows, rows, True, True).groupBy("match", "distance").count().collect()} == {(0, 0, 39_999), (1, 0, 1)}
    assert time.time() - began < 60


def test_empty_enrichment_keeps_existing(spark):
    old = table(spark, [doc(hopital="CHU A", adresse="1"), doc("DUVAL", hopital="CHU A")])
    done, log = pipeline.enrich(old, old.limit(0), DAY)
    assert done.filter("adresse = ''").count() == 1 and log.count() == 0
