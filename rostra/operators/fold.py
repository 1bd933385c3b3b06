"""The order-dependent fold of records: merging, transfers and hospital conflicts, one component of near names at a time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.functions import dims
from rostra.functions.text import compare_key, hospital_key, is_transfer, region_of

from .match import CITY_ERRORS, NAME_ERRORS, match_groups

RECORD_COLUMNS = ["ordinal", *dims.FIELDS]
_OUT = "kind string, component long, ordinal long, seq int, message string, " + ", ".join(f"{f} string" for f in dims.FIELDS) + ", markers map<string,struct<kind:string,comment:string>>"
BATCH_ROWS = 5_000
#: Up to so many different names are compared one by one; shortened forms of so few cost more than they save.
FEW_NAMES = 8
#: What follows from a field and moves with it.
DERIVED = {"nom": ("name_key",), "ville": ("city_key", "city_region"), "hopital": ("hospital",)}
KEYS = ["name_key", "city_key", "city_region", "hospital", "moved"]

CONTACTS = ("hopital", "adresse", "telephone", "email")
CENTRE = ("type_centre", "responsable_centre")
PERSON = ("titre", "prenom", "specialite", "specialite_detail", "secteur")
#: For each event the fields that a kept record takes from a new one: FILL where it has none, TAKE where the new one has one.
FILL, TAKE = "fill", "take"
RULES = {
    "richer": dict.fromkeys(("nom", *PERSON, "ville", "region", *CENTRE), FILL),
    "contacts": dict.fromkeys(CONTACTS, FILL),
    "update": dict.fromkeys((*PERSON, *CENTRE), FILL) | dict.fromkeys(CONTACTS, TAKE),
    "transfer": dict.fromkeys((*CONTACTS, *CENTRE, "ville"), TAKE) | dict.fromkeys(PERSON, FILL),
}


def keyed(records: DataFrame) -> DataFrame:
    """records with what the fold compares: keys of name, city and hospital, the city's region, and whether the record speaks of a
    transfer."""
    return records.withColumns({"name_key": compare_key("nom"), "city_key": compare_key("ville"), "city_region": region_of("ville"), "hospital": hospital_key("hopital"), "moved": is_transfer("notes", "source")})


@lru_cache(100_000)
def _distance(a: str, b: str, most: int) -> int:
    """Edits from a to b, most + 1 for more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _shortened(word: str) -> set[str]:
    """The word with up to NAME_ERRORS characters removed: words that close share one of these."""
    out = level = {word}
    for _ in range(NAME_ERRORS):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


class Index:
    """Kept records by name, specialty, city and hospital, so that a search touches those only that can match."""

    def __init__(self):
        self.records: list[dict] = []
        self.filed: dict[tuple, list[int]] = defaultdict(list)  # by (name, specialty), with the city, with city and hospital
        self.specialties: dict[str, set[str]] = {}  # of each name
        self.parts: dict[str, list[str]] = defaultdict(list)
        self.near: dict[str, list[tuple[int, str]]] = {}
        self.cities: dict[str, list[str]] = {}  # each city's near ones

    @staticmethod
    def keys(r: dict) -> list[tuple]:
        whole = r["name_key"], r["specialite"], r["city_key"], r["hospital"]
        return [whole[:2], whole[:3], whole]

    def _file(self, i: int) -> None:
        r = self.records[i]
        if r["name_key"] not in self.specialties:
            self.specialties[r["name_key"]] = set()
            if len(self.specialties) > FEW_NAMES:
                for name in [r["name_key"]] if self.parts else self.specialties:
                    for part in _shortened(name):
                        self.parts[part].append(name)
            self.near.clear()
        self.specialties[r["name_key"]].add(r["specialite"])
        self.cities_near(r["city_key"])
        for key in self.keys(r):
            insort(self.filed[key], i)

    def cities_near(self, city: str) -> list[str]:
        if city not in self.cities:
            near = [c for c in self.cities if _distance(city, c, CITY_ERRORS) <= CITY_ERRORS]
            for c in near:
                self.cities[c].append(city)
            self.cities[city] = [*near, city]
        return self.cities[city]

    def add(self, r: dict) -> None:
        self.records.append(r)
        if r["nom"]:
            self._file(len(self.records) - 1)

    def change(self, i: int, how) -> None:
        """how() may change what the record is filed by."""
        before = self.keys(self.records[i])
        how()
        if self.keys(self.records[i]) != before:
            for key in before:
                del self.filed[key][bisect_left(self.filed[key], i)]
            self._file(i)

    def names_near(self, name: str) -> list[tuple[int, str]]:
        if name not in self.near:
            found = {other for part in _shortened(name) for other in self.parts.get(part, ())} if self.parts else self.specialties
            self.near[name] = sorted((d, other) for other in found if (d := _distance(name, other, NAME_ERRORS)) <= NAME_ERRORS)
        return self.near[name]

    def find(self, r: dict, strict: bool) -> int | None:
        """The kept record with the nearest name, the first on ties, of the same or an unknown specialty; strict: of a near city, and
        of the same hospital where both are known."""
        best: tuple[int, int] | None = None
        near = self.cities_near(r["city_key"]) if strict else ()
        for d, name in self.names_near(r["name_key"]) if r["name_key"] else ():
            if best and d > best[0]:
                break
            for specialty in {r["specialite"], ""} if r["specialite"] else self.specialties[name]:
                shelf = name, specialty
                lists = [shelf]
                if strict:
                    cities = [(*shelf, c) for c in near]
                    lists = [(*c, h) for c in cities for h in (r["hospital"], "")] if r["hospital"] else cities
                best = min([*([best] if best else []), *[(d, places[0]) for key in lists if (places := self.filed.get(key))]], default=None)
        return best[1] if best else None


class Fold:
    """Records in order against those already kept. enriching: the first ones are an existing directory, to which new values
    are written; else all are equals, of which earlier ones win."""

    def __init__(self, run_date: str, enriching: bool):
        self.run_date, self.enriching = run_date, enriching
        self.index = Index()
        self.log: list[tuple[int, int, str]] = []

    @property
    def kept(self) -> list[dict]:
        return self.index.records

    def say(self, r: dict, message: str) -> None:
        self.log.append((r["ordinal"], len(self.log), message))

    def add(self, r: dict, given: bool = False) -> None:
        if given or not r["nom"]:
            if given or not self.enriching:
                self.index.add(r)
            return
        i = self.index.find(r, True)
        if i is not None:
            self.event(i, r, self.merge)
            return
        i = self.index.find(r, False)
        if i is None:
            self.index.add(r)
            if self.enriching:
                self.say(r, f"Nouveau medecin ajoute : {r['titre']} {r['nom']} {r['prenom']} ({r['ville']}, {r['specialite']})")
        elif r["moved"]:
            self.event(i, r, self.transfer)
        elif self.kept[i]["hospital"] and r["hospital"] and self.kept[i]["hospital"] != r["hospital"]:
            self.conflict(self.kept[i], r)
            self.index.add(r)
        else:
            self.event(i, r, self.merge)

    def event(self, i: int, r: dict, kind) -> None:
        self.index.change(i, lambda: kind(self.kept[i], r))

    @staticmethod
    def apply(rules: dict[str, str], k: dict, r: dict) -> None:
        for field, rule in rules.items():
            if r[field] and (rule == TAKE or not k[field]):
                for f in (field, *DERIVED.get(field, ())):
                    k[f] = r[f]

    @staticmethod
    def union_source(k: dict, r: dict) -> None:
        if r["source"]:
            k["source"] = " + ".join(sorted({s.strip() for s in k["source"].split("+") if s.strip()} | {r["source"].strip()}))

    def merge(self, k: dict, r: dict) -> None:
        score = lambda x: sum(bool(x[f]) for f in ("nom", "prenom", *CONTACTS))
        differ = [(f, k[f], r[f]) for f in CONTACTS if k[f] and r[f] and k[f] != r[f]]
        if self.enriching:
            self.apply(RULES["update"], k, r)
            k["date_import"] = self.run_date
        else:
            if score(r) > score(k):
                self.apply(RULES["richer"], k, r)
            self.apply(RULES["contacts"], k, r)
        self.union_source(k, r)
        if differ:
            head, arrow = ("Mise a jour", "->") if self.enriching else ("Conflit pour", "vs")
            self.say(r, f"{head} {k['nom']} {k['prenom']} ({k['ville']}): " + "; ".join(f"{f}: '{old}' {arrow} '{new}'" for f, old, new in differ))

    def transfer(self, k: dict, r: dict) -> None:
        before = k["ville"] + (f" ({k['hopital']})" if k["hopital"] else "")
        city = k["ville"]
        self.apply(RULES["transfer"], k, r)
        self.union_source(k, r)
        k |= {"region": k["city_region"], "notes": " ; ".join(x for x in (f"Transfere de {before}", k["notes"]) if x), "date_import": self.run_date}
        k["markers"].pop("hopital", None)
        self.say(r, f"Transfert detecte : {k['titre']} {k['nom']} {k['prenom']} ({k['specialite']}) : {city} -> {r['ville']}")

    def conflict(self, k: dict, r: dict) -> None:
        for x, y in ((k, r), (r, k)):
            there = f"voir aussi {y['hopital'] or y['ville']}"
            note = f"Affiliation multiple possible — {there}"
            x["markers"]["hopital"] = {"kind": "conflict", "comment": f"Conflit: {there}"}
            if note not in x["notes"]:
                x["notes"] = " ; ".join(s for s in (note, x["notes"]) if s)
        places = " et ".join(x["hopital"] or "(inconnu)" for x in (k, r))
        self.say(r, f"[Conflit hopital] {k['titre']} {k['nom']} {k['prenom']} ({k['specialite']}): {places} — revue manuelle requise")


def plain_row(r: dict) -> dict:
    """A record of a data frame as the fold takes it."""
    markers = {k: dict(v) if isinstance(v, dict) else v.asDict() for k, v in dict(r["markers"] or {}).items()}
    return {f: r[f] or "" for f in dims.FIELDS} | {k: r[k] for k in KEYS} | {"ordinal": int(r["ordinal"]), "markers": markers}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[list(r[f.name].items()) if f.name == "markers" else r[f.name] for r in rows] for f in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fold_components(run_date: str, enriching: bool):
    """Folds one component after the other of rows that stand together by component and in order within it. Many small components
    share a batch; no more than one is held."""

    def done(component: int, fold: Fold) -> list[dict]:
        out = [{"kind": "record", "component": component, "seq": 0, "message": ""} | r for r in fold.kept]
        return out + [dict.fromkeys(dims.FIELDS, "") | {"kind": "log", "component": component, "ordinal": o, "seq": s, "message": m, "markers": {}} for o, s, m in fold.log]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = pa.struct([("kind", pa.string()), ("comment", pa.string())])
        schema = pa.schema([("kind", pa.string()), ("component", pa.int64()), ("ordinal", pa.int64()), ("seq", pa.int32()), ("message", pa.string()), *[(f, pa.string()) for f in dims.FIELDS], ("markers", pa.map_(pa.string(), marker))])
        component, fold, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if fold is None or r["component"] != component:
                    if fold is not None:
                        out += done(component, fold)
                    component, fold = r["component"], Fold(run_date, enriching)
                fold.add(plain_row(r), bool(r["given"]))
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, schema)
                    out = []
        if fold is not None:
            out += done(component, fold)
        for at in range(0, len(out), BATCH_ROWS):
            yield _batch(out[at : at + BATCH_ROWS], schema)

    return run


def fold(records: DataFrame, existing: DataFrame | None, run_date: str) -> tuple[DataFrame, DataFrame]:
    """(records, log). records and existing have `ordinal`, all fields and `markers`. Without existing, all records are merged
    into one directory; with it, existing ones are updated and never removed, and new ones without a name are dropped.

    Matching needs a near name and a compatible specialty, neither of which a fold changes but from blank, so components of
    near names fold apart with the same result as one fold over all. A component is folded by one task, which must hold its
    records; searches in it go through an index.
    """
    from rostra.plans.scratch import written

    spark = records.sparkSession
    given = records.withColumn("given", F.lit(False))
    if existing is not None:
        given = given.unionByName(existing.withColumn("given", F.lit(True)))
    grouped = keyed(match_groups(given.select("given", *RECORD_COLUMNS, "markers")))
    # by number: tasks merged by size would be few, and the fold is all CPU time
    dealt = grouped.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component").sortWithinPartitions("component", F.desc("given"), "ordinal")
    done = written(dealt.mapInArrow(fold_components(run_date, existing is not None), _OUT), "fold")
    return done.filter("kind = 'record'").select(*RECORD_COLUMNS, "markers"), done.filter("kind = 'log'").select(F.lit(0).alias("stage"), "ordinal", "seq", "message")
