"""Text functions, Column to Column, all of built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

# Patterns of the domain.
PHONE = r"(?U)(?:\+33\s*[\s.\-]?\s*|0)[\d\s.\-]{8,}"
PHONE_LABEL = r"(?iU)\(?\b(?:secrétariat|secretariat|accueil|standard|rdv)\b\)?"
PHONE_LABEL_COLON = r"(?U)(?:Secrétariat|Accueil)\s*:\s*"
EMAIL = r"(?U)[\w.\-]+@[\w.\-]+\.\w+"
ESTABLISHMENT = r"\b(?:chu|chru|hopital|hopitaux|centre\s+hospitalier|centre\s+de\s+reference|centre\s+de\s+competence)\b"
CITY_PREFIX = r"(?iU)^(?:CHU\s+(?:de\s+)?|CHRU\s+(?:de\s+)?|Centre\s+Hospitalier\s+(?:de\s+)?|Hôpital\s+|Hopital\s+)"
TRANSFER = r"(?iU)transfer[eé]+\s+(?:de|depuis)\b|\bmut[eé]+\b|ancienn?e?\s+affect"
SECRETARIAT = r"(?i)secretariat|accueil|standard"


def text(c: Column | str) -> Column:
    """Null as the empty string: fields are never null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Non-breaking spaces as spaces, no zero-width spaces, one space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text(c), " ​", " "), r"(?U)[\s\x1c-\x1f]+", " "))


@cache
def _accents() -> tuple[str, str]:
    """Characters that decompose to one character and marks, and those characters."""
    pairs = []
    for code in range(0x80, 0x10000):
        base = [x for x in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(x) != "Mn"] if not 0xD800 <= code < 0xE000 else []
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once for each row: as an argument that many branches name it would be computed in each of them."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(text(c), *_accents()), r"\p{Mn}", "")


def plain(value: str) -> str:
    """strip_accents of a Python string."""
    return "".join(x for x in unicodedata.normalize("NFD", value) if unicodedata.category(x) != "Mn")


def _phone(match: Column) -> Column:
    """One match as pairs of digits, null if it is no ten-digit number with a leading 0."""
    digits = F.regexp_replace(match, r"(?U)[^\d]", "")
    national = F.when(digits.startswith("33") & (F.length(digits) >= 11), F.concat(F.lit("0"), F.substring(digits, 3, 99))).otherwise(digits)
    ten = F.substring(national, 1, 10)
    return F.when((F.length(national) >= 10) & ten.startswith("0"), F.regexp_replace(ten, r"(..)(?=.)", "$1 "))


def phones(c: Column | str) -> Column:
    """All phone numbers in a text, formatted, each once, in order."""
    found = F.regexp_extract_all(clean_text(c), F.lit(PHONE), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, _phone), lambda p: p.isNotNull()))


def normalize_phone(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(clean_text(c), PHONE_LABEL, ""), PHONE_LABEL_COLON, "")
    found = F.regexp_extract_all(bare, F.lit(PHONE), F.lit(0))
    return F.array_join(F.array_distinct(F.filter(F.transform(found, _phone), lambda p: p.isNotNull())), " / ")


def emails(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(EMAIL), F.lit(0))


def clean_email(c: Column | str) -> Column:
    """Without remarks in brackets and a leading colon."""
    return F.regexp_replace(F.trim(F.regexp_replace(text(c), r"\(.*?\)", "")), r"^\s*:?\s*", "")


def compare_key(c: Column | str) -> Column:
    """Upper case, no accents, no hyphens or spaces."""
    return F.translate(strip_accents(F.upper(text(c))), "- ", "")


def hospital_key(c: Column | str) -> Column:
    """What is left of a hospital's name without accents, kind of establishment, `de` and marks."""
    s = F.regexp_replace(F.lower(strip_accents(c)), ESTABLISHMENT, " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\bd['\s]", " "), r"\bde\b", " ")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def title_case(c: Column | str) -> Column:
    """Each run of letters with its first letter in upper case (initcap would only see spaces)."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """table[key] or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_ville(c: Column | str, spellings: dict[str, str] = dims.CITY_SPELLINGS) -> Column:
    clean = clean_text(c)
    return F.coalesce(lookup(F.upper(clean), spellings), title_case(clean))


def normalize_city(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(clean_text(c), CITY_PREFIX, ""))


def section_city(c: Column | str, headers: dict[str, str] = dims.SECTION_CITIES) -> Column:
    """The city of a section header: the first known header that it contains, else what follows the establishment."""
    header = F.trim(text(c))
    rest = F.regexp_replace(header, r"(?iU)^(?:CHU\s+(?:d[e']\s*)?|CHRU\s+(?:de\s+)?|Centre\s+Hospitalier\s+(?:de\s+)?|Hôpital\s+)", "")
    known = [F.when(F.contains(F.lower(header), F.lit(k.lower())), F.lit(v)) for k, v in headers.items()]
    return F.coalesce(*known, F.trim(F.regexp_replace(F.trim(rest), r"^'+", "")))


def region_of(c: Column | str, regions: dict[str, str] = dims.REGIONS) -> Column:
    """Exact city, else the first known city that is a prefix of it or has it as a prefix; '' for none or no city."""

    def found(key: Column) -> Column:
        near = [F.when(key.startswith(k) | F.lit(k).startswith(key), F.lit(v)) for k, v in regions.items()]
        return F.coalesce(lookup(key, regions), *near, F.lit(""))

    return once(text(c), lambda x: F.when(x == "", F.lit("")).otherwise(once(F.trim(F.lower(x)), found)))


def any_of(c: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def is_sector_line(c: Column | str) -> Column:
    return text(c).rlike(r"(?iU)^Secteur\s+")


def sector_value(c: Column | str) -> Column:
    """The sector named by a sector line's value."""
    s = F.trim(F.regexp_replace(F.trim(text(c)), r":+$", ""))
    low = F.lower(s)
    child = any_of(low, "péd", "ped", "enfant")
    adult = any_of(low, "adulte")
    return F.when(adult & child, "Pediatrie et Adulte").when(child | any_of(low, "ado"), "Pediatrie").when(adult, "Adulte").when(s == "", "Non precise").otherwise(s)


def detect_sector(c: Column | str) -> Column:
    """The sector that a free text speaks of, '' if none."""
    low = F.lower(text(c))
    child, adult = any_of(low, "enfant", "pédiat", "pediatr"), any_of(low, "adulte")
    return F.when(child & adult, "Pediatrie et Adulte").when(child, "Pediatrie").when(adult, "Adulte").otherwise("")


def title_of(c: Column | str) -> Column:
    low = F.lower(text(c))
    return F.when(low == "", "").when(low.startswith("pr"), "Pr").otherwise("Dr")


def is_transfer(notes: Column | str, source: Column | str) -> Column:
    return strip_accents(F.concat_ws(" ", text(notes), text(source))).rlike(TRANSFER)


def completeness(*columns: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [(text(c) != "").cast("int") for c in columns or ("nom", "prenom", "hopital", "adresse", "telephone", "email")])


def union_sources(have: Column | str, new: Column | str) -> Column:
    """`A + B`: the sources listed in `have` and `new`, sorted; an empty `new` leaves `have` as it is."""
    listed = F.filter(F.transform(F.split(text(have), r"\+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(text(new) == "", text(have)).otherwise(F.array_join(F.array_sort(F.array_union(listed, F.array(F.trim(text(new))))), " + "))


def dedup_key(ville: Column | str = "ville", nom: Column | str = "nom", specialite: Column | str = "specialite") -> Column:
    return F.struct(strip_accents(F.upper(text(ville))).alias("ville"), compare_key(nom).alias("nom"), text(specialite).alias("specialite"))


def soft_row(notes: Column | str = "notes") -> Column:
    """Rows that the sink shades lightly."""
    return F.lower(text(notes)).rlike("pas de|idem|meme medecin")
