"""Person names and labelled cells, Column to Column, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .text import clean_text, strip_accents, text

# Patterns of the domain.
TITLE = r"(?iU)^(Pr(?:ofesseur)?|Dr)\s+"
NAME_SEPARATOR = r"(?U)\s*(?:[-–]\s+|\s+[-–]\s*|\s*/\s*|\s*&\s*|\s+et\s+|\s*,\s+)(?=[A-ZÀ-ÖÙ-Ý])"
NOT_A_NAME = r"(?iU)^(?:ou\s+|idem|pas\s+de|en\s+)"
LABEL = r"(?iU)(NOM\s*[–\-]\s*PRENOM|Hôpital de rattachement|Hopital de rattachement|Adresse postale|Téléphone|Telephone|Adresse mail|Email|Secteur)\s*:\s*"
#: Part of a label in lower case, and the label's field, first match wins.
LABEL_FIELDS = [("nom", "nom"), ("hôpital", "hopital"), ("hopital", "hopital"), ("adresse postale", "adresse"), ("téléphone", "telephone"), ("telephone", "telephone"), ("adresse mail", "email"), ("email", "email"), ("secteur", "secteur")]


def _name_key(c: Column) -> Column:
    return F.translate(F.lower(strip_accents(c)), "- ", "")


def is_first_name(word: Column, lexicon: Sequence[str] = dims.FIRST_NAMES) -> Column:
    """A known first name, or a hyphenated compound of known ones."""
    known = lambda c: _name_key(c).isin(list(lexicon))
    parts = F.filter(F.split(word, "[- ]"), lambda p: p != "")
    return known(word) | ((F.size(parts) > 1) & F.forall(parts, known))


def is_upper(word: Column) -> Column:
    """Without hyphens in upper case, a letter first."""
    core = F.translate(word, "-", "")
    return (core != "") & (core == F.upper(core)) & core.rlike(r"^\p{L}")


def normalize_name(c: Column | str, lexicon: Sequence[str] = dims.FIRST_NAMES) -> Column:
    """struct(titre, nom, prenom). `NOM, Prenom`; else upper-case words are the surname where there are others; else the
    first word is, unless only the first word is a known first name."""
    whole = clean_text(c)
    titre = F.regexp_extract(whole, TITLE, 1)
    rest = F.trim(F.regexp_replace(whole, TITLE, ""))
    words = F.split(rest, " ")
    upper, lower = F.filter(words, is_upper), F.filter(words, lambda w: ~is_upper(w))
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    n = F.size(words)
    tail, head = F.array_join(F.slice(words, F.lit(2), n), " "), F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    swapped = (n > 1) & is_first_name(first, lexicon) & ~is_first_name(last, lexicon)
    of = lambda nom, prenom: F.struct(nom.alias("nom"), prenom.alias("prenom"))
    name = (
        F.when(rest == "", of(F.lit(""), F.lit("")))
        .when(F.contains(rest, F.lit(", ")), of(F.upper(F.substring_index(rest, ", ", 1)), F.trim(F.regexp_replace(rest, "^.*?, ", ""))))
        .when((F.size(upper) > 0) & (F.size(lower) > 0), of(F.array_join(upper, " "), F.array_join(lower, " ")))
        .when(F.size(upper) > 0, of(first, tail))
        .when(swapped, of(F.upper(last), head))
        .otherwise(of(F.upper(first), tail))
    )
    short = F.when(titre == "", "").when(F.lower(titre).startswith("pr"), "Pr").otherwise("Dr")
    return F.struct(short.alias("titre"), name["nom"].alias("nom"), name["prenom"].alias("prenom"))


def split_names(c: Column | str) -> Column:
    """The single names of a cell that names several people; qualifiers go, a lone word belongs to the name before it. All
    gone: the cell itself; an empty cell: no names."""
    whole = clean_text(c)
    parts = F.transform(F.split(whole, NAME_SEPARATOR), lambda p: F.trim(F.regexp_replace(F.trim(p), ",+$", "")))
    parts = F.filter(parts, lambda p: (p != "") & ~p.rlike(NOT_A_NAME))
    titled = r"(?iU)^(?:Dr|Pr)\s"

    def add(names: Column, part: Column) -> Column:
        bare = F.trim(F.regexp_replace(part, r"(?iU)^(?:Dr|Pr|Professeur)\s+", ""))
        joins = (F.size(names) > 0) & ~F.contains(bare, F.lit(" ")) & ~part.rlike(titled)
        before = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
        return F.when(joins, F.concat(before, F.array(F.concat(F.element_at(names, -1), F.lit(", "), part)))).otherwise(F.concat(names, F.array(part)))

    names = F.aggregate(parts, F.array().cast("array<string>"), add)
    return F.when(F.size(names) > 0, names).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def label_field(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.coalesce(*[F.when(F.contains(low, F.lit(part)), F.lit(field)) for part, field in LABEL_FIELDS], low)


def split_labels(c: Column | str) -> Column:
    """array<struct<label, value>> of a cell: text before the first label is `prefix`, a cell without labels `raw`."""
    whole = clean_text(c)
    marked = F.split(F.regexp_replace(whole, LABEL, "\u0001$1\u0002"), "\u0001")
    pair = lambda label, value: F.struct(label.alias("label"), F.trim(value).alias("value"))
    labelled = F.transform(F.slice(marked, F.lit(2), F.size(marked)), lambda p: pair(label_field(F.substring_index(p, "\u0002", 1)), F.substring_index(p, "\u0002", -1)))
    prefix = F.filter(F.array(pair(F.lit("prefix"), F.get(marked, F.lit(0)))), lambda p: p["value"] != "")
    raw = F.array(pair(F.lit("raw"), whole))
    return F.when(text(whole) == "", F.slice(raw, 1, 0)).when(F.size(marked) > 1, F.concat(prefix, labelled)).otherwise(raw)
