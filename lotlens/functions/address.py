"""Street names, house numbers and postal codes as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folded() -> tuple[str, str]:
    """Characters that stand for one ASCII character by compatibility decomposition and those, and marks that go."""
    pairs, marks = [], []
    for c in map(chr, [*range(0xA0, 0x2200), *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if unicodedata.combining(c):
            marks.append(c)
        elif len(plain) == 1 and plain.isascii():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folded()

# Spellings of street types and their short form.
STREET_TYPES = {
    "AVENIDA": "AV", "AVEN": "AV", "ESTRADA": "EST", "ALAMEDA": "AL", "TRAVESSA": "TRV", "RODOVIA": "ROD", "VIELA": "VL",
    "PRACA": "PC", "LARGO": "LGO", "VIADUTO": "VD", "VILA": "VL", "RUA": "R",
}
SHORT_TYPES = ["R", "AV", "AL", "PC", "TRV", "EST", "ROD", "VL", "LGO", "VD"]
PARTICLES = ["DE", "DA", "DO", "DAS", "DOS", "E"]
# Abbreviations of the cadastre, and those that the tax register adds.
CADASTRE_WORDS = {
    "GAL": "GENERAL", "CON": "CONEGO", "COMEN": "COMENDADOR", "COMEND": "COMENDADOR", "PROF": "PROFESSOR", "PROFA": "PROFESSORA",
    "MAL": "MARECHAL", "BRIG": "BRIGADEIRO", "CEL": "CORONEL", "TEN": "TENENTE", "CAP": "CAPITAO", "SEN": "SENADOR",
    "DEP": "DEPUTADO", "DES": "DESEMBARGADOR", "MIN": "MINISTRO", "PRES": "PRESIDENTE", "ENG": "ENGENHEIRO", "ARQ": "ARQUITETO",
    "PE": "PADRE", "STA": "SANTA", "STO": "SANTO",
}
FISCAL_WORDS = {
    "DR": "DOUTOR", "DRA": "DOUTORA", "S": "SAO", "SRA": "SENHORA", "N": "NOSSA", "VISC": "VISCONDE", "BAR": "BARAO",
    "CONS": "CONSELHEIRO", "MONS": "MONSENHOR", "COM": "COMENDADOR", "ALM": "ALMIRANTE", "SGT": "SARGENTO", "MAJ": "MAJOR",
    "GOV": "GOVERNADOR", "VER": "VEREADOR", "EMB": "EMBAIXADOR", "FR": "FREI", "IR": "IRMA", "MQ": "MARQUES", "BR": "BRASIL",
}
# Titles that tell streets apart badly.
TITLES = [
    "GENERAL", "MARECHAL", "BRIGADEIRO", "CORONEL", "TENENTE", "CAPITAO", "SENADOR", "DEPUTADO", "PROFESSOR", "PROFESSORA",
    "PRESIDENTE", "MINISTRO", "ENGENHEIRO", "ARQUITETO", "COMENDADOR", "DESEMBARGADOR", "DOUTOR", "PADRE",
]


def unaccent(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def unaccented(text: str) -> str:
    return text.translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :]))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_text(text: Column) -> Column:
    """Lower case, no accents, hyphens as spaces, no other marks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(unaccent(text)), "-", " "), r"[^a-z0-9 ]", " "))


def area_key(name: Column) -> Column:
    """A neighbourhood's name as a key; null as empty."""
    return squeeze(F.regexp_replace(F.upper(unaccent(F.coalesce(name, F.lit("")))), r"[^A-Z0-9 ]", " "))


def _mapped(words: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(entries, w), w))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that it uses more than once: the value is computed once a row, not once a use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def street_words(street: Column) -> Column:
    """The words of a street's canonical name: no trailing number, street type short, no particles."""
    text = F.regexp_replace(F.upper(unaccent(F.coalesce(street, F.lit("")))), r"[,;]?\s*\d+\s*[A-Z]?$", "")
    split = F.filter(F.split(squeeze(F.regexp_replace(text, r"[^A-Z0-9 ]", " ")), " "), lambda w: w != "")

    def bare(words: Column) -> Column:
        typed = F.when(F.size(words) > 0, F.concat(_mapped(F.slice(words, 1, 1), STREET_TYPES), F.slice(words, F.lit(2), F.size(words)))).otherwise(words)
        return bound(F.filter(typed, lambda w: ~w.isin(PARTICLES)), lambda b: F.when(F.size(b) > 0, b).otherwise(words))

    return bound(split, bare)


def street_name(street: Column) -> Column:
    return F.array_join(street_words(street), " ")


def _key(words: Column, tolerance: int) -> Column:
    table = [{}, CADASTRE_WORDS, CADASTRE_WORDS | FISCAL_WORDS][tolerance]
    untyped = lambda w: F.when(F.get(w, F.lit(0)).isin(SHORT_TYPES), F.slice(w, F.lit(2), F.size(w))).otherwise(w)
    return F.array_join(bound(_mapped(words, table) if table else words, untyped), " ")


def street_key(street: Column, tolerance: int = 0) -> Column:
    """The name without its type. tolerance 1 spells out the cadastre's abbreviations, 2 the tax register's too."""
    return _key(street_words(street), tolerance)


def street_name_and_key(street: Column, tolerance: int = 0) -> Column:
    """A struct of name and key, whose words are made once."""
    return bound(street_words(street), lambda w: F.struct(F.array_join(w, " ").alias("name"), _key(w, tolerance).alias("key")))


def search_term(street: Column) -> Column:
    """The longest word of three letters or more that isn't a title, the first of equal ones; else the longest."""

    def chosen(words: Column) -> Column:
        own = F.filter(words, lambda w: ~w.isin(TITLES))
        return bound(F.when(F.size(own) > 0, own).otherwise(words), lambda c: F.get(F.filter(c, lambda w: F.length(w) == F.array_max(F.transform(c, F.length))), F.lit(0)))

    return F.coalesce(bound(F.filter(F.split(street_key(street, 1), " "), lambda w: F.length(w) >= 3), chosen), F.lit(""))


def postal_code(raw: Column) -> Column:
    """Eight digits; seven get a leading zero; anything else is empty."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 8, digits).when(F.length(digits) == 7, F.lpad(digits, 8, "0")).otherwise("")


def postal_prefix(raw: Column) -> Column:
    code = postal_code(raw)
    return F.substring(F.when(code != "", code).otherwise(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")), 1, 5)


def house_number(street: Column) -> Column:
    """One to five digits, and a letter, at the end behind a space; 0 is no number."""
    pattern = r",?\s+(\d{1,5})\s*([A-Za-z])?\s*$"
    text = F.trim(F.coalesce(street, F.lit("")))
    digits = F.regexp_extract(text, pattern, 1)
    return F.when(digits.isin("", "0"), "").otherwise(F.concat(digits, F.upper(F.regexp_extract(text, pattern, 2))))


def street_part(street: Column) -> Column:
    """The street in front of a number at the end."""
    return F.trim(F.regexp_replace(F.coalesce(street, F.lit("")), r"[,\s]+\d+\s*[A-Za-z]?\s*$", ""))


def number_without_zeros(number: Column) -> Column:
    return F.regexp_extract(F.coalesce(number, F.lit("")), r"^\s*0*(\d+)", 1)
