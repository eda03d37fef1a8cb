"""Rules on listing texts as column expressions. Keyword lists are parameters; the defaults are the portals' words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import bound, search_text, squeeze, unaccent, unaccented
from .numbers import brazilian_number

# Accepted cities, and words in addresses of drawings.
CITIES = ("sao paulo",)
NO_PHOTO = ["right-arrow", "left-arrow", "arrow", "logo", "placeholder", "sprite"]
# Words for and against a yard.
YARD_WORDS = ["quintal", "chão de terra", "chao de terra", "terra batida", "terreno amplo", "fundo amplo", "amplo quintal", "área externa", "area externa", "jardim"]
NO_YARD_WORDS = ["sem quintal", "quintal cimentado", "quintal todo cimentado"]
# Words of flats and of houses.
FLAT_WORDS = ["apartamento", "kitnet", "kit net", "studio", "loft", "flat", "cobertura", "garden", "quitnete"]
HOUSE_WORDS = ["casa", "sobrado", "sobradinho", "terrea", "casa de vila", "casa de condominio", "chacara"]
# Words about financing.
FINANCE_STEM, FINANCEABLE = "financ", ["financiável", "financiavel"]
NO_FINANCE = ["não aceita financiamento", "nao aceita financiamento", "sem financiamento", "não financia", "nao financia", "somente à vista", "somente a vista"]
ACCEPTING = ["aceita", "aceitamos", "possibilita", "permite", "viabiliza", "sujeito a", "aprovado", "combinar", "disponível para", "disponivel para", "faz", "trabalhamos com"]
ADVERTISING = ["simule", "simulação", "simulacao", "simulador", "melhores taxas", "consiga", "documentação necessária", "documentacao necessaria", "como conseguir", "saiba mais"]


def holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def keyword_score(text: Column, wanted: list[str] = YARD_WORDS, unwanted: list[str] = NO_YARD_WORDS) -> Column:
    """One for each wanted word in the text, less two for each unwanted one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.contains(low, F.lit(w)).cast("int") for w in wanted] + [F.contains(low, F.lit(w)).cast("int") * -2 for w in unwanted]
    return reduce(lambda a, b: a + b, found)


def kind_of_listing(text: Column, flats: list[str] = FLAT_WORDS, houses: list[str] = HOUSE_WORDS) -> Column:
    """Words of flats come before words of houses; else 'incerto'."""
    plain = search_text(F.coalesce(text, F.lit("")))
    return F.when(holds(plain, flats), "apartamento").when(holds(plain, houses), "casa").otherwise("incerto")


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


_NUMBER, _UNIT = r"(\d+(?:[.,]\d+)*)", r"(?:m²|m2|mts|metros?)"


def land_area(text: Column, land: str = "terreno", lot: str = "lote", front: str = "frente", by: str = "(?:por|e|x|×)", low: float = 20.0, high: float = 100_000.0) -> Column:
    """The land area that a text states: after or before the word for land, after the word for lot, or as a product of two sides; the first within bounds."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d),\s+(\d)", "$1,$2")
    sides, depth = rf"{_NUMBER}\s*[x×]\s*{_NUMBER}\s*{_UNIT}", rf"{_NUMBER}\s*(?:m|metros?)?\s*de\s*{front}\s*{by}\s*{_NUMBER}"
    stated = [rf"{land}[^\d]{{0,30}}?{_NUMBER}\s*{_UNIT}", rf"{_NUMBER}\s*{_UNIT}\s*(?:d[eoa]s?\s*)?{land}", rf"{lot}[^\d]{{0,20}}?{_NUMBER}\s*{_UNIT}"]
    pairs = F.array(*[F.array(_captured(t, p), F.lit("1")) for p in stated], *[F.array(_captured(t, p), _captured(t, p, 2)) for p in (sides, depth)])
    areas = F.transform(pairs, lambda p: brazilian_number(p[0]) * brazilian_number(p[1]))
    return F.get(F.filter(areas, lambda a: a.between(low, high)), F.lit(0))


def built_area(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d),\s+(\d)", "$1,$2")
    stated = [rf"{_NUMBER}\s*m[²2]\s*de\s*(?:área\s*)?constru", rf"constru[íi]d[ao][^\d]{{0,15}}?{_NUMBER}\s*m[²2]", rf"constru[çc][ãa]o[^\d]{{0,15}}?{_NUMBER}\s*m[²2]"]
    return brazilian_number(F.coalesce(*[_captured(t, p) for p in stated]))


def accepts_financing(
    text: Column, pill: Column | None = None, stem: str = FINANCE_STEM, refusing: list[str] = NO_FINANCE, accepting: list[str] = ACCEPTING, advertising: list[str] = ADVERTISING, certain: list[str] = FINANCEABLE
) -> Column:
    """True, false, or null where the text doesn't say.

    A refusal anywhere decides. Then the first sentence about financing that isn't advertising, and that accepts by
    its own words or by those of the sentence before it. Then the words that are certain anywhere.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    sentences = F.filter(F.transform(F.split(low, r"[.;\n!?]"), lambda s: F.trim(s)), lambda s: s != "")
    before = F.concat(F.array(F.lit("")), sentences)
    said = F.exists(F.zip_with(sentences, before, lambda s, b: s.isNotNull() & F.contains(s, F.lit(stem)) & ~holds(s, advertising) & (holds(s, accepting) | holds(b, accepting))), lambda x: F.coalesce(x, F.lit(False)))
    out = F.when(holds(low, refusing), False).when(F.contains(low, F.lit(stem)) & (said | holds(low, certain)), True)
    return out if pill is None else F.when(pill, True).otherwise(out)


def _unmarked(text: Column) -> Column:
    return F.lower(unaccent(text))


def in_city(place: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """The part behind the last comma is an accepted city, or begins with its name; an empty place passes."""
    city = _unmarked(F.trim(F.substring_index(F.coalesce(place, F.lit("")), ",", -1)))
    return (city == "") | reduce(lambda a, b: a | b, [city.startswith(unaccented(c).lower()) for c in cities])


def area_agrees(found: Column, wanted: Column) -> Column:
    """Equal keys, or one name's words all among the other's, or as many words that in order begin alike; a missing name passes."""
    a, b = search_text(F.coalesce(found, F.lit(""))), search_text(F.coalesce(wanted, F.lit("")))
    wa, wb = F.array_sort(F.array_distinct(F.split(a, " "))), F.array_sort(F.array_distinct(F.split(b, " ")))
    subset = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    alike = F.forall(F.zip_with(wa, wb, lambda x, y: F.coalesce(x.startswith(y) | y.startswith(x), F.lit(False))), lambda x: x)
    return (a == "") | (b == "") | (a == b) | subset | ((F.size(wa) == F.size(wb)) & alike)


def target_area(found: Column, targets: Column) -> Column:
    """The first of the targets that agrees with the found name; null if none does."""
    return F.get(F.filter(targets, lambda t: area_agrees(found, t)), F.lit(0))


def price_passes(price: Column, low: float | None = None, high: float | None = None) -> Column:
    """A missing price passes, for the user to look at; a bound that isn't set doesn't count."""
    inside = F.lit(True)
    if low:
        inside = inside & (price >= low)
    if high:
        inside = inside & (price <= high)
    return price.isNull() | inside


def fallback_title(title: Column, city: str = "s[ãa]o paulo") -> Column:
    """A page whose title lacks the city is the national fallback; without a title there is no telling."""
    return (F.coalesce(title, F.lit("")) != "") & ~F.coalesce(title, F.lit("")).rlike(f"(?iu){city}")


def canonical_url(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def title_from_url(url: Column) -> Column:
    """The name of a listing's page as a title: no trailing number, hyphens as spaces; empty for other addresses."""
    slug = F.regexp_extract(F.coalesce(url, F.lit("")), r"/propriedades/([^/?#]+)\.html", 1)
    bare = F.regexp_replace(F.regexp_replace(slug, r"-a?-\d{6,}$", ""), r"-\d{6,}$", "")
    words = F.trim(F.regexp_replace(bare, r"[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def sized_photo(url: Column, size: str = "1200x900") -> Column:
    """The photo's address with the wanted size in front of the file's name."""
    bare = F.substring_index(url, "?", 1)
    has = bare.rlike(r"/\d+x\d+/[^/]+$")
    return F.when(has, F.regexp_replace(bare, r"/\d+x\d+/([^/]+)$", f"/{size}/$1")).otherwise(F.regexp_replace(bare, r"^(.*/)?([^/]*)$", f"$1{size}/$2"))


def large_photo(url: Column) -> Column:
    """A thumbnail's address as that of the large image."""
    bare = F.regexp_replace(F.substring_index(url, "?", 1), r"/thumbs\d+x\d+/", "/images/")
    return F.regexp_replace(bare, r"\.[^.]*$", ".jpg")


def filled_photo(template: Column, width: int = 1200, height: int = 900) -> Column:
    """A photo template with its places filled; null as empty."""
    out = F.coalesce(template, F.lit(""))
    for place, value in {"{description}": "image", "{action}": "fit-in", "{width}": str(width), "{height}": str(height)}.items():
        out = F.replace(out, F.lit(place), F.lit(value))
    return out


def usable_photo(url: Column) -> Column:
    """An address of a photo, and not of the site's own drawings."""
    return F.coalesce(url.startswith("http") & ~F.lower(url).endswith(".svg") & ~url.rlike(f"(?i)({'|'.join(NO_PHOTO)})"), F.lit(False))


def address_order(address: Column, city: str = "", cities: tuple[str, ...] = CITIES) -> Column:
    """'City, area' becomes 'area, city' where the first part begins with a city's name. Other addresses get the city behind them, if it is given and they
    have no two parts; an empty address is the city."""
    local = squeeze(F.coalesce(address, F.lit("")))

    def ordered(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
        first = _unmarked(F.get(parts, F.lit(0)))
        known = reduce(lambda a, b: a | b, [first.startswith(unaccented(c).lower()) for c in cities])
        turned = F.concat(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ", "), F.lit(", "), F.get(parts, F.lit(0)))
        out = F.when((F.size(parts) >= 2) & known, turned)
        if city:
            out = out.when(~F.contains(text, F.lit(", ")), F.concat(text, F.lit(f", {city}")))
        return F.when(text == "", city).otherwise(out.otherwise(text))

    return bound(local, ordered)


# Decoding of the vision model's answer.

def tri_state(answer: Column) -> Column:
    key = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(key.isin("sim", "s", "true", "yes", "1"), True).when(key.isin("nao", "não", "n", "false", "no", "0"), False)


def upkeep_grade(answer: Column) -> Column:
    grade = F.bround(answer.try_cast("double"), 0).cast("int")
    return F.when(grade.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), grade)))


def json_object(answer: Column) -> Column:
    """What stands in a fence, else the whole answer, as VARIANT; if that isn't JSON, its first object with balanced braces; null if there is none."""

    def balanced(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(acc: Column, c: Column) -> Column:
            depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            at = acc["at"] + 1
            return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(acc["end"]).alias("end"))

        tail = F.when(F.contains(text, F.lit("{")), F.substr(text, F.locate("{", text)))
        return bound(tail, lambda t: F.substr(t, F.lit(1), F.aggregate(F.split(t, ""), start, step, lambda acc: acc["end"])))

    def parsed(text: Column) -> Column:
        return F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.try_parse_json(F.nullif(balanced(text), F.lit(""))))

    fenced = F.trim(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1))
    return parsed(F.when(F.contains(answer, F.lit("```")) & (fenced != ""), fenced).otherwise(F.trim(answer)))


def seen_number(answer: Column) -> Column:
    """A house number of one to five digits, not all zero, and perhaps a letter, without leading zeros; empty for anything else."""
    text = F.upper(F.replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""), F.lit(" "), F.lit("")))
    return F.when(text.rlike(r"^(?=\d{1,5}[A-Z]?$)0*[1-9]"), F.regexp_replace(text, "^0+", "")).otherwise("")


def number_certainty(number: Column, certainty: Column) -> Column:
    """alta, media or baixa for a number that was read, baixa if nothing else is said; empty without a number."""
    said = F.translate(F.lower(F.regexp_replace(F.coalesce(certainty, F.lit("")), r"^\s+|\s+$", "")), "é", "e")
    return F.when(seen_number(number) == "", "").when(said.isin("alta", "media", "baixa"), said).otherwise("baixa")


def answer_list(answer: Column) -> Column:
    """The names in an answer, a VARIANT: a list's, or a text's between commas; in lower case, without empty ones."""
    listed, text = F.try_variant_get(answer, "$", "array<string>"), F.try_variant_get(answer, "$", "string")
    names = F.when(F.schema_of_variant(answer).startswith("ARRAY"), listed).when(F.schema_of_variant(answer) == "STRING", F.split(text, ","))
    trimmed = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")))
    return F.filter(trimmed, lambda x: x != "")


# Places.

def map_place(street: Column, area: Column, code: Column, city: str = "São Paulo, SP") -> Column:
    """struct(text, address, exact, area_only) for a map: what to look for, and whether it points to a house; null without street and area."""
    road = F.regexp_replace(F.trim(F.coalesce(street, F.lit(""))), r"[\s,]+$", "")
    named = F.trim(F.coalesce(area, F.lit("")))

    def place(r: Column) -> Column:
        parts = F.array(F.when(r != "", r).otherwise(named), F.when(r != "", named).otherwise(""), F.lit(city), F.coalesce(code, F.lit("")))
        text = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
        return F.when((r != "") | (named != ""), F.struct(text.alias("text"), r.alias("address"), r.rlike(r"\d").alias("exact"), (r == "").alias("area_only")))

    return bound(road, place)


def context_of(data: Column, precision: Column, schema: str) -> Column:
    """A stored JSON context as a struct of the schema, with its precision."""
    parsed = F.from_json(data, schema)
    return F.when(data.isNotNull(), F.struct(parsed.alias("context"), precision.alias("precision")))
