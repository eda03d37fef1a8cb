"""Texts of many forms through the functions on addresses, numbers, addresses of pages, answers and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as ad
from ..functions import geometry as g
from ..functions import numbers as nu
from ..functions import rules as ru
from ..operators import comparables as co
from ..operators import valuation as val
from ..sources import views as v
from ..streaming import crawl as cr
from .more import _HOUSE, _KEYED, _key_sql, _list
from .registry import query


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def _pick(words: list[str | None], k: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]).cast("array<string>"), (k % len(words)).cast("int"))


def _picked(words: list[str | None], k: str) -> str:
    items = ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words)
    return f"([{items}]::VARCHAR[])[({k} % {len(words)} + 1)::INT]"


# Addresses: every street type, abbreviation and title, with accents, particles, numbers and letters.

_TYPES = [*ad.STREET_TYPES, *ad.SHORT_TYPES, "Praça", "rua", ""]
_WORDS = [*ad.CADASTRE_WORDS, *ad.FISCAL_WORDS, *ad.TITLES, "São José", "de", "Ângelo", "D'Ávila", ""]
_LAST = ["Silva", "das Flores", "do Ó", "Conceição", "", "Dr Pe"]
_ENDS = [", 12", " 7b", ", 0", " 123456", "", ", 45 A", " S/N", ";9"]
_ADDRESS = f"concat_ws(' ', {_picked(_TYPES, 'c_custkey')}, {_picked(_WORDS, '(c_custkey // 3)')}, {_picked(_LAST, '(c_custkey // 5)')}) || {_picked(_ENDS, 'c_custkey')}"
_TERM = f"""list_filter(string_split({_key_sql(ad.CADASTRE_WORDS)}, ' '), lambda x: len(x) >= 3)"""


@query("street_key_levels", f"""WITH l AS (SELECT c_custkey AS id, {_ADDRESS} AS line FROM customer), {_KEYED}, m AS (SELECT *, {_TERM} AS long FROM c), o AS (SELECT *, list_filter(long, lambda x: x NOT IN ({_list(ad.TITLES)[1:-1]})) AS own FROM m),
p AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE long END AS choice FROM o)
SELECT id, array_to_string(k, ' ') AS name, {_key_sql({})} AS key, {_key_sql(ad.CADASTRE_WORDS)} AS tolerant, {_key_sql(ad.CADASTRE_WORDS | ad.FISCAL_WORDS)} AS canonical, {_HOUSE} AS number,
  coalesce(list_filter(choice, lambda x: len(x) = list_max(list_transform(choice, lambda y: len(y))))[1], '') AS term FROM p""")
def street_key_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    line = F.concat(F.concat_ws(" ", _pick(_TYPES, k), _pick(_WORDS, F.expr("k div 3")), _pick(_LAST, F.expr("k div 5"))), _pick(_ENDS, k))
    rows = _customers(spark, sf_dir).select(k.alias("id"), line.alias("line"))
    at = F.col("line")
    return rows.select("id", ad.street_name(at).alias("name"), ad.street_key(at).alias("key"), ad.street_key(at, 1).alias("tolerant"), ad.street_key(at, 2).alias("canonical"), ad.house_number(at).alias("number"), ad.search_term(at).alias("term"))


_CODES = ["01310-100", "1310100", "123", "", "a0131-0100", None, "013101000", "05662-00", "5662000"]


@query("postal_codes", f"""WITH r AS (SELECT c_custkey AS k, {_picked(_CODES, 'c_custkey')} AS raw FROM customer), d AS (SELECT *, regexp_replace(coalesce(raw, ''), '\\D', '', 'g') AS d FROM r), c AS (SELECT *, CASE length(d) WHEN 8 THEN d WHEN 7 THEN '0' || d ELSE '' END AS code FROM d)
SELECT k, code, left(CASE WHEN code <> '' THEN code ELSE d END, 5) AS prefix FROM c""")
def postal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(_CODES, F.col("k"))
    return _customers(spark, sf_dir).select("k", ad.postal_code(raw).alias("code"), ad.postal_prefix(raw).alias("prefix"))


_PARTS = ["Rua A, 12", "Rua B 007c ", "Av. 9", "Rua 12 de Maio, 0045", "", None, "Rua C,,  3 B", "x12"]


@query("number_parts", f"WITH r AS (SELECT c_custkey AS k, {_picked(_PARTS, 'c_custkey')} AS raw, {_picked(['007', ' 12', '0', 'a1', None, '00', '1020x'], 'c_custkey')} AS n FROM customer) SELECT k, trim(regexp_replace(coalesce(raw, ''), '[,\\s]+[0-9]+\\s*[A-Za-z]?\\s*$', '')) AS street, regexp_extract(coalesce(n, ''), '^\\s*0*([0-9]+)', 1) AS bare FROM r")
def number_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _customers(spark, sf_dir).select("k", ad.street_part(_pick(_PARTS, k)).alias("street"), ad.number_without_zeros(_pick(["007", " 12", "0", "a1", None, "00", "1020x"], k)).alias("bare"))


# Numbers and dates.

_NUMBERS, _DATES = ["1,5", " 2 ", "x", "", None, "-3,25", "10.5"], ["2024-02-29", "29/02/2024", "2023-02-29", "x", "31/12/1999 10:00", None, "2020-01-05T10:00"]


@query("lenient_values", f"""WITH r AS (SELECT c_custkey AS k, {_picked(_NUMBERS, 'c_custkey')} AS n, {_picked(_DATES, 'c_custkey')} AS d, (c_custkey * 7919 % 90000) + 0.3::DOUBLE AS m FROM customer)
SELECT k, coalesce(try_cast(replace(trim(n), ',', '.') AS DOUBLE), 0.0) AS number, strftime(coalesce(try_strptime(left(d, 10), '%Y-%m-%d'), try_strptime(left(d, 10), '%d/%m/%Y')), '%Y%m%d') AS day, 'R$ ' || replace(format('{{:,}}', (m * 100)::BIGINT), ',', '.') AS money,
  CASE WHEN m < 1000 THEN m::BIGINT || ' m' ELSE replace(format('{{:.1f}}', round(m / 1000, 1)), '.', ',') || ' km' END AS far, greatest(ceil(m / 80), 1)::INT AS minutes FROM r""")
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    m = k * 7919 % 90_000 + F.lit(0.3)
    return _customers(spark, sf_dir).select("k", nu.lenient_number(_pick(_NUMBERS, k)).alias("number"), nu.any_date(_pick(_DATES, k)).alias("day"), nu.money(m * 100).alias("money"), nu.distance_text(m).alias("far"), nu.walking_minutes(m).alias("minutes"))


@query("built_areas", r"""WITH d AS (SELECT doc_id, n_chars % 400 + 20 AS m, left(text, 60) AS said, doc_id % 7 AS form FROM documents),
t AS (SELECT *, CASE WHEN form % 2 = 0 THEN m || ',5' ELSE m::VARCHAR END AS n FROM d),
s AS (SELECT doc_id, form, m, n, CASE form WHEN 0 THEN 'casa com ' || n || ' m² de construção' WHEN 1 THEN n || 'm2 de área construída' WHEN 2 THEN 'construída em ' || n || 'm2, nova' WHEN 3 THEN 'Construção: 1.' || lpad((m % 1000)::VARCHAR, 3, '0') || ' m²' WHEN 4 THEN 'terreno ' || n || ' m²' WHEN 5 THEN n || ' m2 de construção e construção de 99 m²' END AS line FROM t)
SELECT doc_id, CASE WHEN form IN (4, 6) OR line IS NULL THEN NULL WHEN form = 3 THEN 1000 + m % 1000 ELSE replace(n, ',', '.')::DOUBLE END::DOUBLE AS built FROM s""")
def built_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built areas that a sentence of each document's own number states; a lot's area is none."""
    m, form = F.col("n_chars") % 400 + 20, F.col("doc_id") % 7
    n = F.when(form % 2 == 0, F.concat(m.cast("string"), F.lit(",5"))).otherwise(m.cast("string"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = F.when(form == 0, said("casa com ", n, " m² de construção")).when(form == 1, said(n, "m2 de área construída")).when(form == 2, said("construída em ", n, "m2, nova")).when(form == 3, said("Construção: 1.", F.lpad((m % 1000).cast("string"), 3, "0"), " m²"))
    line = line.when(form == 4, said("terreno ", n, " m²")).when(form == 5, said(n, " m2 de construção e construção de 99 m²"))
    return v.table(spark, sf_dir, "documents").select("doc_id", ru.built_area(line).alias("built"))


# Addresses of pages and photos.

_PAGE_SQL = r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9]+', '-', 'g'), '-') AS words FROM pages),
a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://x.org/propriedades/' || words || '-' || (1000000 + page_id) || '.html?n=1' WHEN 2 THEN 'https://x.org/propriedades/' || words || '-a-' || (1000000 + page_id) || '.html#p' ELSE 'https://x.org/propriedades/' || replace(words, '-', '_') || '.html' END AS url,
  CASE page_id % 7 WHEN 0 THEN 'https://i.org/a/360x266/' || page_id || '.jpg?x=1' WHEN 1 THEN 'https://i.org/' || words || '.jpg' WHEN 2 THEN 'https://i.org/thumbs700x500/p/' || page_id || '.webp?v=2' WHEN 3 THEN '//i.org/' || page_id || '.jpg' WHEN 4 THEN 'https://i.org/Left-Arrow-' || page_id || '.png' WHEN 5 THEN 'https://i.org/' || page_id || '.SVG' END AS photo FROM p),
t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '/propriedades/([^/?#]+)\.html', 1), '-a?-\d{6,}$', ''), '-\d{6,}$', ''), '[-_]+', ' ', 'g')) AS title, split_part(photo, '?', 1) AS bare FROM a)"""


@query("url_rules", rf"""{_PAGE_SQL} SELECT page_id, upper(left(title, 1)) || lower(substr(title, 2)) AS title, right(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), 60) || '_' || left(md5(url), 8) AS slug,
  CASE WHEN regexp_matches(bare, '/\d+x\d+/[^/]+$') THEN regexp_replace(bare, '/\d+x\d+/([^/]+)$', '/1200x900/\1') ELSE regexp_replace(bare, '^(.*/)?([^/]*)$', '\g1200x900/\2') END AS sized,
  regexp_replace(regexp_replace(bare, '/thumbs\d+x\d+/', '/images/', 'g'), '\.[^.]*$', '.jpg') AS large, coalesce(starts_with(photo, 'http') AND NOT ends_with(lower(photo), '.svg') AND NOT regexp_matches(photo, '(?i)(arrow|logo|placeholder|sprite)'), false) AS usable,
  'https://r.org/image.jpg?action=fit-in&dimension=1200x900&p=' || page_id AS filled FROM t""".replace(r"\g1200x900", r"\11200x900"))
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, folders and photos of addresses that are made of the pages' titles and numbers."""
    k, form = F.col("page_id").cast("string"), F.col("page_id") % 4
    words = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[^A-Za-z0-9]+", "-"), F.lit("-"))
    number = (F.col("page_id") + 1_000_000).cast("string")
    listing = lambda name, end: F.concat(F.lit("https://x.org/propriedades/"), name, *end)
    url = F.when(form == 0, F.col("url")).when(form == 1, listing(words, [F.lit("-"), number, F.lit(".html?n=1")])).when(form == 2, listing(words, [F.lit("-a-"), number, F.lit(".html#p")])).otherwise(listing(F.replace(words, F.lit("-"), F.lit("_")), [F.lit(".html")]))
    shape = F.col("page_id") % 7
    at = lambda before, name, after: F.concat(F.lit(before), name, F.lit(after))
    photo = F.when(shape == 0, at("https://i.org/a/360x266/", k, ".jpg?x=1")).when(shape == 1, at("https://i.org/", words, ".jpg")).when(shape == 2, at("https://i.org/thumbs700x500/p/", k, ".webp?v=2")).when(shape == 3, at("//i.org/", k, ".jpg"))
    photo = photo.when(shape == 4, at("https://i.org/Left-Arrow-", k, ".png")).when(shape == 5, at("https://i.org/", k, ".SVG"))
    rows = v.table(spark, sf_dir, "pages").select("page_id", url.alias("url"), photo.alias("photo"))
    template = F.concat(F.lit("https://r.org/{description}.jpg?action={action}&dimension={width}x{height}&p="), k)
    return rows.select("page_id", ru.title_from_url(F.col("url")).alias("title"), nu.folder_slug(F.col("url")).alias("slug"), ru.sized_photo(F.col("photo")).alias("sized"), ru.large_photo(F.col("photo")).alias("large"), ru.usable_photo(F.col("photo")).alias("usable"), ru.filled_photo(template).alias("filled"))


_CITY_FORMS = ["São Paulo", "SAO PAULO - SP", "Osasco", "Grande São Paulo", "são paulo/sp", ""]
_FORMS_SQL = "[" + ", ".join(f"'{c}'" for c in _CITY_FORMS) + "]"
_KEY = lambda x: f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '-', ' '), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("place_rules", rf"""WITH w AS (SELECT doc_id, n_chars, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: NOT contains(x, ',')) AS ws FROM documents),
n AS (SELECT doc_id, coalesce(ws[1], '') AS a, coalesce(ws[2], '') AS b, {_FORMS_SQL}[doc_id % 6 + 1] AS city FROM w),
p AS (SELECT *, a || ' ' || b AS found, [b || '-' || a || ' sul', left(a, 3) || ' ' || left(b, 4), 'Vila Sônia'] AS targets, CASE WHEN doc_id % 5 = 0 THEN city WHEN city = '' THEN a || ' ' || b ELSE a || ' ' || b || ',  ' || city END AS place, CASE doc_id % 3 WHEN 0 THEN city || ', ' || a || ', ' || b WHEN 1 THEN a || ',' || b ELSE b END AS local FROM n),
q AS (SELECT *, trim(CASE WHEN contains(place, ',') THEN list_last(string_split(place, ',')) ELSE place END) AS c, trim(regexp_replace(local, '\s+', ' ', 'g')) AS l, list_transform(targets, lambda t: {_KEY('t')}) AS tk, {_KEY('found')} AS fk FROM p),
r AS (SELECT *, list_filter(list_transform(string_split(l, ','), lambda x: trim(x)), lambda x: x <> '') AS parts, list_sort(list_distinct(string_split(fk, ' '))) AS wf, list_transform(tk, lambda t: list_sort(list_distinct(string_split(t, ' ')))) AS wt FROM q)
SELECT doc_id, strip_accents(lower(c)) = '' OR starts_with(strip_accents(lower(c)), 'sao paulo') AS inside, trim(regexp_replace(regexp_replace(upper(replace(strip_accents(found), 'ß', 'SS')), '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS key,
  targets[list_position(list_transform([1, 2, 3], lambda i: fk = '' OR tk[i] = '' OR fk = tk[i] OR len(list_intersect(wf, wt[i])) IN (len(wf), len(wt[i])) OR len(wf) = len(wt[i]) AND len(list_filter(range(1, len(wf) + 1), lambda k: starts_with(wf[k], wt[i][k]) OR starts_with(wt[i][k], wf[k]))) = len(wf)), true)] AS target,
  CASE WHEN l = '' THEN 'São Paulo' WHEN len(parts) >= 2 AND starts_with(strip_accents(lower(parts[1])), 'sao paulo') THEN array_to_string(parts[2:], ', ') || ', ' || parts[1] WHEN NOT contains(l, ', ') THEN l || ', São Paulo' ELSE l END AS ordered,
  CASE WHEN doc_id % 4 = 0 THEN false ELSE NOT regexp_matches(found || ' em ' || city, '(?i)s[ãa]o paulo') END AS fallback FROM r""")
def place_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places made of each document's first words and a city in several spellings."""
    ws = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda x: ~F.contains(x, F.lit(",")))
    word = lambda i: F.coalesce(F.get(F.col("ws"), F.lit(i)), F.lit(""))
    rows = v.table(spark, sf_dir, "documents").select("doc_id", ws.alias("ws")).select("doc_id", word(0).alias("a"), word(1).alias("b"), _pick(_CITY_FORMS, F.col("doc_id")).alias("city"))
    a, b, city, k = F.col("a"), F.col("b"), F.col("city"), F.col("doc_id")
    found = F.concat(a, F.lit(" "), b)
    targets = F.array(F.concat(b, F.lit("-"), a, F.lit(" sul")), F.concat(F.substring(a, 1, 3), F.lit(" "), F.substring(b, 1, 4)), F.lit("Vila Sônia"))
    place = F.when(k % 5 == 0, city).when(city == "", found).otherwise(F.concat(found, F.lit(",  "), city))
    local = F.when(k % 3 == 0, F.concat(city, F.lit(", "), a, F.lit(", "), b)).when(k % 3 == 1, F.concat(a, F.lit(","), b)).otherwise(b)
    title = F.when(k % 4 > 0, F.concat(found, F.lit(" em "), city))
    return rows.select("doc_id", ru.in_city(place).alias("inside"), ad.area_key(found).alias("key"), ru.target_area(found, targets).alias("target"), ru.address_order(local, "São Paulo").alias("ordered"), ru.fallback_title(title).alias("fallback"))


_TRIS, _SURE = ["sim", " S", "NÃO", "n", "talvez", "yes", "no", ""], ["Alta", "média", "", "?"]
_DOOR = ["", "0", "00", " ", "nº ", "12345"]


@query("vision_answers", rf"""WITH d AS (SELECT doc_id, {_picked(_DOOR, 'doc_id')} || (n_chars % 400) || CASE doc_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN ' c' ELSE '' END AS door, {_picked(_TRIS, 'doc_id')} AS yard, {_picked(_SURE, 'doc_id')} AS sure, (n_chars % 17) / 2.0 - 1 AS grade, lang, source FROM documents),
j AS (SELECT *, '{{"yard": "' || yard || '", "grade": ' || grade || ', "door": "' || door || '", "more": {{"sure": "' || sure || '"}}, "seen": ' || CASE doc_id % 3 WHEN 0 THEN '["' || upper(lang) || ' ", "", "x"]' WHEN 1 THEN '" ' || lang || ',, ' || source || '"' ELSE 'null' END || '}}' AS body FROM d),
a AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN body WHEN 1 THEN E'said:\n```json\n' || body || E'\n``` {{"yard": "sim"}}' WHEN 2 THEN 'here: ' || body || ' and {{"yard": "x"}}' WHEN 3 THEN 'none {{ at all' END AS answer FROM j),
o AS (SELECT doc_id, regexp_extract(CASE WHEN contains(answer, '```') THEN regexp_extract(answer, '(?s)```(?:json)?\s*(.*?)```', 1) ELSE answer END, '(?s)\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}') AS o FROM a),
x AS (SELECT doc_id, CASE WHEN o <> '' THEN o::JSON END AS o FROM o),
y AS (SELECT doc_id, lower(trim(o->>'$.yard')) AS yard, round_even((o->>'$.grade')::DOUBLE, 0) AS grade, upper(replace(trim(o->>'$.door'), ' ', '')) AS door, replace(lower(trim(o->>'$.more.sure')), 'é', 'e') AS sure,
  CASE json_type(o->'$.seen') WHEN 'ARRAY' THEN (o->'$.seen')::VARCHAR[] WHEN 'VARCHAR' THEN string_split(o->>'$.seen', ',') ELSE [] END AS seen FROM x),
z AS (SELECT *, CASE WHEN regexp_matches(door, '^\d{{1,5}}[A-Z]?$') AND regexp_matches(door, '^0*[1-9]') THEN regexp_replace(door, '^0+', '') ELSE '' END AS number FROM y)
SELECT doc_id, CASE WHEN yard IN ('sim', 's', 'true', 'yes', '1') THEN true WHEN yard IN ('nao', 'não', 'n', 'false', 'no', '0') THEN false END AS tri, CASE WHEN grade IS NOT NULL THEN greatest(0, least(5, grade)) END::INT AS grade, number,
  CASE WHEN number = '' THEN '' WHEN sure IN ('alta', 'media', 'baixa') THEN sure ELSE 'baixa' END AS certainty, array_to_string(list_filter(list_transform(seen, lambda s: lower(trim(s))), lambda s: s <> ''), '|') AS seen FROM z""")
def vision_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in JSON with each document's numbers: bare, in a fence, with text around them, or none."""
    k = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    door = text(_pick(_DOOR, k), (F.col("n_chars") % 400).cast("string"), F.when(k % 4 == 0, "b").when(k % 4 == 1, " c").otherwise(""))
    seen = F.when(k % 3 == 0, text('["', F.upper("lang"), ' ", "", "x"]')).when(k % 3 == 1, text('" ', F.col("lang"), ",, ", F.col("source"), '"')).otherwise("null")
    body = text('{"yard": "', _pick(_TRIS, k), '", "grade": ', ((F.col("n_chars") % 17) / 2.0 - 1).cast("string"), ', "door": "', door, '", "more": {"sure": "', _pick(_SURE, k), '"}, "seen": ', seen, "}")
    rows = v.table(spark, sf_dir, "documents").select(k, body.alias("body"))
    answer = F.when(k % 5 == 0, F.col("body")).when(k % 5 == 1, text("said:\n```json\n", F.col("body"), '\n``` {"yard": "sim"}')).when(k % 5 == 2, text("here: ", F.col("body"), ' and {"yard": "x"}')).when(k % 5 == 3, "none { at all")
    at = lambda path: F.try_variant_get("o", path, "string")
    return rows.select("doc_id", ru.json_object(answer).alias("o")).select(
        "doc_id", ru.tri_state(at("$.yard")).alias("tri"), ru.upkeep_grade(at("$.grade")).alias("grade"), ru.seen_number(at("$.door")).alias("number"), ru.number_certainty(at("$.door"), at("$.more.sure")).alias("certainty"),
        F.array_join(ru.answer_list(F.try_variant_get("o", "$.seen", "variant")), "|").alias("seen"),
    )


@query("formatted_values", r"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars * 1731.0::DOUBLE WHEN 1 THEN n_chars + 0.25::DOUBLE WHEN 2 THEN n_chars / 7.0::DOUBLE END AS x, CASE doc_id % 3 WHEN 0 THEN lpad((doc_id * 7919)::VARCHAR, 11, '0') WHEN 1 THEN '123.' || lpad(doc_id::VARCHAR, 7, '0') || '-5' END AS n FROM documents),
t AS (SELECT *, replace(format('{:,.0f}', x), ',', '.') AS whole, translate(format('{:,.1f}', x), ',.', '.,') AS one, regexp_replace(coalesce(n, ''), '[^0-9]', '', 'g') AS d FROM r)
SELECT doc_id, coalesce('R$ ' || whole, 'Preço a consultar') AS price, CASE WHEN x IS NULL THEN '—' WHEN x >= 1000000 THEN 'R$ ' || replace(format('{:.2f}', x / 1000000), '.', ',') || ' mi' WHEN x >= 1000 THEN 'R$ ' || format('{:.0f}', x / 1000) || ' mil' ELSE 'R$ ' || format('{:.0f}', x) END AS short,
  coalesce(whole || ' m²', '?') AS area, CASE WHEN x IS NULL THEN '?' WHEN x = floor(x) THEN whole ELSE one END AS number, CASE WHEN length(d) = 11 THEN d[1:3] || '.' || d[4:6] || '.' || d[7:10] || '-' || d[11:] ELSE coalesce(n, '') END AS register FROM t""")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, areas, numbers and register numbers as pages show them."""
    k, n = F.col("doc_id"), F.col("n_chars")
    x = F.when(k % 4 == 0, n * F.lit(1731.0)).when(k % 4 == 1, n + F.lit(0.25)).when(k % 4 == 2, n / F.lit(7.0))
    code = F.when(k % 3 == 0, F.lpad((k * 7919).cast("string"), 11, "0")).when(k % 3 == 1, F.concat(F.lit("123."), F.lpad(k.cast("string"), 7, "0"), F.lit("-5")))
    rows = v.table(spark, sf_dir, "documents").select("doc_id", x.alias("x"), code.alias("n"))
    at = F.col("x")
    return rows.select("doc_id", nu.price_text(at).alias("price"), nu.short_money(at).alias("short"), nu.area_text(at).alias("area"), nu.number_text(at).alias("number"), nu.register_text(F.col("n")).alias("register"))


# Lines, as arithmetic on a plane.

@query("line_geometry", """WITH p AS (SELECT c_custkey AS k, -46.6 + (c_custkey % 37) * 0.0003 AS lon, -23.5 + (c_custkey % 23) * 0.0002 AS lat FROM customer), s AS (SELECT *, 111320.0 * cos(radians(lat)) AS kx FROM p),
e AS (SELECT *, [[-46.601, -23.501, -46.597, -23.499], [-46.597, -23.499, -46.595, -23.502]] AS edges FROM s),
d AS (SELECT k, kx, lon, lat, unnest(edges) AS e FROM e), t AS (SELECT *, greatest(0.0, least(1.0, ((lon - e[1]) * kx * (e[3] - e[1]) * kx + (lat - e[2]) * 110540.0 * (e[4] - e[2]) * 110540.0) / (pow((e[3] - e[1]) * kx, 2) + pow((e[4] - e[2]) * 110540.0, 2)))) AS t FROM d),
m AS (SELECT k, e[1] = -46.601 AS first, sqrt(pow((lon - e[1] - t * (e[3] - e[1])) * kx, 2) + pow((lat - e[2] - t * (e[4] - e[2])) * 110540.0, 2)) AS metres FROM t)
SELECT k, round(min(metres) FILTER (first), 3) AS segment, round(min(metres), 3) AS line, round((-46.6 + (k % 37) * 0.0003 + 0.001)::DOUBLE, 6) AS lon, round((-23.5 + (k % 23) * 0.0002 + 0.002)::DOUBLE, 6) AS lat, round((-46.6 + (k % 37) * 0.0003 + 0.002)::DOUBLE, 6) AS maxx FROM m GROUP BY k""")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to a line of two segments; centroid and bounds of a rectangle at each point."""
    rows = _customers(spark, sf_dir).selectExpr("k", "-46.6D + (k % 37) * 0.0003D as lon", "-23.5D + (k % 23) * 0.0002D as lat")
    lon, lat = F.col("lon"), F.col("lat")
    point = lambda x, y: F.array(F.lit(x), F.lit(y))
    a, b, c = point(-46.601, -23.501), point(-46.597, -23.499), point(-46.595, -23.502)
    corner = lambda dx, dy: F.array(lon + dx, lat + dy)
    ring = F.array(corner(0.0, 0.0), corner(0.002, 0.0), corner(0.002, 0.004), corner(0.0, 0.004), corner(0.0, 0.0))
    middle, box = g.centroid(ring), g.bounds(ring)
    return rows.select("k", F.round(g.segment_distance(lat, lon, a, b), 3).alias("segment"), F.round(g.line_distance(lat, lon, F.array(a, b, c)), 3).alias("line"), F.round(middle["lon"], 6).alias("lon"), F.round(middle["lat"], 6).alias("lat"), F.round(box["maxx"], 6).alias("maxx"))


# Sales and prices.

@query("financed_sales", "SELECT l_orderkey AS orderkey, l_linenumber AS number, (trim(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN 'SFH' WHEN l_linenumber % 3 = 1 THEN '  ' END, '')) <> '' OR coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_tax END, 0) > 0.05) AND 2008 + l_linenumber >= 2011 AS financed FROM lineitem")
def financed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    amount = F.when((F.col("l_suppkey") % 2 == 0) & (F.col("l_tax") > 0.05), F.col("l_tax"))
    return v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), n.alias("number"), co.financed(F.when(n % 3 == 0, "SFH").when(n % 3 == 1, "  "), amount, 2008 + n).alias("financed"))


@query("changed_prices", f"WITH {v.AD} SELECT url, price + CASE url % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 0 END AS price FROM ad WHERE url % 3 = 1 OR url % 5 = 0")
def changed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all listings against known ones: a fifth is unknown, a third has moved by more than the change."""
    ads, k = v.listings(spark, sf_dir), F.col("url")
    batch = ads.select("url", (F.col("price") + F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 1.5).otherwise(0.0)).alias("price"))
    return cr.changed_prices(ads.where("url % 5 <> 0").select("url", "price"), batch)


@query("placed_values", "WITH o AS (SELECT o_custkey % 5 AS part, o_totalprice::DOUBLE - 50000 AS x FROM orders UNION ALL SELECT 9, o_custkey % 2 - 1 FROM orders), s AS (SELECT part, list_sort(list(x)) AS v FROM o GROUP BY part) SELECT part, len(v) AS n, v[1] AS low, v[((len(v) - 1) // 3)::INT + 1] AS third, v[len(v)] AS high FROM s")
def placed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at places of sorted groups: negative ones, and a group of two different values."""
    o = v.table(spark, sf_dir, "orders")
    rows = o.selectExpr("o_custkey % 5 as part", "double(o_totalprice) - 50000 as x").unionByName(o.selectExpr("9L as part", "double(o_custkey % 2 - 1) as x"))
    return val.placed_values(rows, ["part"], "x", {"low": lambda n: F.lit(0), "third": lambda n: F.floor((n - 1) / 3), "high": lambda n: n - 1})
