"""Serving, upkeep of stored tables, house values, postal codes and decoded answers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as ru
from ..operators import listing as ls
from ..operators import serving as sv
from ..operators import valuation as val
from ..sources import registers as rg
from ..sources import views as v
from ..storage import shared_folder
from .market import _ACTIVE, _CARD, _CHEAP, _ONE, card, scored, served
from .regions import _UNITS, units
from .registry import query

# Pages.

_PAGED = f"WITH {v.AD}, f AS (SELECT * FROM ad WHERE {_ACTIVE} AND {_ONE} AND price <= 30000), p AS (SELECT *, row_number() OVER (ORDER BY {_CHEAP}, coalesce(dup_best::INT, 0) DESC, ingest_seq) AS place, count(*) OVER () AS total FROM f)"


@query("page_counted", f"{_PAGED} SELECT url, price, total FROM p WHERE place > 60 * (greatest(1, least(9999, (total + 59) // 60)) - 1)")
def page_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far beyond the last is the last, with the number of all rows."""
    rows, total = ls.counted_page(ls.Filters(price_max=30_000).apply(v.listings(spark, sf_dir)), "price_asc", 9999)
    return rows.select("url", "price", F.lit(total).cast("long").alias("total"))


@query("serving_mart", f"{v.LISTED} SELECT {_CARD} FROM scored")
def serving_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was published, read back."""
    return card(served(spark, sf_dir, "listings"))


@query("page_details", f"{v.LISTED}, page AS (SELECT url FROM scored WHERE {_ACTIVE} AND {_ONE} ORDER BY score DESC NULLS LAST, {_CHEAP}, ingest_seq LIMIT 60) SELECT l_partkey AS url, count(*) AS photos, round(sum(l_quantity), 2) AS size FROM lineitem WHERE l_partkey IN (SELECT url FROM page) GROUP BY l_partkey")
def page_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos of the listings of one page."""
    page = ls.page(ls.Filters().apply(scored(spark, sf_dir)))
    photos = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"), "l_quantity")
    return sv.of_page(page, photos)[0].groupBy("url").agg(F.count("*").alias("photos"), F.round(F.sum("l_quantity"), 2).alias("size"))


# Upkeep.

def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("url")).agg(F.count("*").alias("photos"))


_PHOTOS = "ph AS (SELECT l_partkey AS url, count(*) AS photos FROM lineitem GROUP BY l_partkey)"


@query("dup_marks", f"""WITH {v.AD}, {_PHOTOS}, m AS (SELECT url // 10 AS grp, url, price, coalesce(photos, 0) AS photos, portal FROM ad LEFT JOIN ph USING (url) WHERE url % 10 < 3),
g AS (SELECT grp, count(*) AS dup_count, arg_min(url, ROW(-photos, price, url)) AS principal, max(photos) AS dup_photos, min(price) AS dup_low, string_agg(url::VARCHAR, ',' ORDER BY price, url) AS members FROM m GROUP BY grp)
SELECT ad.url, g.grp AS dup_group, dup_count, ad.url = principal AS dup_best, dup_photos, round(dup_low, 2) AS dup_low, members FROM ad LEFT JOIN m ON m.url = ad.url LEFT JOIN g ON g.grp = m.grp""")
def dup_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = v.listings(spark, sf_dir)
    members = ads.where("url % 10 < 3").join(_photos(spark, sf_dir), "url", "left").select(F.expr("url div 10").alias("group"), "url", "price", F.coalesce("photos", F.lit(0)).alias("photos"), "portal")
    rows = sv.marked(ads, members)
    detail = F.from_json("dup_detail", "array<struct<price: double, url: bigint, portal: string, photos: bigint>>")
    members = F.when(F.col("dup_detail").isNotNull(), F.array_join(F.transform(detail, lambda x: x["url"].cast("string")), ","))
    return rows.select("url", "dup_group", "dup_count", "dup_best", "dup_photos", F.round("dup_low", 2).alias("dup_low"), members.alias("members"))


@query("purge", f"""WITH {v.AD}, kept AS (SELECT url, price, area_name FROM ad WHERE coalesce(price <= 60000 AND price >= 900, true) AND area_name IN ('Brand#1', 'Brand#2', 'Brand#13', 'Brand#24') AND NOT coalesce(has_problem, false))
SELECT k.url, area_name, (SELECT count(*) FROM lineitem WHERE l_partkey = k.url) AS photos FROM kept k""")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings outside of the wanted areas and prices, or of a refused kind, go with their photos."""
    gone = ~F.col("area_name").isin("Brand#1", "Brand#2", "Brand#13", "Brand#24") | ~ru.price_passes(F.col("price"), 900.0, 60_000.0) | F.col("has_problem")
    photos = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"))
    kept, left = sv.purged(v.listings(spark, sf_dir), gone, photos)
    counts = left.groupBy("url").agg(F.count("*").alias("photos"))
    return kept.join(counts, "url", "left").select("url", "area_name", F.coalesce("photos", F.lit(0)).alias("photos"))


_STATES = "s AS (SELECT *, CASE url % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS photo_ok, CASE url % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS detail_ok, CASE WHEN url % 3 > 0 THEN land END AS known_land FROM ad)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("url")
    return v.listings(spark, sf_dir).withColumns({"photo_ok": F.when(k % 5 == 1, 0).when(k % 5 > 1, 1), "detail_ok": F.when(k % 4 == 1, 0).when(k % 4 > 1, 1), "land": F.when(k % 3 > 0, F.col("land"))})


@query("pending", f"""WITH {v.AD}, {_STATES} SELECT 'analysis' AS step, url FROM s WHERE removed_at IS NULL AND photo_ok IS NULL UNION ALL SELECT 'failed', url FROM s WHERE removed_at IS NULL AND (photo_ok IS NULL OR photo_ok = 0)
UNION ALL SELECT 'details', url FROM s WHERE removed_at IS NULL AND coalesce(detail_ok, 0) = 0 AND known_land IS NULL UNION ALL SELECT 'portal', url FROM s WHERE removed_at IS NULL AND coalesce(detail_ok, 0) = 0 AND portal = 'PROMO'""")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _states(spark, sf_dir)
    parts = {"analysis": sv.pending_analysis(s), "failed": sv.pending_analysis(s, True), "details": sv.pending_details(s), "portal": sv.pending_details(s, False, "PROMO")}
    out = [df.select(F.lit(name).alias("step"), "url") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("known_urls", """WITH st AS (SELECT 'https://x.org/a-' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN '?s=' || o_orderkey WHEN 1 THEN '' ELSE '#top' END AS url FROM orders), q AS (SELECT c_custkey AS k, 'https://x.org/a-' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '?page=2' WHEN 1 THEN '#p' ELSE '' END AS url FROM customer)
SELECT k, url FROM q WHERE EXISTS (SELECT 1 FROM st WHERE st.url = q.url) OR EXISTS (SELECT 1 FROM st WHERE contains(st.url, '?') AND split_part(st.url, '?', 1) = split_part(split_part(q.url, '#', 1), '?', 1))""")
def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = v.table(spark, sf_dir, "orders").selectExpr("concat('https://x.org/a-', o_custkey, case o_orderkey % 3 when 0 then concat('?s=', o_orderkey) when 1 then '' else '#top' end) as url")
    asked = v.table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "concat('https://x.org/a-', c_custkey, case c_custkey % 4 when 0 then '?page=2' when 1 then '#p' else '' end) as url")
    return sv.stored_already(asked, stored).select("k", "url")


@query("audit_sample", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY md5('audit|' || o_orderkey), o_orderkey LIMIT 5")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.sampled(v.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_totalprice as price"), "id")


_DONE, _TODO = "upkeep IS NOT NULL AND url % 4 = 0", "upkeep IS NULL OR url % 4 = 1"


@query("reuse_plan", f"""WITH {v.AD}, g AS (SELECT dup_group, count(*) FILTER ({_DONE}) AS ok, count(*) FILTER ({_TODO}) AS todo FROM ad WHERE dup_group IS NOT NULL GROUP BY dup_group)
SELECT count(*) AS groups, count(*) FILTER (NOT (ok = 0 AND todo > 0) AND NOT (ok > 0 AND todo > 0)) AS complete, count(*) FILTER (ok > 0 AND todo > 0) AS mixed, count(*) FILTER (ok = 0 AND todo > 0) AS empty, (SELECT count(*) FROM ad WHERE {_TODO}) AS pending,
  coalesce(sum(todo) FILTER (ok > 0), 0)::BIGINT AS inherit, (SELECT count(*) FROM ad WHERE ({_TODO}) AND dup_group IS NULL) AS alone, count(*) FILTER (ok = 0 AND todo > 0) + (SELECT count(*) FROM ad WHERE ({_TODO}) AND dup_group IS NULL) AS needed FROM g""")
def reuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.reuse_plan(v.listings(spark, sf_dir), F.expr(_DONE), F.expr(_TODO))


@query("reuse_members", f"""WITH {v.AD}, {_PHOTOS}, a AS (SELECT ad.*, coalesce(photos, 0) AS photos FROM ad LEFT JOIN ph USING (url) WHERE dup_group IS NOT NULL), g AS (SELECT dup_group FROM a GROUP BY dup_group HAVING count(*) FILTER ({_DONE}) = 0)
SELECT dup_group, url FROM (SELECT dup_group, url, row_number() OVER (PARTITION BY dup_group ORDER BY photos DESC, url) AS place FROM a JOIN g USING (dup_group) WHERE {_TODO}) WHERE place = 1""")
def reuse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = v.listings(spark, sf_dir).join(_photos(spark, sf_dir), "url", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))
    return sv.best_members(ads, F.expr(_DONE), F.expr(_TODO))


_MEMBERS = "m AS (SELECT url // 10 AS grp, url, floor(price)::BIGINT AS price, area_name, street, 'lot ' || url AS title FROM ad)"
_NUMBERED = f"WITH {v.AD}, {_MEMBERS}, g AS (SELECT grp, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, min(area_name), grp) AS number FROM m GROUP BY grp), n AS (SELECT m.*, k, number FROM m JOIN g USING (grp))"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.listings(spark, sf_dir).select(F.expr("url div 10").alias("group"), "url", F.floor("price").alias("price"), "area_name", "street", F.concat(F.lit("lot "), "url").alias("title"))


@query("groups_csv", f"{_NUMBERED} SELECT number::VARCHAR AS number, url::VARCHAR AS url FROM n WHERE k > 1")
def groups_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups written as CSV and read back."""
    path = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    sv.write_groups(_members(spark, sf_dir), path)
    return sv.read_groups(spark, path)


@query("group_report", f"""{_NUMBERED} SELECT number, 0 AS place, 'GROUP ' || number || ' - ' || max(k) || ' listings | ' || arg_min(area_name, url) || ' | R$ ' || format('{{:,}}', min(price)) || ' to R$ ' || format('{{:,}}', max(price)) AS line FROM n GROUP BY number
UNION ALL SELECT number, row_number() OVER (PARTITION BY number ORDER BY price, url), 'R$ ' || format('{{:,}}', price) || ' | ' || title || ' | ' || url FROM n""")
def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.group_report(_members(spark, sf_dir))


# House values and postal codes.

_COMPLEMENT = "CASE number % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE 'CS ' || number END"
_LEAST = {"cep5": 40, "cep4": 20, "cep3": 10, "city": 1}


def _regions() -> list[tuple[str, Column]]:
    return [("cep5", F.expr("street div 8")), ("cep4", F.expr("street div 80")), ("cep3", F.col("street") % 5), ("city", F.lit("city"))]


def _levels_sql(source: str) -> str:
    keys = {"cep5": "street // 8", "cep4": "street // 80", "cep3": "street % 5", "city": "'city'"}
    return " UNION ALL ".join(f"SELECT '{level}' AS level, ({key})::VARCHAR AS region, unit, area, least FROM (SELECT *, {_LEAST[level]} AS least FROM {source})" for level, key in keys.items())


_HOUSES = f"""{_UNITS}, kind AS (SELECT *, trim(coalesce({_COMPLEMENT}, '')) = '' AS land FROM u), only_land AS (SELECT * FROM kind WHERE land), built AS (SELECT * FROM kind WHERE NOT land),
lv AS ({_levels_sql('only_land')}), bv AS ({_levels_sql('built')}),
lp AS (SELECT level, region, median(unit) AS price, median(area) AS ref FROM lv GROUP BY level, region HAVING count(*) >= max(least)), bp AS (SELECT level, region, median(unit) AS price FROM bv GROUP BY level, region HAVING count(*) >= max(least)), {v.AD},
h AS (SELECT url, street, land, area, [(street // 8)::VARCHAR, (street // 80)::VARCHAR, (street % 5)::VARCHAR, 'city'] AS keys FROM ad),
k AS (SELECT url, unnest(['cep5', 'cep4', 'cep3', 'city']) AS level, unnest(keys) AS region, unnest([1, 2, 3, 4]) AS rank FROM h),
l AS (SELECT url, arg_min(k.level, rank) AS land_level, arg_min(price, rank) AS p, arg_min(ref, rank) AS ref FROM k JOIN lp ON lp.level = k.level AND lp.region = k.region GROUP BY url),
b AS (SELECT url, arg_min(k.level, rank) AS building_level, arg_min(price, rank) AS q FROM k JOIN bp ON bp.level = k.level AND bp.region = k.region GROUP BY url),
w AS (SELECT url, land_level, building_level, land * p * pow(land / ref, -0.662) AS land_value, area * q AS building_value FROM h JOIN l USING (url) JOIN b USING (url))"""


@query("house_value", f"{_HOUSES} SELECT url, land_level, building_level, round(land_value, 2) AS land_value, round(building_value, 2) AS building_value, round(land_value + building_value, 2) AS value, round(100 * land_value / (land_value + building_value), 4) AS land_share FROM w")
def house_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land and building of each listing at the prices of the finest region that has them."""
    sold = units(spark, sf_dir).withColumn("is_land", val.is_land(F.expr(_COMPLEMENT)))
    prices = lambda df, column: val.region_prices(df, _regions(), column, _LEAST).select("level", "region", "median")
    land = sold.where("is_land")
    ref = prices(land, "area").withColumnRenamed("median", "ref")
    houses = v.listings(spark, sf_dir).select("url", "street", "land", F.col("area").alias("built"))
    out = val.house_values(houses, prices(land, "unit").join(ref, ["level", "region"]), prices(sold.where("not is_land"), "unit"), _regions(), "url")
    return out.select("url", "land_level", "building_level", *[F.round(c, 2).alias(c) for c in ("land_value", "building_value", "value")], F.round("land_share", 4).alias("land_share"))


_RAW_CODE = "CASE url % 4 WHEN 0 THEN lpad((1000000 + cep * 37)::VARCHAR, 8, '0') WHEN 1 THEN (1000000 + cep * 37)::VARCHAR WHEN 2 THEN '123' ELSE NULL END"


@query("postal_code_recovery", f"""WITH {v.AD}, st AS (SELECT l_partkey AS street, lpad((1000 + l_partkey * 3)::VARCHAR, 5, '0') AS code5, count(*) AS n FROM lineitem GROUP BY l_partkey),
r AS (SELECT url, street, {_RAW_CODE} AS raw FROM ad), c AS (SELECT *, regexp_replace(coalesce(raw, ''), '\\D', '', 'g') AS d FROM r), o AS (SELECT *, CASE WHEN length(d) = 8 THEN d WHEN length(d) = 7 THEN '0' || d ELSE '' END AS own FROM c)
SELECT url, CASE WHEN own <> '' THEN own WHEN n >= 3 THEN rpad(code5, 8, '0') ELSE '' END AS code, CASE WHEN own <> '' THEN 'anuncio' WHEN n >= 3 THEN 'rua' ELSE '' END AS origin FROM o LEFT JOIN st USING (street)""")
def postal_code_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    streets = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("street")).agg(F.count("*").alias("n")).withColumn("code5", F.lpad((1000 + F.col("street") * 3).cast("string"), 5, "0"))
    ads = v.listings(spark, sf_dir).withColumn("raw_code", F.expr(_RAW_CODE.replace("::VARCHAR", "").replace("(1000000 + cep * 37)", "string(1000000 + cep * 37)")))
    return val.effective_codes(ads, streets).select("url", "code", "origin")


@query("postal_code_lots", f"""WITH {v.AD}, lots AS (SELECT DISTINCT l_partkey AS street, l_suppkey AS number, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE lpad((l_partkey % 7 * 1000 + l_suppkey % 3)::VARCHAR, 8, '0') END AS code FROM lineitem),
a AS (SELECT url, street, CASE url % 4 WHEN 0 THEN lpad((street % 7 * 1000)::VARCHAR, 8, '0') WHEN 1 THEN lpad((street % 7 * 1000 + 9)::VARCHAR, 8, '0') WHEN 2 THEN '12' END AS raw FROM ad),
p AS (SELECT url, number, code, CASE WHEN length(raw) < 5 OR raw IS NULL OR code IS NULL THEN 0 WHEN code = raw THEN 8 WHEN left(code, 5) = left(raw, 5) THEN 5 ELSE 0 END AS alike FROM a JOIN lots USING (street))
SELECT url, number, code FROM (SELECT *, max(alike) OVER (PARTITION BY url) AS best FROM p) WHERE alike = best""")
def postal_code_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = v.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as street", "l_suppkey as number", "if(l_suppkey % 5 = 0, null, lpad(string(l_partkey % 7 * 1000 + l_suppkey % 3), 8, '0')) as code").distinct()
    ads = v.listings(spark, sf_dir).withColumn("raw_code", F.expr("case url % 4 when 0 then lpad(string(street % 7 * 1000), 8, '0') when 1 then lpad(string(street % 7 * 1000 + 9), 8, '0') when 2 then '12' end"))
    return val.lots_of_code(ads, lots)


# Decoded answers.

@query("yearly_links", "SELECT n_nationkey AS nation, y AS year, '/f/' || n_nationkey || '_(' || y || ').xlsx' AS link FROM nation, (SELECT unnest(range(2019, 2025)) AS y) WHERE (n_nationkey + y) % 4 > 0")
def yearly_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of links by year: a year's block ends at the next year, and file names hold brackets."""
    n = F.col("n_nationkey")
    block = lambda y: F.concat(y.cast("string"), F.lit(' (<a href="/f/'), F.when((n + y) % 4 > 0, F.concat(n, F.lit("_("), y, F.lit(").xlsx"))).otherwise("none.ods"), F.lit('">Excel</a>) (<a href="/f/x_'), y, F.lit('.ods">ODS</a>)\n'))
    html = F.concat(F.lit("<p>Guides of 2018</p>"), F.array_join(F.transform(F.sequence(F.lit(2024), F.lit(2019), F.lit(-1)), block), ""), F.lit('<p>see 2024 (<a href="/f/old.xlsx">old</a>)</p>'))
    pages = v.table(spark, sf_dir, "nation").select(n.alias("nation"), html.alias("html"))
    # A year without a spreadsheet of its own takes none but for the last remark, which isn't its first mark.
    return rg.yearly_links(pages).where(~F.col("link").endswith("old.xlsx")).select("nation", "year", "link")


@query("gml_lots", "SELECT s_suppkey AS request, (s_suppkey % 9)::VARCHAR AS block, s_suppkey::VARCHAR AS lot, 'R CORONEL ' || s_suppkey % 7 || ' NORTE' AS street, 'CORONEL ' || s_suppkey % 7 || ' NORTE' AS key, (s_suppkey % 300)::VARCHAR AS number, round(s_acctbal, 2) AS land FROM supplier WHERE s_suppkey % 6 > 0")
def gml_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    field = lambda name, value: F.concat(F.lit(f"<geoportal:{name}>"), value, F.lit(f"</geoportal:{name}>"))
    street = F.when(k % 6 > 0, F.concat(F.lit("R CORONEL "), (k % 7).cast("string"), F.lit(" NORTE"))).otherwise("")
    fields = F.concat(field("cd_quadra_fiscal", (k % 9).cast("string")), field("cd_lote", k.cast("string")), field("nm_logradouro_completo", street), field("cd_numero_porta", F.concat((k % 300).cast("string"), F.lit(" "))), field("qt_area_terreno", F.regexp_replace(F.col("s_acctbal").cast("string"), r"\.", ",")))
    xml = F.concat(F.lit("<gml:featureMembers><geoportal:lote_cidadao gml:id='1'>"), fields, F.lit("</geoportal:lote_cidadao></gml:featureMembers>"))
    lots = rg.gml_lots(v.table(spark, sf_dir, "supplier").select(k.alias("request"), xml.alias("xml")))
    return lots.select("request", "block", "lot", "street", "key", "number", F.round("land", 2).alias("land"))


@query("feature_centroids", "SELECT s_suppkey AS request, 'L' || s_suppkey AS lot, round(-46 - (s_suppkey % 90) * 0.01 + 0.0015, 6) AS lon, round(-23 - (s_suppkey % 70) * 0.01 + 0.0015, 6) AS lat FROM supplier WHERE s_suppkey % 5 < 4")
def feature_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares as polygons and multipolygons; points have no ring."""
    k = F.col("s_suppkey")
    x, y = -46 - (k % 90) * F.lit(0.01), -23 - (k % 70) * F.lit(0.01)
    corner = lambda dx, dy: F.array(x + F.lit(dx), y + F.lit(dy))
    ring = F.to_json(F.array(corner(0.0, 0.0), corner(0.003, 0.0), corner(0.003, 0.003), corner(0.0, 0.003), corner(0.0, 0.0)))
    shape = F.when(k % 5 < 2, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))).when(k % 5 < 4, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}"))).otherwise('{"type":"Point","coordinates":[1.0,2.0]}')
    data = F.concat(F.lit('{"features":[{"properties":{"cd_lote":"L'), k, F.lit('"},"geometry":'), shape, F.lit("}]}"))
    out = rg.feature_centroids(v.table(spark, sf_dir, "supplier").select(k.alias("request"), data.alias("data")))
    return out.select("request", F.element_at("properties", F.lit("cd_lote")).alias("lot"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("search_items", f"""WITH {v.AD} SELECT 'https://x.org/imovel/' || url || '/comprar/' AS url, area_name, area_name || ', Sao Tome' AS place, price, area AS built, rooms, CASE WHEN url % 3 = 0 THEN 'https://img.org/p' || url || '.jpg' ELSE 'https://img.org/crop/p' || url || '.jpg' END AS photo FROM ad WHERE url % 4 <> 3""")
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a portal's search: flats go, photo names get the site's address."""
    k = F.col("url")
    kinds = F.when(k % 4 == 0, "Casa").when(k % 4 == 1, " sobrado ").when(k % 4 == 2, "").otherwise("apartamento")
    photo = F.when(k % 3 == 0, F.concat(F.lit("https://img.org/p"), k, F.lit(".jpg"))).otherwise(F.concat(F.lit("/p"), k, F.lit(".jpg")))
    source = F.to_json(F.struct(k.cast("string").alias("id"), kinds.alias("type"), F.lit("").alias("neighbourhood"), F.col("area_name").alias("regionName"), F.lit("Sao Tome").alias("city"), F.col("price").alias("salePrice"), "area", F.col("rooms").alias("bedrooms"), F.array(F.lit(""), photo).alias("imageList")))
    out = rg.search_items(v.listings(spark, sf_dir).select(source.alias("source")), "source", "https://x.org", "https://img.org/crop/")
    return out.select("url", "area_name", "place", "price", "built", "rooms", F.get("photos", F.lit(0)).alias("photo"))


@query("map_places", f"""WITH {v.AD}, a AS (SELECT url, CASE url % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Rua ' || street || ', ' ELSE 'Rua B' END AS road, CASE WHEN url % 3 > 0 THEN area_name END AS area, CASE WHEN url % 5 = 0 THEN '01000-000' END AS code FROM ad),
b AS (SELECT url, regexp_replace(trim(coalesce(road, '')), '[\\s,]+$', '') AS r, coalesce(area, '') AS n, coalesce(code, '') AS code FROM a)
SELECT url, array_to_string(list_filter([CASE WHEN r <> '' THEN r ELSE n END, CASE WHEN r <> '' THEN n ELSE '' END, 'São Paulo, SP', code], lambda x: x <> ''), ', ') AS text, regexp_matches(r, '[0-9]') AS exact, r = '' AS area_only FROM b WHERE r <> '' OR n <> ''""")
def map_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("url")
    road = F.when(k % 4 == 1, F.concat(F.lit("Rua "), "street", F.lit(", "))).when(k % 4 > 1, "Rua B")
    place = ru.map_place(road, F.when(k % 3 > 0, F.col("area_name")), F.when(k % 5 == 0, "01000-000"))
    return v.listings(spark, sf_dir).select("url", place.alias("p")).where("p is not null").select("url", "p.text", "p.exact", "p.area_only")


@query("stored_contexts", f"WITH {v.AD} SELECT url, CASE WHEN url % 3 > 0 THEN street % 100 END AS metres, CASE WHEN url % 3 > 0 THEN 'lote' END AS precision FROM ad")
def stored_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts stored as JSON, with their precision; a listing without one has none."""
    data = F.when(F.col("url") % 3 > 0, F.to_json(F.struct((F.col("street") % 100).alias("metres"), F.lit("Sé").alias("station"))))
    c = ru.context_of(data, F.lit("lote"), "metres bigint, station string")
    return v.listings(spark, sf_dir).select("url", c.alias("c")).select("url", "c.context.metres", "c.precision")
