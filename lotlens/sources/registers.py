"""Answers of registers and portals that were fetched before: link pages, GML, GeoJSON and JSON searches, decoded as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.address import street_key, unaccent

# What a search calls houses.
HOUSE_KINDS = ["casa", "sobrado", "casa de vila", "casa de condomínio", "casa de condominio"]
LOT_LAYER, LOT_PREFIX = "lote_cidadao", "geoportal"


def yearly_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page columns, year, link: the first spreadsheet linked behind each year's mark '2024 (', before the next year's; a year's first mark with a link counts."""
    blocks = F.split(F.regexp_replace(F.col(html), r"\b(20\d{2})\s*\(", "\u0001$1\u0002"), "\u0001")
    marks = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.filter(blocks, lambda b: b.rlike("^20\\d{2}\u0002"))).alias("__at", "__block"))
    found = marks.select("*", F.substring("__block", 1, 4).cast("int").alias("year"), F.regexp_extract("__block", r'(?i)href="([^"]+\.xlsx)"', 1).alias("link")).where("link <> ''")
    keys = [c for c in pages.columns if c != html]
    return found.groupBy(*keys, "year").agg(F.min_by("link", "__at").alias("link"))


def refused(xml: Column) -> Column:
    """Why a map server refused a query; null where it answered."""
    reason = F.substring(F.regexp_extract(xml, r"<ows:ExceptionText>([^<]+)</ows:ExceptionText>", 1), 1, 120)
    error = F.contains(xml, F.lit("ExceptionReport")) | F.contains(xml, F.lit("<ows:Exception"))
    return F.when(error, F.coalesce(F.nullif(reason, F.lit("")), F.lit("no reason given")))


def gml_features(answers: DataFrame, xml: str = "xml", layer: str = LOT_LAYER, prefix: str = LOT_PREFIX) -> DataFrame:
    """Answer columns and fields, a map of each feature's fields. An error report fails the query: no rows would hide it."""
    checked = F.when(refused(F.col(xml)).isNotNull(), F.raise_error(F.concat(F.lit("the map server refused the query: "), refused(F.col(xml))))).otherwise(F.col(xml))
    features = F.regexp_extract_all(checked, F.lit(rf"(?s)<{prefix}:{layer} [^>]*>(.*?)</{prefix}:{layer}>"), F.lit(1))
    pattern = F.lit(rf"<{prefix}:(\w+)>([^<]*)</{prefix}:\w+>")
    rows = answers.select(*[c for c in answers.columns if c != xml], F.explode(features).alias("__f"))
    fields = F.map_from_arrays(F.regexp_extract_all("__f", pattern, F.lit(1)), F.regexp_extract_all("__f", pattern, F.lit(2)))
    return rows.withColumn("fields", fields).drop("__f").where(F.size("fields") > 0)


def gml_lots(answers: DataFrame, xml: str = "xml") -> DataFrame:
    """Answer columns and the lots' sector, block, lot, street, key, number, use, land, built. Lots without a street go."""
    text = lambda c: F.trim(F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")))
    area = lambda c: F.replace(text(c), F.lit(","), F.lit(".")).try_cast("double")
    found = gml_features(answers, xml)
    street = text("nm_logradouro_completo")
    return found.where(street != "").select(
        *[c for c in answers.columns if c != xml], text("cd_setor_fiscal").alias("sector"), text("cd_quadra_fiscal").alias("block"), text("cd_lote").alias("lot"), street.alias("street"), street_key(street, 1).alias("key"),
        F.regexp_replace(text("cd_numero_porta"), r"\D", "").alias("number"), text("dc_tipo_uso_imovel").alias("use"), area("qt_area_terreno").alias("land"), area("qt_area_construida").alias("built"),
    )


def lots_of_street(lots: DataFrame, street: Column) -> DataFrame:
    """What a search by one word of a street's name has found, without the lots of other streets."""
    return lots.where(F.col("key") == street_key(street, 1))


_FEATURES = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"


def feature_centroids(answers: DataFrame, data: str = "data") -> DataFrame:
    """Answer columns, properties, lon, lat: the centroid of each GeoJSON feature's outer ring, of a multipolygon the first's. Features without a usable ring go."""
    rows = answers.select(*[c for c in answers.columns if c != data], F.explode(F.from_json(data, _FEATURES)["features"]).alias("__f"))
    coordinates = F.when(F.col("__f.geometry.type") == "Polygon", F.from_json("__f.geometry.coordinates", "array<array<array<double>>>")[0]).when(
        F.col("__f.geometry.type") == "MultiPolygon", F.from_json("__f.geometry.coordinates", "array<array<array<array<double>>>>")[0][0]
    )
    placed = rows.withColumn("__c", g.centroid(coordinates)).where("__c is not null")
    return placed.select(*[c for c in answers.columns if c != data], F.col("__f.properties").alias("properties"), F.col("__c.lon").alias("lon"), F.col("__c.lat").alias("lat"))


def search_slug(area: Column, city: str = "São Paulo", state: str = "SP", country: str = "brasil") -> Column:
    """An area's name as a portal's search takes it."""
    text = F.lower(unaccent(F.concat_ws("-", area, F.lit(city), F.lit(state), F.lit(country))))
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("-")), "-+", "-"), F.lit("-"))


def search_body(slug: Column, page: Column, size: int = 36, kind: str = "HOUSE") -> Column:
    """The JSON body of one page of a search, newest first."""
    return F.to_json(
        F.struct(
            slug.alias("slug"), F.struct(F.lit("MOST_RECENT").alias("criteria")).alias("sorting"), F.struct(F.lit(size).alias("pageSize"), ((page - 1) * size).alias("offset")).alias("pagination"),
            F.struct(F.lit("SALE").alias("businessContext"), F.struct(F.array(F.lit(kind)).alias("houseTypes")).alias("houseSpecs")).alias("filters"),
        )
    )


_ITEM = "id string, type string, neighbourhood string, regionName string, city string, address string, salePrice double, area double, bedrooms double, bathrooms double, parkingSpaces double, suites double, imageList array<string>, amenities array<string>"


def search_items(items: DataFrame, source: str = "source", site: str = "", photos: str = "", city: str = "São Paulo") -> DataFrame:
    """Listings from a search's items: url, area_name, place, street, price, built, rooms, baths, parking, suites, photos, amenities. Items without an id, and of a
    kind that is no house, go; what isn't a number is null. site, photos: what addresses of listings and of photos begin with."""
    rows = items.select(F.from_json(source, _ITEM).alias("i")).select("i.*")
    text = lambda *cs: F.trim(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit("")))
    kind, area = F.lower(text("type")), text("neighbourhood", "regionName")
    town = F.coalesce(F.nullif(text("city"), F.lit("")), F.lit(city))
    full = lambda p: F.when(p.startswith("http"), p).otherwise(F.concat(F.lit(photos), F.regexp_replace(p, "^/+", "")))
    return rows.where((text("id") != "") & ((kind == "") | kind.isin(HOUSE_KINDS))).select(
        F.concat(F.lit(f"{site}/imovel/"), "id", F.lit("/comprar/")).alias("url"), area.alias("area_name"), F.when(area != "", F.concat(area, F.lit(", "), town)).otherwise(town).alias("place"), text("address").alias("street"),
        F.col("salePrice").alias("price"), F.col("area").alias("built"), F.col("bedrooms").cast("int").alias("rooms"), F.col("bathrooms").cast("int").alias("baths"), F.col("parkingSpaces").cast("int").alias("parking"), F.col("suites").cast("int").alias("suites"),
        F.transform(F.filter(F.coalesce("imageList", F.array().cast("array<string>")), lambda p: p != ""), full).alias("photos"), F.coalesce("amenities", F.array().cast("array<string>")).alias("amenities"),
    )
