"""Duplicates, streams, texts, pages, space and tables that are merged."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as ad
from ..functions import numbers as nu
from ..functions import rules as ru
from ..functions import scores as sc
from ..operators import duplicates as du
from ..operators import listing as ls
from ..operators import spatial as sp
from ..operators import upserts as up
from ..operators import valuation as val
from ..sources import pages as pg
from ..sources import views as v
from ..streaming import crawl as cr
from .registry import query

# Hashes: the signs of the embeddings.

BITS = "h AS (SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0 END))::HUGEINT AS hash FROM embeddings)"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("hash"))


_NEAR = f"WITH RECURSIVE {BITS}, near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 18)"


@query("hamming_pairs", f"{_NEAR} SELECT a, b, distance FROM near")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return du.all_alike(hashes(spark, sf_dir), 18)


@query("duplicate_groups", f"""{_NEAR}, e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a) SELECT id, min(root) AS grp FROM r GROUP BY id""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return du.groups(du.alike(hashes(spark, sf_dir), 18)).withColumnRenamed("group", "grp")


# Events as sightings.

@query("seen_registry", "SELECT user_id AS url, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY user_id")
def seen_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    whole = up.seen(up.seen(None, e.where("url % 2 = 0")), e.where("url % 2 = 1"))
    return whole.select("url", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("new_badge", """WITH s AS (SELECT user_id AS url, min(ts)::DATE + CASE WHEN user_id % 5 = 0 THEN 29 ELSE 0 END::INT AS d FROM events GROUP BY user_id)
SELECT url, d::VARCHAR AS first_day, d > (SELECT min(d) FROM s) AND d >= DATE '2024-01-30' - 1 AS is_new FROM s""")
def new_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url")).agg(F.min(F.to_date("ts")).alias("d"))
    moved = e.select("url", F.date_add("d", F.when(F.col("url") % 5 == 0, 29).otherwise(0)).alias("first_seen"))
    return ls.newly_seen(moved, F.lit("2024-01-30").cast("date")).select("url", F.col("first_seen").cast("string").alias("first_day"), "is_new")


_PAGES = """p AS (SELECT event_type AS key, event_id // 40 AS page, count(*) FILTER (value > 18) AS news FROM events GROUP BY ALL)"""


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.expr("event_id div 40").alias("page")).agg(F.count_if(F.col("value") > 18).alias("news"))


@query("stop_rule", f"""WITH {_PAGES}, i AS (SELECT *, sum((news > 0)::INT) OVER (PARTITION BY key ORDER BY page) AS island FROM p),
s AS (SELECT key, page, news, CASE WHEN news > 0 THEN 0 ELSE sum((news = 0)::INT) OVER (PARTITION BY key, island ORDER BY page) END::INT AS streak FROM i)
SELECT key, page, news, streak, coalesce(max((streak >= 2)::INT) OVER (PARTITION BY key ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS visited FROM s""")
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.stop_rule(crawled(spark, sf_dir), "key", "page", "news")


@query("circuit_breaker", f"""WITH {_PAGES}, i AS (SELECT *, sum((news > 0)::INT) OVER (PARTITION BY key ORDER BY page) AS island FROM p),
s AS (SELECT key, page, CASE WHEN news > 0 THEN 0 ELSE sum((news = 0)::INT) OVER (PARTITION BY key, island ORDER BY page) END::INT AS failures FROM i)
SELECT key, page, failures, max((failures >= 3)::INT) OVER (PARTITION BY key ORDER BY page) = 1 AS tripped FROM s""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.breaker(crawled(spark, sf_dir), "key", "page", F.col("news") == 0, 3).select("key", "page", "failures", "tripped")


@query("page_acceptance", "SELECT source AS page, count(*) AS n, round(avg((lang = 'en')::INT), 6) AS share, avg((lang = 'en')::INT) >= 0.5 AS accepted FROM documents GROUP BY source")
def page_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ls.accepted_pages(v.table(spark, sf_dir, "documents"), "source", F.col("lang") == "en")
    return out.withColumnRenamed("source", "page").withColumn("share", F.round("share", 6))


@query("listing_cards", f"""WITH {v.AD} SELECT 'https://x.org/p/' || url || '.html' AS url, round(price)::DOUBLE AS price, area AS built, rooms, (url % 4)::INT AS baths, CASE WHEN url % 3 > 0 THEN (url % 5)::INT END AS parking, CASE WHEN url % 2 = 0 THEN 'Rua & ' || street ELSE '' END AS street, area_name || ', Sao Tome' AS place, 'Nice house ' || url AS description, url % 3 AS photos FROM ad""")
def listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of two cards for each pair of listings."""
    k = F.col("url")
    part = lambda qa, text: F.concat(F.lit(f'<div class="c" data-qa="{qa}"><b>'), text, F.lit("</b> </div>"))
    price = F.concat(F.lit("R$ "), F.translate(F.format_number(F.round("price", 0), 0), ",", "."))
    features = F.concat(F.regexp_replace(F.format_string("%.1f", "area"), r"\.", ","), F.lit(" m² tot.</b> <span>"), F.col("rooms"), F.lit(" quartos</span> <span>"), k % 4, F.lit(" ban.</span>"), F.when(k % 3 > 0, F.concat(F.lit(" <b>"), k % 5, F.lit(" vagas"))).otherwise("<b>"))
    street = F.when(k % 2 == 0, F.concat(F.lit('<h4 class="postingLocations-module__location-address">Rua &amp; '), "street", F.lit("</h4>"))).otherwise("")
    photos = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < k % 3, F.concat(F.lit('<img src="https://i.org/'), k, F.lit("_"), i, F.lit('.jpg">'))).otherwise('<img src="https://i.org/logo.svg">')), "")
    card = F.concat(
        F.lit('<div data-to-posting="/p/'), k, F.lit('.html?n_pos=3">'), photos, part("POSTING_CARD_PRICE", price), part("POSTING_CARD_FEATURES", features), street,
        F.lit('<h4 class="postingLocations-module__location-text">'), "area_name", F.lit(", Sao Tome</h4>"), part("POSTING_CARD_DESCRIPTION", F.concat(F.lit("Nice   house "), k)), F.lit("</div>"),
    )
    pages = v.listings(spark, sf_dir).groupBy(F.expr("url div 2").alias("page")).agg(F.concat(F.lit("<html><nav>R$ 1</nav>"), F.array_join(F.sort_array(F.collect_list(card)), ""), F.lit("</html>")).alias("html"))
    return pg.listing_cards(pages, "html", "https://x.org").select("url", "price", "built", "rooms", "baths", "parking", "street", "place", "description", F.size("photos").cast("long").alias("photos"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the table events of the folder, as a stream."""
    schema = v.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events*")


def _through(df: DataFrame, mode: str) -> DataFrame:
    """The stream's result, written by a streaming query to a table in the shared folder."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    path = f"{top}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:  # complete mode: the last batch holds everything
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(*df.columns)


_AT = "date_format({}, 'yyyy-MM-dd HH:mm')"


@query("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(cr.tumbling(cr.timed(_stream(spark, sf_dir), late="60 days")), "complete")
    return out.select(F.expr(_AT.format("w.start")).alias("start"), "event_type", "n", "total")


@query("stream_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY s")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(cr.sliding(cr.timed(_stream(spark, sf_dir), late="60 days")), "complete")
    return out.select(F.expr(_AT.format("w.start")).alias("start"), "n")


@query("stream_session", """WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _through(cr.sessions(cr.timed(_stream(spark, sf_dir), late="60 days")), "complete")
    return out.select("user_id", F.expr(_AT.format("w.start")).alias("start"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = cr.timed(_stream(spark, sf_dir), late="60 days").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return _through(cr.distinct_events(timed, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"), "append")


@query("vision_cost", """SELECT event_type, count(*) AS n, count(*) FILTER (isodow(ts) < 6 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9)) AS peak,
  round(sum((event_id % 1000 * 0.15 + 100 * 0.60) / 1e6 * CASE WHEN isodow(ts) < 6 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) THEN 2.0 ELSE 1.0 END::DOUBLE), 6) AS usd FROM events GROUP BY event_type""")
def vision_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    usd = sc.token_cost(F.col("ts"), F.col("event_id") % 1000, F.lit(100))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(sc.peak(F.col("ts"))).alias("peak"), F.round(F.sum(usd), 6).alias("usd"))


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# Texts.

def _case(table: dict[str, str]) -> str:
    return "CASE x " + " ".join(f"WHEN '{k}' THEN '{w}'" for k, w in table.items()) + " ELSE x END"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_ACCENTS = ("ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
_UP = f"trim(regexp_replace(regexp_replace(regexp_replace(upper(translate(replace(coalesce(line, ''), 'ß', 'SS'), '{_ACCENTS[0]}', '{_ACCENTS[1]}')), '[,;]?\\s*[0-9]+\\s*[A-Z]?$', ''), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NUMBER = ",?\\s+([0-9]{1,5})\\s*([A-Za-z])?\\s*$"
#: Of a table ``l`` with a column ``line``: k, the words of the street's name; u, those behind its type.
_KEYED = f"""w AS (SELECT *, list_filter(string_split({_UP}, ' '), lambda x: x <> '') AS words FROM l),
t AS (SELECT *, CASE WHEN len(words) > 0 THEN list_concat(list_transform(words[1:1], lambda x: {_case(ad.STREET_TYPES)}), words[2:]) ELSE words END AS typed FROM w),
b AS (SELECT *, list_filter(typed, lambda x: x NOT IN ('DE', 'DA', 'DO', 'DAS', 'DOS', 'E')) AS bare FROM t), c AS (SELECT *, CASE WHEN len(bare) > 0 THEN bare ELSE words END AS k FROM b)"""


def _key_sql(table: dict[str, str]) -> str:
    words = f"list_transform(k, lambda x: {_case(table)})" if table else "k"
    return f"array_to_string(CASE WHEN len(k) > 0 AND {words}[1] IN ({_list(ad.SHORT_TYPES)[1:-1]}) THEN {words}[2:] ELSE {words} END, ' ')"


_HOUSE = f"CASE WHEN regexp_extract(trim(coalesce(line, '')), '{_NUMBER}', 1) IN ('', '0') THEN '' ELSE regexp_extract(trim(coalesce(line, '')), '{_NUMBER}', 1) || upper(regexp_extract(trim(coalesce(line, '')), '{_NUMBER}', 2)) END"


@query("street_keys", f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) || ', ' || (doc_id % 400) AS line FROM s), {_KEYED}
SELECT doc_id, place::BIGINT AS place, md5(array_to_string(k, ' ')) AS name, md5({_key_sql(ad.CADASTRE_WORDS)}) AS key, {_HOUSE} AS number FROM c""")
def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as an address."""
    parts = v.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "part"))
    line = F.concat("part", F.lit(", "), (F.col("doc_id") % 400).cast("string"))
    rows = parts.select("doc_id", (F.col("at") + 1).cast("long").alias("place"), line.alias("line"))
    md5 = lambda x: F.md5(x.cast("binary"))
    both = rows.select("doc_id", "place", ad.house_number(F.col("line")).alias("number"), F.inline(F.array(ad.street_name_and_key(F.col("line"), 1))))
    return both.select("doc_id", "place", md5(F.col("name")).alias("name"), md5(F.col("key")).alias("key"), "number")


_WANTED, _UNWANTED = ["tion", "garden", "mente", "und"], ["the of", "clown"]


@query("text_yard_score", f"""SELECT doc_id, ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in _WANTED)} - 2 * ({' + '.join(f"contains(lower(text), '{w}')::INT" for w in _UNWANTED)}))::INT AS score FROM documents""")
def text_yard_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ru.keyword_score(F.col("text"), _WANTED, _UNWANTED).alias("score"))


@query("text_financing", r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), s AS (SELECT doc_id, low, list_filter(list_transform(regexp_split_to_array(low, '[.;\n!?]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM d)
SELECT doc_id, CASE WHEN contains(low, 'the of and') THEN false WHEN contains(low, 'tion') AND (contains(low, 'mente') OR len(list_filter(range(1, len(s) + 1), lambda i: contains(s[i], 'tion') AND NOT contains(s[i], 'ing') AND (regexp_matches(s[i], 'that|pour|que') OR i > 1 AND regexp_matches(s[i - 1], 'that|pour|que')))) > 0) THEN true END AS accepts FROM s""")
def text_financing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence rule with words of the documents' own vocabulary."""
    rule = ru.accepts_financing(F.col("text"), stem="tion", refusing=["the of and"], accepting=["that", "pour", "que"], advertising=["ing"], certain=["mente"])
    return v.table(spark, sf_dir, "documents").select("doc_id", rule.alias("accepts"))


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(text, 'ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')), '-', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("kind_of_text", f"SELECT doc_id, CASE WHEN contains({_PLAIN}, 'reation') OR contains({_PLAIN}, 'mentre') THEN 'apartamento' WHEN contains({_PLAIN}, 'tion') THEN 'casa' ELSE 'incerto' END AS kind FROM documents")
def kind_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ru.kind_of_listing(F.col("text"), ["reation", "mentre"], ["tion"]).alias("kind"))


@query("land_area_regex", """WITH d AS (SELECT doc_id, 'Casa com terreno de ' || (doc_id % 900) || ' m2' AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Lote: ' || (doc_id % 700) || ',5 metros' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, (doc_id % 40) || ' x ' || (doc_id % 60) || ' metros' FROM documents WHERE doc_id % 3 = 2),
n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 900 WHEN 1 THEN doc_id % 700 + 0.5 ELSE (doc_id % 40) * (doc_id % 60) END::DOUBLE AS land FROM d) SELECT doc_id, CASE WHEN land BETWEEN 20 AND 100000 THEN land END AS land FROM n""")
def land_area_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    n = lambda m: (k % m).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("Casa com terreno de "), n(900), F.lit(" m2"))).when(k % 3 == 1, F.concat(F.lit("Lote: "), n(700), F.lit(",5 metros"))).otherwise(F.concat(n(40), F.lit(" x "), n(60), F.lit(" metros")))
    return v.table(spark, sf_dir, "documents").select("doc_id", ru.land_area(text).alias("land"))


@query("even_sample", """WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(w) <= 8 THEN w ELSE list_transform(list_transform(range(0, 8), lambda i: round_even(i * (len(w) - 1) / 7.0::DOUBLE, 0)::INT), lambda i: w[i + 1]) END, ' ') AS words FROM w WHERE len(w) > 0""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", " "), lambda x: x != "")
    return v.table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where("size(w) > 0").select("doc_id", F.array_join(nu.even_sample(F.col("w"), 8), " ").alias("words"))


@query("canonical_url", "SELECT page_id, url, string_split(string_split(url, '#')[1], '?')[1] AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", "url", ru.canonical_url(F.col("url")).alias("canonical"))


@query("html_parse", None)
def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.parsed_pages(v.table(spark, sf_dir, "pages")).select("page_id", "title", "heading", F.length("description").alias("description_chars"), "paragraphs", F.size("links").alias("links"), F.size("images").alias("images"))


@query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title, CASE WHEN contains(html, '<article>') THEN 'detail' WHEN contains(html, '<table') THEN 'listing' ELSE 'other' END AS kind FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("raw_title"), pg.page_kind(F.col("html"), "<article>", "<table").alias("kind"))


# Space: suppliers and customers on a grid over the city.

_POINTS = """pt AS (SELECT c_custkey AS point_id, -23.60 + (c_custkey * 37 % 1000) * 0.0001::DOUBLE AS lat, -46.70 + (c_custkey * 91 % 1000) * 0.0001::DOUBLE AS lon FROM customer),
ft AS (SELECT s_suppkey AS feature_id, -23.60 + (s_suppkey * 53 % 1000) * 0.0001::DOUBLE AS lat, -46.70 + (s_suppkey * 17 % 1000) * 0.0001::DOUBLE AS lon FROM supplier)"""
_METRES = "sqrt(pow((f.lon - p.lon) * 111320.0::DOUBLE * cos(radians((p.lat + f.lat) / 2)), 2) + pow((f.lat - p.lat) * 110540.0::DOUBLE, 2))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "customer").selectExpr("c_custkey as point_id", "-23.60D + (c_custkey * 37 % 1000) * 0.0001D as lat", "-46.70D + (c_custkey * 91 % 1000) * 0.0001D as lon")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as feature_id", "-23.60D + (s_suppkey * 53 % 1000) * 0.0001D as lat", "-46.70D + (s_suppkey * 17 % 1000) * 0.0001D as lon")


@query("spatial_pip", f"""WITH {_POINTS}, b AS (SELECT feature_id, lon - 0.00313 AS x0, lon + 0.00324 AS x1, lat - 0.00213 AS y0, lat + 0.00224 AS y1, lon - 0.00117 AS hx0, lon + 0.00126 AS hx1, lat - 0.00117 AS hy0, lat + 0.00126 AS hy1 FROM ft)
SELECT point_id, feature_id FROM pt JOIN b ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 WHERE NOT (lon > hx0 AND lon < hx1 AND lat > hy0 AND lat < hy1)""")
def spatial_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a hole around every supplier."""

    def ring(x0: float, x1: float, y0: float, y1: float) -> Column:
        lon, lat = F.col("lon"), F.col("lat")
        corner = lambda x, y: F.array(lon + x, lat + y)
        return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))

    polygons = features(spark, sf_dir).select("feature_id", F.array(ring(-0.00313, 0.00324, -0.00213, 0.00224), ring(-0.00117, 0.00126, -0.00117, 0.00126)).alias("rings"))
    return sp.points_in_polygons(points(spark, sf_dir), polygons)


@query("spatial_knn", f"""WITH {_POINTS}, n AS (SELECT p.point_id, f.feature_id, {_METRES} AS metres FROM pt p, ft f), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY metres, feature_id) AS place FROM n WHERE metres <= 600)
SELECT point_id, feature_id, round(metres, 4) AS metres FROM k WHERE place = 1""")
def spatial_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.nearest(points(spark, sf_dir), features(spark, sf_dir), 600.0).withColumn("metres", F.round("metres", 4))


@query("spatial_count", f"WITH {_POINTS} SELECT p.point_id, count(f.feature_id) AS n FROM pt p LEFT JOIN ft f ON {_METRES} <= 900 GROUP BY p.point_id")
def spatial_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.count_within(points(spark, sf_dir), features(spark, sf_dir), 900.0)


@query("geocode_interpolate", f"""WITH {v.AD}, lots AS (SELECT l_partkey AS street, l_linenumber * 2 + l_suppkey % 2 AS number, avg(-23.6 + (l_linenumber * 2 + l_suppkey % 2) * 0.0005 + (l_partkey % 3) * 0.004 * (l_suppkey % 2)) AS lat, avg(-46.7 + (l_partkey % 50) * 0.001) AS lon FROM lineitem GROUP BY ALL),
a AS (SELECT url, street, CASE WHEN url % 6 = 0 THEN NULL ELSE number + 2 END AS number FROM ad),
j AS (SELECT url, a.number, arg_max(l.lat, l.number) FILTER (l.number = a.number) AS slat, arg_max(l.lon, l.number) FILTER (l.number = a.number) AS slon,
  arg_max(l.lat, l.number) FILTER (l.number < a.number AND l.number % 2 = a.number % 2) AS llat, max(l.number) FILTER (l.number < a.number AND l.number % 2 = a.number % 2) AS ln, arg_min(l.lat, l.number) FILTER (l.number > a.number AND l.number % 2 = a.number % 2) AS ulat, min(l.number) FILTER (l.number > a.number AND l.number % 2 = a.number % 2) AS un,
  arg_max(l.lon, l.number) FILTER (l.number < a.number AND l.number % 2 = a.number % 2) AS llon, arg_min(l.lon, l.number) FILTER (l.number > a.number AND l.number % 2 = a.number % 2) AS ulon, list(l.lat ORDER BY l.number) FILTER (l.lat IS NOT NULL) AS lats, max(l.lon) AS mlon, greatest(max(l.lat) - min(l.lat), max(l.lon) - min(l.lon)) AS spread FROM a LEFT JOIN lots l USING (street) GROUP BY url, a.number)
SELECT url, CASE WHEN lats IS NULL OR spread > 0.03 THEN NULL WHEN slat IS NOT NULL THEN 'lote' WHEN ln IS NOT NULL OR un IS NOT NULL THEN 'proximo' ELSE 'rua' END AS precision,
  round(CASE WHEN lats IS NULL OR spread > 0.03 THEN NULL WHEN slat IS NOT NULL THEN slat WHEN ln IS NOT NULL AND un IS NOT NULL THEN llat + (number - ln) / (un - ln) * (ulat - llat) WHEN ln IS NOT NULL THEN llat WHEN un IS NOT NULL THEN ulat ELSE lats[floor(len(lats) / 2)::INT + 1] END, 6) AS lat,
  round(CASE WHEN lats IS NULL OR spread > 0.03 THEN NULL WHEN slat IS NOT NULL THEN slon WHEN ln IS NOT NULL AND un IS NOT NULL THEN llon + (number - ln) / (un - ln) * (ulon - llon) WHEN ln IS NOT NULL THEN llon WHEN un IS NOT NULL THEN ulon ELSE mlon END, 6) AS lon FROM j""")
def geocode_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = v.table(spark, sf_dir, "lineitem").selectExpr("l_partkey as street", "l_linenumber * 2 + l_suppkey % 2 as number", "-23.6D + (l_linenumber * 2 + l_suppkey % 2) * 0.0005D + (l_partkey % 3) * 0.004D * (l_suppkey % 2) as lat", "-46.7D + (l_partkey % 50) * 0.001D as lon")
    ads = v.listings(spark, sf_dir).select("url", "street", F.when(F.col("url") % 6 != 0, F.col("number") + 2).cast("long").alias("number"))
    return sp.geocoded(ads, lots).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# Merges and counters.

@query("upsert_coalesce", """WITH n AS (SELECT o_custkey AS k, nullif(max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END), '') AS priority FROM orders GROUP BY o_custkey)
SELECT c_custkey AS custkey, coalesce(priority, c_mktsegment) AS segment, CASE WHEN length(coalesce(priority, '')) > length(c_mktsegment) THEN priority ELSE c_mktsegment END AS label FROM customer LEFT JOIN n ON c_custkey = k""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders update their customer; those whose status isn't P bring a blank, which takes nothing."""
    old = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("label"))
    said = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("")
    new = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max(said).alias("segment")).withColumn("label", F.col("segment"))
    return up.coalesced(old, new, "custkey", ["segment"], longest=["label"])


@query("upsert_last_write", "WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 5 = 0) DESC, o_orderkey DESC) AS place FROM orders) SELECT k, id, price FROM r WHERE place = 1")
def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").selectExpr("o_custkey as k", "o_orderkey as id", "o_totalprice as price")
    return up.last_write(o.where("id % 5 <> 0"), o.where("id % 5 = 0"), "k", [F.col("id").desc()])


@query("insert_ignore", "WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k, 'old' AS origin FROM o UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id NOT IN (SELECT k FROM o)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("origin", F.lit("old"))
    new = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.lit("new").alias("origin"))
    return up.insert_ignored(old, new, "k")


@query("backfill", """SELECT p_partkey AS k, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, upper(p_brand)) AS name FROM part WHERE p_partkey % 3 = 0""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that a rule changes."""
    p = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), "p_brand")
    return up.backfilled(p, {"name": F.upper("p_brand")})[1].select("k", "name")


@query("data_quality", "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS no_text, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (lang = 'en') AS inside, count(*) FILTER (lang <> 'en') AS outside, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("no_text"), F.count_if(F.length("text") < 200).alias("short"),
        F.count_if(F.col("lang") == "en").alias("inside"), F.count_if(F.col("lang") != "en").alias("outside"), F.countDistinct("lang").alias("langs"),
    )


@query("count_by", "SELECT p_type AS portal, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, portal LIMIT 10")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("portal")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "portal").limit(10)


@query("semi_exists", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(o, F.col("k") == o["o_custkey"], "left_semi")


@query("not_exists", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(o, F.col("k") == o["o_custkey"], "left_anti")


@query("group_purity", "SELECT count(*) FILTER (n = 1) AS consistent, count(*) FILTER (n > 1) AS divergent, count(*) FILTER (n = 0) AS missing FROM (SELECT o_custkey, count(DISTINCT nullif(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END, '')) AS n FROM orders GROUP BY o_custkey)")
def group_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.nullif(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(""), F.lit(""))
    by = v.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct(named).alias("n"))
    return by.agg(F.count_if(F.col("n") == 1).alias("consistent"), F.count_if(F.col("n") > 1).alias("divergent"), F.count_if(F.col("n") == 0).alias("missing"))


@query("numeric_text_order", "SELECT c_custkey AS k, n FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'S/N' ELSE (c_custkey % 90)::VARCHAR END AS n FROM customer) ORDER BY coalesce(try_cast(n AS INT), 0), k LIMIT 50")
def numeric_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("c_custkey") % 5 == 0, "S/N").otherwise((F.col("c_custkey") % 90).cast("string"))
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), n.alias("n")).orderBy(F.coalesce(F.col("n").try_cast("int"), F.lit(0)), "k").limit(50)


@query("bbox_percentile", f"""WITH {_POINTS} SELECT round(list_sort(list(lon))[least(floor(0.01 * count(*))::INT, count(*) - 1) + 1] - 0.03, 6) AS minx, round(list_sort(list(lat))[least(floor(0.01 * count(*))::INT, count(*) - 1) + 1] - 0.03, 6) AS miny,
  round(list_sort(list(lon))[least(floor(0.99 * count(*))::INT, count(*) - 1) + 1] + 0.03, 6) AS maxx, round(list_sort(list(lat))[least(floor(0.99 * count(*))::INT, count(*) - 1) + 1] + 0.03, 6) AS maxy FROM pt""")
def bbox_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the middle 98 percent of points, and a margin."""
    pt = points(spark, sf_dir)
    lon, lat = (val.ranked_quantiles(pt, [], c, {f"min{a}": 0.01, f"max{a}": 0.99}).drop("n") for c, a in (("lon", "x"), ("lat", "y")))
    wide = {"minx": -0.03, "miny": -0.03, "maxx": 0.03, "maxy": 0.03}
    return lon.crossJoin(F.broadcast(lat)).select(*[F.round(F.col(c) + x, 6).alias(c) for c, x in wide.items()])  # one row each


@query("region_filter_words", "SELECT n_name, n_name ILIKE '%_1%' AS hit FROM nation")
def region_filter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "nation").select("n_name", F.col("n_name").ilike("%_1%").alias("hit"))


@query("priority_list", "SELECT p_brand AS name, row_number() OVER (ORDER BY coalesce(list_position(['Brand#9', 'Brand#3'], p_brand), 99), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def priority_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured names first, the rest by name; a few names."""
    from pyspark.sql import Window

    names = v.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    rank = reduce(lambda other, kv: F.when(F.col("name") == kv[1], kv[0]).otherwise(other), enumerate(["Brand#9", "Brand#3"], 1), F.lit(99))
    return names.select("name", F.row_number().over(Window.orderBy(rank, "name")).cast("long").alias("place"))
