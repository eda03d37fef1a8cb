"""Operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import comparables as c
from lotlens.operators import duplicates as d
from lotlens.operators import listing as ls
from lotlens.operators import spatial as sp
from lotlens.operators import upserts as u
from lotlens.operators import valuation as v
from lotlens.sources import files, pages, paged
from lotlens.streaming import crawl


def sales(spark, rows):
    return spark.createDataFrame(rows, "street string, cep string, area double, value double, number string, sold date, financed boolean, market boolean, id long")


def ads(spark, rows):
    return spark.createDataFrame(rows, "url string, street string, cep string, area double, price double")


def test_a_financed_sale_by_code_goes_before_any_sale_on_the_street(spark) -> None:
    day = dt.date(2020, 1, 1)
    s = sales(spark, [("a", "9", 100.0, 1000.0, "1", day, False, True, i) for i in range(3)] + [("b", "1", 100.0, 2000.0, "1", day, True, True, 10 + i) for i in range(3)])
    got = c.cascade(ads(spark, [("x", "a", "1", 100.0, 5.0)]), s, ["id"]).collect()
    assert {r["step"] for r in got} == {3} and len(got) == 3


def test_the_newest_500_count_and_ten_years_of_them(spark) -> None:
    s = sales(spark, [("a", "1", 100.0, 1000.0, "1", dt.date(2020, 1, 1) - dt.timedelta(days=i), True, True, i) for i in range(520)] + [("b", "2", 100.0, 1000.0, "1", dt.date(y, 1, 1), True, True, y) for y in (2020, 2010, 2009)])
    got = c.cascade(ads(spark, [("x", "a", "1", 100.0, 5.0), ("y", "b", "2", 100.0, 5.0)]), s, ["id"])
    counts = {r["url"]: r["count"] for r in got.groupBy("url").count().collect()}
    assert counts == {"x": 500, "y": 2}


def test_a_building_cannot_outvote_a_street(spark) -> None:
    day = dt.date(2020, 1, 1)
    rows = [("a", "1", 100.0, v, n, day, True, True, i) for i, (v, n) in enumerate([(100000.0, "1")] * 6 + [(200000.0, "2"), (300000.0, "3")])]
    got = c.summary(c.cascade(ads(spark, [("x", "a", "1", 100.0, 5.0)]), sales(spark, rows), ["id"])).first()
    assert (got["method"], got["unit_median"], got["n"], got["n_numbers"]) == ("por_numero", 2000.0, 8, 3)


@pytest.mark.parametrize(("seed", "radius"), [(s, r) for s in (1, 2, 3) for r in (6, 10)])
def test_banded_links_connect_what_all_pairs_do(spark, seed, radius) -> None:
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 8))) & (2**64 - 1) for b in base for _ in range(6)] + base[:2]
    signed = [h - 2**64 if h >> 63 else h for h in hashes]
    got = {r["id"]: r["group"] for r in d.groups(d.alike(spark.createDataFrame(list(enumerate(signed)), "id long, hash long"), radius)).collect()}
    root = list(range(len(hashes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(hashes):
        for j in range(i):
            if (a ^ hashes[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    size = [sum(top(k) == top(i) for k in range(len(hashes))) for i in range(len(hashes))]
    assert got == {i: top(i) for i in range(len(hashes)) if size[i] > 1}


def test_guard_and_consensus(spark) -> None:
    m = spark.createDataFrame([(1, 1, "a", "x", 5.0, 1, "1", "7"), (1, 2, "a", "x", 4.0, 9, "1", ""), (2, 3, "a", "x", 5.0, 1, "1", ""), (2, 4, "b", "x", None, 1, "2", "")], "group int, id int, street string, area_name string, price double, photos int, cep string, number string")
    assert {(r["group"], r["principal"], r["dropped"]) for r in d.guarded(m).collect()} == {(1, 2, False), (2, 3, True)}
    assert {(r["group"], r["cep"], r["number"], r["reason"]) for r in d.consensus(m).collect()} == {(1, "1", "7", "cep"), (2, None, None, "ceps divergentes")}


def test_geocoding(spark) -> None:
    lots = spark.createDataFrame([("a", k, -23.0 - k * 0.001, -46.0) for k in (1, 3, 7, 9)] + [("far", 1, -23.0, -46.0), ("far", 3, -23.5, -46.0)], "street string, number long, lat double, lon double")
    asked = spark.createDataFrame([("lot", "a", 3), ("mid", "a", 5), ("end", "a", 11), ("none", "a", None), ("far", "far", 1), ("no", "zz", 1)], "url string, street string, number long")
    got = {r["url"]: (r["precision"], None if r["lat"] is None else round(r["lat"], 4)) for r in sp.geocoded(asked, lots).collect()}
    assert got == {"lot": ("lote", -23.003), "mid": ("proximo", -23.005), "end": ("proximo", -23.009), "none": ("rua", -23.007), "far": (None, None), "no": (None, None)}


def test_index_is_carried_24_months(spark) -> None:
    index = spark.createDataFrame([("202001", 100.0), ("202301", 120.0)], "month string, level double")
    rows = spark.createDataFrame([("201912",), ("202001",), ("202112",), ("202202",), ("202301",)], "month string")
    got = {r["month"]: r["factor"] for r in v.index_factor(rows, "month", index, "201901", "202312").collect()}
    assert got == {"201912": 1.0, "202001": 1.2, "202112": 1.2, "202202": 1.0, "202301": 1.0}


def test_three_quantiles(spark) -> None:
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, x double")
    got = v.ranked_quantiles(df, ["k"], "x", {"q": 0.25, "upper": 0.5}).first()
    assert (got["q"], got["upper"]) == (2.0, 3.0)
    assert df.agg(v.upper_median(F.collect_list("x")).alias("m")).first()["m"] == 3.0


def test_weighted_fit(spark) -> None:
    df = spark.createDataFrame([(1.0, float(x), 3.0 + 2.0 * x, 1.0 + x) for x in range(5)], "one double, x double, y double, w double")
    assert v.weighted_fit(df, "y", ["one", "x"], "w") == pytest.approx([3.0, 2.0])


def test_request_filters() -> None:
    f = ls.Filters.from_request({"price_max": ["abc"], "land_min": ["200"], "floor": ["terra"], "financing": ["no"]})
    assert (f.price_max, f.land_min, f.floors, f.financing) == (None, 200.0, ["terra"], False)


def test_page_number_is_clamped(spark) -> None:
    df = spark.range(5).select(F.col("id").alias("ingest_seq"), F.lit(1.0).alias("score"), F.col("id").cast("double").alias("price"), F.lit(False).alias("dup_best"))
    assert [r["ingest_seq"] for r in ls.page(df, "price_desc", 9, 2, total=5).collect()] == [0]


def test_merges(spark) -> None:
    old = spark.createDataFrame([("a", "t", "short", ["1"]), ("b", "u", "long text", ["1", "2"])], "url string, title string, text string, photos array<string>")
    new = spark.createDataFrame([("a", "", "longer", ["1", "2"]), ("b", "w", "x", ["3"])], "url string, title string, text string, photos array<string>")
    got = {r["url"]: tuple(r)[1:] for r in u.coalesced(old, new, "url", ["title"], ["text"], ["photos"]).collect()}
    assert got == {"a": ("t", "longer", ["1", "2"]), "b": ("w", "long text", ["1", "2"])}


def test_stop_rule_resets_on_news_and_ends(spark) -> None:
    p = spark.createDataFrame([("k", i, n) for i, n in enumerate([1, 0, 1, 0, 0, 5])], "key string, page long, news long")
    assert [r["visited"] for r in crawl.stop_rule(p, "key", "page", "news").orderBy("page").collect()] == [True, True, True, True, True, False]
    assert all(r["visited"] for r in crawl.stop_rule(p, "key", "page", "news", full=True).collect())


def test_stop_stream_agrees_with_batch(spark, tmp_path) -> None:
    rows = [("k", i, n) for i, n in enumerate([1, 0, 1, 0, 0, 5])]
    spark.createDataFrame(rows, "key string, page long, news long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, page long, news long").parquet(str(tmp_path / "in"))
    out = crawl.run_now(crawl.stop_stream(stream), "stops")
    assert {(r["page"], r["visited"]) for r in out.collect()} == {(i, i < 5) for i in range(6)}


def test_registry_keeps_first_and_last(spark, tmp_path) -> None:
    schema = "url string, ts timestamp"
    for i, hour in enumerate((3, 1, 2)):
        spark.sql(f"select 'a' as url, timestamp '2024-01-01 0{hour}:00:00' as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        crawl.registry(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "seen"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"seen/version={i}")).count() == 1
    last = spark.read.parquet(str(tmp_path / "seen/version=2")).first()
    assert (last["first_seen"].hour, last["last_seen"].hour) == (1, 3)


def test_headers_in_any_spelling(spark) -> None:
    df = spark.createDataFrame([("1", "x")], ["Número do Imóvel", "other"])
    got = files.by_header(df, {"number": "NUMERO DO IMOVEL", "missing": "CEP"}).first()
    assert (got["number"], got["missing"]) == ("1", None)


def test_pages_and_paged_source(spark, tmp_path) -> None:
    got = pages.parse_page("<title>A &amp; B</title><nav>x</nav><h1> H </h1><p>short</p><p>a <b>longer</b> one</p><a href='/x'>l</a><img src=i.jpg>")
    assert (got["title"], got["heading"], got["description"], got["links"], got["images"]) == ("A & B", "H", "a longer one", ["/x"], ["i.jpg"])
    assert pages.parse_page(None)["title"] == ""
    assert pages.embedded_array('var p = [{"a": "]"}, 2]; x', "p =") == '[{"a": "]"}, 2]'
    bodies = spark.createDataFrame([("a", 1, json.dumps({"items": [{"url": "u", "price": 1.0, "unit_types": ["HOME"], "photos": ["p", "p"]}, {"url": "f", "unit_types": ["APARTMENT"]}]})), ("a", 2, "no json")], "area string, page int, body string")
    assert [(r["url"], r["photos"]) for r in paged.api_listings(bodies).collect()] == [("u", ["p"])]
    with pytest.raises(Exception, match="package.module:function"):
        paged.paged(spark, pages="5", area="x").count()
    for start in range(0, 180, 36):
        (tmp_path / f"layer=x/start={start}").mkdir(parents=True)
        (tmp_path / f"layer=x/start={start}/part-0.txt").write_text(f"page {start}")
    found = paged.paged(spark, fetcher="lotlens.sources.fetching:saved_answer", folder=f"file://{tmp_path}", pages="5", pagesPerPartition="2", area="x")
    assert sorted(r["body"] for r in found.collect()) == sorted(f"page {s}" for s in range(0, 180, 36))
