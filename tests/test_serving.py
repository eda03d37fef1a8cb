"""Marts, lookups, decoded answers and keys on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lotlens.functions import address as ad
from lotlens.functions import rules as ru
from lotlens.operators import duplicates as du
from lotlens.operators import listing as ls
from lotlens.operators import serving as sv
from lotlens.operators import upserts as up
from lotlens.operators import valuation as val
from lotlens.plans import QUERIES, market
from lotlens.sources import registers as rg


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pages_follow_the_tables(spark, tmp_path, sf_dir) -> None:
    """Half of the listings go between two calls, then come back in other files."""
    for name in ("part", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    half = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 2 = 0")
    before = {r["url"] for r in QUERIES["filter_below_market"](spark, str(tmp_path)).collect()}
    half.write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    after = {r["url"] for r in QUERIES["filter_below_market"](spark, str(tmp_path)).collect()}
    assert after and after == {u for u in before if u % 2 == 0}
    spark.read.parquet(f"{sf_dir}/part.parquet").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert {r["url"] for r in QUERIES["filter_below_market"](spark, str(tmp_path)).collect()} == before


def test_a_page_of_any_length_has_its_details(spark) -> None:
    keys = spark.range(2500).withColumnRenamed("id", "url")
    (found,) = sv.of_page(keys, spark.range(5000).selectExpr("id as url", "id as detail"))
    assert found.count() == 2500


def test_the_newest_of_several_details_counts(spark) -> None:
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "url long, name string, text string")
    new = spark.createDataFrame([(1, "older", "long text", 1), (1, "newer", "xy", 2), (1, "", "", 0)], "url long, name string, text string, at long")
    found = up.coalesced(old, new, "url", ["name"], longest=["text"], newest=[F.col("at").desc()])
    assert sorted(map(tuple, found.collect())) == [(1, "newer", "xy"), (2, "b", "y")]


def test_places_among_copies(spark) -> None:
    members = spark.createDataFrame([(1, 5, 10.0), (1, 4, 10.0), (1, 3, 30.0), (1, 2, None), (2, 9, None)], "group long, id long, price double")
    found = {r["id"]: (r["copies"], r["place"], r["cheaper"], r["above"]) for r in du.copy_places(members).collect()}
    assert found == {4: (4, 1, 0, 0.0), 5: (4, 2, 0, 0.0), 3: (4, 3, 2, 20.0), 2: (4, 4, None, None), 9: (1, 1, None, None)}


def test_marts_are_replaced_and_read_again(spark, tmp_path, sf_dir) -> None:
    sv.publish({"a": spark.range(3), "b": spark.range(1)}, f"file://{tmp_path}/m")
    sv.replace_table(spark.range(5), f"file://{tmp_path}/m/a")
    assert [df.count() for df in sv.published(spark, f"file://{tmp_path}/m", "a", "b")] == [5, 1]
    n = market.served(spark, sf_dir, "listings").count()
    market._MARTS |= {key: f"file://{tmp_path}/gone" for key in market._MARTS}
    assert market.served(spark, sf_dir, "listings").count() == n


def test_accents_by_decomposition(spark) -> None:
    text = "Nº 5ª ² Ção ŠIŘE é é Ａ"
    assert one(spark, ad.unaccent(F.lit(text))) == "No 5a 2 Cao SIRE e e A"


def test_a_key_computes_its_steps_once(spark) -> None:
    plan = spark.createDataFrame([("Rua A",)], "line string").select(ad.street_key(F.col("line"), 2).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4 and plan.count("translate") <= 1


def test_a_map_server_s_refusal_is_an_error(spark) -> None:
    xml = "<ows:ExceptionReport><ows:ExceptionText>no such field</ows:ExceptionText></ows:ExceptionReport>"
    assert one(spark, rg.refused(F.lit(xml))) == "no such field" and one(spark, rg.refused(F.lit("<a/>"))) is None
    with pytest.raises(Exception, match="no such field"):
        rg.gml_lots(spark.createDataFrame([(xml,)], "xml string")).collect()


def test_lots_of_another_street_go(spark) -> None:
    lots = spark.createDataFrame([("GENERAL ALVES", 1), ("ALVES", 2)], "key string, n int")
    assert [r["n"] for r in rg.lots_of_street(lots, F.lit("Rua Gal. Alves")).collect()] == [1]


def test_search_slug_and_body(spark) -> None:
    assert one(spark, rg.search_slug(F.lit("Vila  Sônia"))) == "vila-sonia-sao-paulo-sp-brasil"
    body = one(spark, F.parse_json(rg.search_body(F.lit("a"), F.lit(3), 10)).cast("string"))
    assert '"offset":20' in body and '"pageSize":10' in body


def test_candidates_are_a_small_share_of_all_pairs(spark) -> None:
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(63)) for i in range(1500)]
    near = [(2000 + i, h ^ sum(1 << b for b in rng.sample(range(63), i % 11))) for i, (_, h) in enumerate(rows[:60])]
    hashes = spark.createDataFrame(rows + near, "id long, hash long")
    got = {(r["a"], r["b"]): r["distance"] for r in du.alike(hashes, 10).collect()}
    every = rows + near
    wanted = {(a, b): (x ^ y).bit_count() for i, (a, x) in enumerate(every) for b, y in every[i + 1 :] if (x ^ y).bit_count() <= 10}
    assert got == wanted and len(got) >= 60
    listed = lambda probes: hashes.select("id", F.explode(du._banded(F.col("hash"), 10, probes)).alias("b"))
    met = listed(True).join(listed(False).withColumnRenamed("id", "other"), "b").count()
    assert met < 0.02 * len(every) ** 2


def test_page_beyond_the_last_is_the_last(spark) -> None:
    rows = spark.range(130).selectExpr("id as ingest_seq", "double(id) as price", "false as dup_best")
    page, total = ls.counted_page(rows, "recent", 99)
    assert total == 130 and page.count() == 10
    assert ls.counted_page(rows.limit(0), "recent", 5)[0].count() == 0


def test_unknown_areas_give_no_rows_and_known_ones_plain_comparisons(spark) -> None:
    rows = spark.createDataFrame([("Vila Sônia", None, None, None), ("Moema", None, None, None)], "area_name string, removed_at string, dup_group long, dup_best boolean")
    some = ls.Filters(areas=["vila sonia"])
    assert some.resolved(rows) == ["Vila Sônia"] and some.apply(rows).count() == 1
    assert ls.Filters(areas=["x"]).apply(rows).count() == 0


def test_places_of_sorted_values(spark) -> None:
    df = spark.createDataFrame([("a", x) for x in (5.0, -2.0, None, 0.0, 5.0, 1e-9, -3e7)] + [(None, 1.0), ("b", None)], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in val.placed_values(df, ["k"], "x", {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).collect()}
    assert got == {"a": (6, -3e7, 1e-9, 5.0), None: (1, 1.0, 1.0, 1.0)}


def test_first_balanced_object(spark) -> None:
    get = lambda text: one(spark, ru.json_object(F.lit(text)).cast("string"))
    assert get('so {"a": {"b": 1}} and {"c": 2}') == '{"a":{"b":1}}'
    assert get("```json\n{\"a\": 2}\n``` then {\"b\": 3}") == '{"a":2}'
    assert get("nothing {") is None and get("") is None
