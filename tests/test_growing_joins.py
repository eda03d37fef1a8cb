"""Joins of tables that grow with the input are shuffled, however small their files are."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lotlens.operators import comparables as c
from lotlens.operators import listing as ls
from lotlens.operators import spatial as sp
from lotlens.plans import QUERIES, market
from lotlens.sources import views as v


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparables_are_found_once_and_never_broadcast(spark, sf_dir: str) -> None:
    found = plan(c.summary(market.comparables(spark, sf_dir)))
    assert "Broadcast" not in found
    # Two sides of two joins, and the pairs by listing: windows and groups need no other shuffle.
    assert len(re.findall(r"Exchange hashpartitioning", found)) == 5


def test_comparisons_are_joined_by_shuffles(spark, sf_dir: str) -> None:
    found = c.summary(market.comparables(spark, sf_dir))
    assert "Broadcast" not in plan(ls.with_comparisons(v.listings(spark, sf_dir), found))


@pytest.mark.parametrize("name", ["report_by_area", "report_by_street", "fit_score_udf", "assessed_projection", "freshness"])
def test_reports_broadcast_nothing(name: str, spark, sf_dir: str) -> None:
    assert "BroadcastExchange" not in plan(QUERIES[name](spark, sf_dir))


def test_points_of_one_place_are_looked_for_once(spark) -> None:
    """4,000 points at two places and 4,000 features at two others: pairs of places are compared, not the 16 million of rows."""
    at = lambda name: spark.range(4000, numPartitions=2).selectExpr(f"id as {name}", "-23.5D + (id % 2) * 0.001D as lat", "-46.6D + (id % 2) * 0.0001D as lon")
    points, features = at("point_id").unionByName(spark.sql("select -1L as point_id, cast(null as double) as lat, -46.6D as lon")), at("feature_id")
    met = []
    places = sp.by_place(points, lambda p: met.append(p.count()) or p.select("point_id", F.col("lat").alias("found")))
    assert met == [2] and places.count() == 4000 and places.where("found <> -23.5D + (point_id % 2) * 0.001D").isEmpty()
    assert sp._within(points, features, 60.0, sp.CELL).where("point_id = 0").count() == 1
    counts = {r["point_id"]: r["n"] for r in sp.count_within(points, features, 60.0).where("point_id < 3").collect()}
    assert counts == {-1: 0, 0: 2000, 1: 2000, 2: 2000}
    assert {r["point_id"]: r["feature_id"] for r in sp.nearest(points, features, 60.0).where("point_id > 3996").collect()} == {3997: 1, 3998: 0, 3999: 1}
