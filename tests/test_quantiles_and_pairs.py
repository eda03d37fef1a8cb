"""Quantiles of groups of any size and range, and pairs that are drawn without being made, against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest

from lotlens.operators import pairs, valuation


def values(kind: str, n: int, r: random.Random) -> list[float | None]:
    return {
        "even": lambda: [r.random() for _ in range(n)],
        "narrow": lambda: [-46.7 + r.random() * 1e-9 for _ in range(n)],
        "powers": lambda: [10.0 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(n)],
        "outlier": lambda: [1e308, -1e308, *(r.random() for _ in range(n))],
        "same": lambda: [7.5] * n,
        "two": lambda: [r.choice([1.0, 1.0 + 2**-52]) for _ in range(n)],
        "empty": lambda: [None, math.nan] * 3,
        "one": lambda: [3.25],
    }[kind]()


@pytest.mark.parametrize(("bins", "small"), [(1024, 10_000), (4, 5), (3, 1)])
def test_percentiles_of_all_ranges(spark, monkeypatch, bins: int, small: int) -> None:
    """Few bins and few rows to rank make many rounds."""
    monkeypatch.setattr(valuation, "BINS", bins)
    monkeypatch.setattr(valuation, "SMALL", small)
    kinds = ["even", "narrow", "outlier", "same", "two", "empty", "one"] + (["powers"] if bins > 4 else [])
    rows = [(k, v) for k in kinds for v in values(k, 60 if bins < 9 else 400, random.Random(2))] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    found = {r["k"]: r for r in valuation.percentiles(df, ["k"], "v", {"low": 0.0, "q": 0.25, "m": 0.5, "high": 1.0}).collect()}
    assert set(found) == {*kinds, None} - {"empty"}
    for k in found:
        known = [v for key, v in rows if key == k and v is not None and not math.isnan(v)]
        got = [found[k][c] for c in ("low", "q", "m", "high")]
        assert found[k]["n"] == len(known) and got == pytest.approx(np.quantile(known, [0, 0.25, 0.5, 1]).tolist(), rel=1e-12)


def test_places_of_whole_numbers_and_all_rows(spark, monkeypatch) -> None:
    monkeypatch.setattr(valuation, "SMALL", 3)
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    found = valuation.ranked_quantiles(df, [], "v", {"a": 0.0, "b": 0.333, "c": 1.0}).first()
    assert (found["n"], found["a"], found["b"], found["c"]) == (1000, 0, 333, 999)
    assert valuation.percentiles(df.where("v < 0"), [], "v", {"m": 0.5}).count() == 0


def sold(n: int, r: random.Random, streets: list) -> list[tuple]:
    day = lambda: r.choice([None, dt.date(2000, 1, 31) + dt.timedelta(days=r.randint(0, 2500))])
    return [(r.choice(streets), day() or dt.date(2003, 5, 31), r.choice([None, 0.0, 50.0, 60.0, 66.0, r.uniform(20, 200)]), i) for i in range(n)]


def fitting(rows: list[tuple]) -> dict[tuple, list]:
    """Per street, all pairs that fit, in the order of their turns."""
    log = math.log(1.3)
    known = [(s, d.year * 12 + d.month, math.floor(math.log(a) / log), i, a) for s, d, a, i in rows if s is not None and a]
    out = {}
    for street in {k[0] for k in known}:
        cells: dict[tuple, list] = {}
        for _, m, b, i, a in sorted(x for x in known if x[0] == street):
            cells.setdefault((m, b), []).append((i, a))
        both = [(x, y) for x in sorted(cells) for y in sorted(cells) if y[0] - x[0] >= 24 and abs(x[1] - y[1]) <= 1]
        every = [(p, q) for x, y in both for p in sorted(cells[x]) for q in sorted(cells[y])]
        turns = [(k * (2**61 - 1) % len(every), p[0], q[0]) for k, (p, q) in enumerate(every) if abs(math.log(q[1] / p[1])) <= log]
        if turns:
            out[street] = sorted(turns)
    return out


@pytest.mark.parametrize(("most", "draw"), [(150, 4), (5, 1), (1, 1)])
def test_drawn_pairs_by_loops(spark, most: int, draw: int) -> None:
    rows = sold(300, random.Random(8), [1, 1, 1, 2, 3, None]) + [(9, dt.date(2001, 1, 1), 70.0, 900), (9, dt.date(2003, 1, 1), 70.0, 901), (10, dt.date(2001, 1, 2), 70.0, 902), (10, dt.date(2002, 12, 31), 70.0, 903)]
    df = spark.createDataFrame(rows, "street long, day date, area double, id long").repartition(3)
    found: dict = {}
    for r in pairs.drawn_pairs(df, "street", "day", "area", ["id"], most=most, first_draw=draw).collect():
        found.setdefault(r["street"], []).append((r["turn"], r["a"]["id"], r["b"]["id"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: v[:most] for k, v in fitting(rows).items()}
    assert found[9] == [(0, 900, 901)] and 10 not in found


def test_a_hot_street_costs_its_draws(spark) -> None:
    """60,000 sales of a street have a billion pairs; 150 come of them, and every one fits."""
    df = spark.range(60_000).selectExpr("1 as street", "date_add(date'2000-01-01', cast(id * 37 % 3000 as int)) as day", "40 + id * 7919 % 100 / 2.0D as area", "id")
    found = pairs.drawn_pairs(df, "street", "day", "area", ["id"]).collect()
    assert len(found) == 150 and len({(r["a"]["id"], r["b"]["id"]) for r in found}) == 150
    for r in found:
        a, b = r["a"], r["b"]
        assert (b["day"].year - a["day"].year) * 12 + b["day"].month - a["day"].month >= 24 and abs(math.log(b["area"] / a["area"])) <= math.log(1.3) + 1e-12


def test_no_sales_no_pairs(spark) -> None:
    none = spark.createDataFrame([], "street long, day date, area double, id long")
    assert pairs.drawn_pairs(none, "street", "day", "area", ["id"]).count() == 0


def test_rows_of_large_groups_are_not_shuffled_to_their_places(spark, monkeypatch) -> None:
    """However small joins must be to be broadcast by themselves: a join by group would bring a large group to one task."""
    monkeypatch.setattr(valuation, "SMALL", 50)
    monkeypatch.setattr(valuation, "BINS", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(3000).selectExpr("if(id % 10 < 8, null, id % 500) as k", "cast((id * 7919) % 3000 as double) as v")
        out = valuation.ranked_quantiles(df, ["k"], "v", {"a": 0.0, "m": 0.5, "z": 1.0})
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        found = {r["k"]: tuple(r)[1:] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups: dict = {}
    for i in range(3000):
        groups.setdefault(None if i % 10 < 8 else i % 500, []).append(float(i * 7919 % 3000))
    assert found == {k: (len(v), min(v), sorted(v)[len(v) // 2], max(v)) for k, v in groups.items()}


def test_all_pairs_of_a_key_are_drawn_alike_without_python(spark) -> None:
    cells = spark.createDataFrame([(k, 10 * i + k, i % 2, 1 + (i * k) % 4) for k in range(1, 5) for i in range(9)], "k long, __month int, __band long, n long").withColumnRenamed("n", "__n").withColumnRenamed("__n", "k_")
    numbered = pairs.numbered_pairs(pairs.cell_pairs(cells.withColumnRenamed("k", "key").withColumnRenamed("k_", "k"), "key"), "key")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert "Python" not in pairs._all_drawn(numbered, "key")._jdf.queryExecution().executedPlan().toString()
    assert told(pairs._all_drawn(numbered, "key")) == told(pairs._drawn(numbered, "key", 0, 10**6)) != []
