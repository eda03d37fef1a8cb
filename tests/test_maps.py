"""Layers, nearest features and contexts against loops; readers and downloads that are stopped."""

from __future__ import annotations

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lotlens.operators import context as cx
from lotlens.sources import bulk, fetching
from lotlens.sources import features as ft

SAVED = "lotlens.sources.fetching:saved_answer"
SQUARE = [[[-46.70, -23.50], [-46.70, -23.51], [-46.71, -23.51], [-46.71, -23.50], [-46.70, -23.50]]]
HOLE = [[-46.704, -23.504], [-46.704, -23.506], [-46.706, -23.506], [-46.706, -23.504], [-46.704, -23.504]]
SCHEMA = "layer string, feature_id string, kind string, props map<string, string>, coordinates array<array<array<array<double>>>>"
CLIP = (-47.0, -24.0, -46.0, -23.0)


def contexts(spark, features: list[tuple], *points: tuple[float, float]) -> list[dict]:
    at = spark.createDataFrame([(i, lat, lon) for i, (lat, lon) in enumerate(points)], "point_id long, lat double, lon double")
    made = spark.createDataFrame([(layer, f"{layer}.{i}", cx.LAYERS[layer].kind, props, c) for i, (layer, props, c) in enumerate(features)], SCHEMA)
    found = cx.contexts(at, made, CLIP).select("point_id", F.to_json("context").alias("j")).orderBy("point_id").collect()
    return [json.loads(r["j"]) for r in found]


def test_only_what_was_found(spark) -> None:
    zone = ("zona", {"cd_zoneamento_perimetro": "ZM", "tx_zoneamento_perimetro": "Zona Mista"}, [SQUARE])
    metro = ("metro", {"nm_estacao_metro_trem": "LAPA", "nm_linha_metro_trem": "X"}, [[[[-46.705, -23.506]]]])
    inside, outside = contexts(spark, [zone, metro], (-23.505, -46.705), (-23.52, -46.705))
    assert inside["zona"] == {"sigla": "ZM", "nome": "Zona Mista"} and "zona" not in outside
    assert inside["metro"]["nome"] == "LAPA" and 100 < inside["metro"]["dist_m"] < 120
    assert inside["inundavel"] is False and inside["alagamentos_300m"] == 0
    assert not {"trem", "risco_geo", "favela", "contaminada"} & set(inside)


def test_holes_are_outside(spark) -> None:
    with_hole = ("solo_mole", {}, [[*SQUARE, HOLE]])
    assert [c["solo_mole"] for c in contexts(spark, [with_hole], (-23.501, -46.701), (-23.505, -46.705), (-23.52, -46.705))] == [True, False, False]


def test_pollution_by_kind(spark) -> None:
    """110 m north of a square: too far for what is only possible, near enough for what is known."""
    possible = ("contaminada_potencial", {"dc_tipo_situacao": "P", "dc_atividade": "Posto"}, [SQUARE])
    known = ("contaminada", {"dc_classificacao_area_contaminada": "C", "tx_endereco_area_contaminada": "X"}, [SQUARE])
    north, inside = (-23.499, -46.705), (-23.505, -46.705)
    outer, inner = contexts(spark, [possible], north, inside)
    assert "contaminada" not in outer and inner["contaminada"]["potencial"] is True and inner["contaminada"]["dist_m"] == 0
    (both,) = contexts(spark, [possible, known], north)
    assert both["contaminada"] == {"dist_m": 111, "classe": "C", "detalhe": "X", "potencial": False}


def test_floods_of_two_layers_are_counted(spark) -> None:
    spots = [("alagamento", {}, [[[[-46.700, -23.501]]]]), ("alagamento", {}, [[[[-46.700, -23.501]]]]), ("inundacao", {}, [[[[-46.701, -23.500]]]]), ("inundacao", {}, [[[[-46.65, -23.45]]]])]
    assert contexts(spark, spots, (-23.500, -46.700))[0]["alagamentos_300m"] == 3


def test_no_row_outside_of_the_clip(spark) -> None:
    clips = spark.createDataFrame([("zona", -46.8, -23.6, -46.6, -23.4), ("metro", -46.75, -23.7, -46.5, -23.45)], "layer string, minx double, miny double, maxx double, maxy double")
    clip = cx.common_clip(clips)
    assert clip == (-46.75, -23.6, -46.6, -23.45)
    points = spark.createDataFrame([(1, -23.5, -46.7), (2, -23.9, -46.1)], "point_id long, lat double, lon double")
    assert [r["point_id"] for r in cx.contexts(points, spark.createDataFrame([], SCHEMA), clip).collect()] == [1]
    assert cx.common_clip(clips.where("false")) is None


def distance(lat: float, lon: float, kind: str, parts: list) -> float:
    def segment(a: list, b: list) -> float:
        kx, ky = 111320.0 * math.cos(math.radians(lat)), 110540.0
        dx, dy, ux, uy = (b[0] - a[0]) * kx, (b[1] - a[1]) * ky, (lon - a[0]) * kx, (lat - a[1]) * ky
        t = 0 if dx == dy == 0 else max(0, min(1, (ux * dx + uy * dy) / (dx * dx + dy * dy)))
        return math.hypot(ux - t * dx, uy - t * dy)

    def within(ring: list) -> bool:
        odd = False
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > lat) != (b[1] > lat) and lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
        return odd

    if kind == "ponto":
        return min(math.hypot((p[0] - lon) * 111320.0 * math.cos(math.radians((lat + p[1]) / 2)), (p[1] - lat) * 110540.0) for part in parts for ring in part for p in ring)
    if kind == "poligono" and any(within(part[0]) and not any(map(within, part[1:])) for part in parts):
        return 0.0
    return min(segment(a, b) for part in parts for ring in part for a, b in zip(ring, ring[1:], strict=False))


@pytest.mark.parametrize("size", [0.004, 0.03])
def test_found_by_loops(spark, size: float) -> None:
    """Long lines, polygons of many cells, holes, parts, points on the grid; cells smaller and larger than the features."""
    r = random.Random(4)
    features, near = [], lambda x, s: x + r.uniform(-s, s)
    for i in range(60):
        layer = list(cx.LAYERS)[i % 20]
        lon, lat = -46.7 + r.random() * 0.08, -23.6 + r.random() * 0.08

        def ring(s: float, lon: float = lon, lat: float = lat) -> list:
            out = [[lon + s * math.cos(k) * r.uniform(0.5, 1), lat + s * math.sin(k) * r.uniform(0.5, 1)] for k in range(7)]
            return [*out, out[0]]

        kind = cx.LAYERS[layer].kind
        line = lambda n, lon=lon, lat=lat: [[near(lon, 0.03), near(lat, 0.03)] for _ in range(n)]
        parts = {"ponto": [[[[lon, lat]]]], "linha": [[line(5), [[lon, lat - 0.02], [lon, lat + 0.02]]]], "poligono": [[ring(0.02), ring(0.004)]] if i % 3 else [[ring(0.01)], [[[-46.68, -23.58], [-46.64, -23.58], [-46.64, -23.56], [-46.68, -23.58]]]]}[kind]
        features.append((layer, f"{layer}.{i}", kind, {}, parts))
    points = [(k, -23.62 + r.random() * 0.12, -46.72 + r.random() * 0.12) for k in range(150)] + [(150, -23.58, -46.66), (151, -23.56, -46.68), (152, -23.6, -46.7)]
    wanted = {(k, fid): d for k, lat, lon in points for layer, fid, kind, _, parts in features if (d := distance(lat, lon, kind, parts)) <= cx.LAYERS[layer].reach}
    at = spark.createDataFrame(points, "point_id long, lat double, lon double")
    rows = cx.found(at, cx.informed(spark.createDataFrame(features, SCHEMA)), {k: x.reach for k, x in cx.LAYERS.items()}, size).collect()
    found = {(x["point_id"], x["feature_id"]): x["metres"] for x in rows}
    assert len(rows) == len(found) and set(found) == set(wanted)
    assert max(abs(found[k] - wanted[k]) for k in found) < 1e-6


# Reading layers.

def feature(i: int, kind: str, coordinates: object, **props: object) -> dict:
    return {"id": f"f{i}", "geometry": {"type": kind, "coordinates": coordinates} if kind else None, "properties": props}


def answer(folder: str, layer: str, start: int, features: list[dict], total: int | None = None) -> None:
    at = f"{folder}/layer={layer}/start={start}"
    os.makedirs(at)
    with open(f"{at}/part-0.txt", "w") as f:
        json.dump({"numberMatched": len(features) if total is None else total, "features": features}, f)


def test_all_kinds_in_one_type(spark, tmp_path) -> None:
    shapes = [("Point", [1.12345678, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0], [1, 1]]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), ("Polygon", SQUARE), ("MultiPolygon", [SQUARE, SQUARE])]
    answer(str(tmp_path), "a", 0, [*(feature(i, k, c, n=i, empty="", none=None) for i, (k, c) in enumerate(shapes)), feature(9, "", None)])
    rows = {r["feature_id"]: r for r in ft.features(spark, SAVED, ["a"], folder=f"file://{tmp_path}").collect()}
    assert {k: (r["kind"], len(r["coordinates"]), len(r["coordinates"][0])) for k, r in rows.items()} == {"f0": ("ponto", 1, 1), "f1": ("ponto", 2, 1), "f2": ("linha", 1, 1), "f3": ("linha", 1, 2), "f4": ("poligono", 1, 1), "f5": ("poligono", 2, 1)}
    assert rows["f0"]["coordinates"] == [[[[1.123457, 2.0]]]] and rows["f0"]["props"] == {"n": "0"}
    assert (rows["f3"]["minx"], rows["f3"]["maxy"]) == (0.0, 3.0)


def test_filters_reach_the_service(spark, tmp_path) -> None:
    answer(str(tmp_path), "a", 0, [feature(i, "Point", [i, i], open="yes" if i % 2 else "no") for i in range(10)])
    rows = ft.features(spark, SAVED, ["a", "missing"], {"a": ("open", "yes")}, tiles=3, folder=f"file://{tmp_path}")
    asked = rows.where((F.col("layer") == "a") & (F.col("minx") <= 7) & (F.col("maxx") >= 2) & (F.col("miny") < 8) & (F.col("maxy") > 1))  # the layer without answers isn't asked for
    assert sorted(r["feature_id"] for r in asked.collect()) == ["f3", "f5", "f7"]
    reader = ft.FeatureReader({"fetcher": SAVED, "layers": "a,b", "tiles": "2"})
    left = list(reader.pushFilters([ft.EqualTo(("layer",), "a"), ft.LessThanOrEqual(("minx",), 7.0), ft.GreaterThan(("maxx",), 2.0), ft.LessThan(("miny",), 8.0), ft.GreaterThanOrEqual(("maxy",), 1.0), ft.LessThan(("maxx",), 3.0)]))
    assert len(left) == 5 and reader.layers == ["a"] and reader.box == [2.0, 1.0, 7.0, 8.0]
    tiles = reader.partitions()
    assert [t.box for t in tiles] == [(2.0, 1.0, 4.5, 4.5), (2.0, 4.5, 4.5, 8.0), (4.5, 1.0, 7.0, 4.5), (4.5, 4.5, 7.0, 8.0)]


def test_a_feature_of_several_tiles_comes_once(spark, tmp_path) -> None:
    answer(str(tmp_path), "a", 0, [feature(0, "LineString", [[0, 0], [9, 9]]), feature(1, "LineString", [[-5, 4], [20, 4]]), feature(2, "Point", [4.5, 4.5])])
    rows = ft.features(spark, SAVED, ["a"], tiles=4, folder=f"file://{tmp_path}").where("minx <= 9 and maxx >= 0 and miny <= 9 and maxy >= 0")
    assert sorted(r["feature_id"] for r in rows.collect()) == ["f0", "f1", "f2"]


def test_too_few_features_are_an_error(spark, tmp_path) -> None:
    answer(str(tmp_path), "a", 0, [feature(0, "Point", [1, 1])], total=2)
    with pytest.raises(Exception, match="1 of 2 features"):
        ft.features(spark, SAVED, ["a"], folder=f"file://{tmp_path}").collect()


def test_layers_are_replaced_one_by_one(spark, tmp_path) -> None:
    answer(f"{tmp_path}/x", "a", 0, [feature(0, "Point", [1, 1]), feature(1, "Point", [2, 2])])
    answer(f"{tmp_path}/x", "b", 0, [feature(2, "Point", [1, 1])])
    answer(f"{tmp_path}/y", "a", 0, [feature(7, "Point", [1, 1])])
    for part, layers in (("x", ["a", "b"]), ("y", ["a"])):
        ft.store_layers(ft.features(spark, SAVED, layers, folder=f"file://{tmp_path}/{part}"), f"{tmp_path}/kept")
    assert sorted(r["feature_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == ["f2", "f7"]


# Bulk downloads.

def lot(i: int, street: str = "RUA A", **more: str) -> dict:
    return {"properties": {"cd_setor_fiscal": "1", "cd_quadra_fiscal": "2", "cd_lote": str(i), "nm_logradouro_completo": street, "cd_numero_porta": f"nº {i}", "qt_area_terreno": "-1" if i % 2 else str(i)} | more}


def pages_of(folder: str, total: int, size: int, skip: tuple[int, ...] = ()) -> None:
    for start in range(0, total, size):
        if start not in skip:
            answer(folder, "lots", start, [lot(i) for i in range(start, min(start + size, total))], total)


def test_a_stopped_download_goes_on(spark, tmp_path) -> None:
    """The service fails at the third batch; the next run begins there, and what had come before isn't fetched again."""
    folder, kept = f"{tmp_path}/answers", f"{tmp_path}/kept"
    pages_of(folder, 47, 5, skip=(30,))
    run = lambda: bulk.download(spark, kept, SAVED, "lots", size=5, pages_per_batch=2, tasks=2, folder=f"file://{folder}")
    with pytest.raises(Exception, match="no answer to"):
        run()
    assert sorted(int(r["lot"]) for r in bulk.downloaded(spark, kept).collect()) == list(range(30))
    for start in range(0, 30, 5):
        os.rename(f"{folder}/layer=lots/start={start}", f"{tmp_path}/gone-{start}" if start else f"{tmp_path}/first")
    os.rename(f"{tmp_path}/first", f"{folder}/layer=lots/start=0")  # it also says how many there are
    answer(folder, "lots", 30, [lot(i) for i in range(30, 35)], 47)
    assert run() == 2
    rows = bulk.downloaded(spark, kept).collect()
    assert sorted(int(r["lot"]) for r in rows) == list(range(47)) and spark.read.parquet(f"{kept}/lots").count() == 47
    assert {(r["number"], r["land"]) for r in rows if r["lot"] in ("6", "7")} == {("6", 6.0), ("7", None)}
    assert run() == 0


def test_new_lots_are_fetched_later(spark, tmp_path) -> None:
    folder, kept = f"{tmp_path}/answers", f"{tmp_path}/kept"
    pages_of(folder, 8, 5)
    run = lambda: bulk.download(spark, kept, SAVED, "lots", size=5, pages_per_batch=9, tasks=1, folder=f"file://{folder}")
    assert run() == 1
    os.rename(f"{folder}/layer=lots/start=0", f"{tmp_path}/old")
    answer(folder, "lots", 0, [lot(0)], 11)
    answer(folder, "lots", 8, [lot(8), lot(9), lot(0, "RUA B")], 11)
    assert run() == 1
    rows = {r["lot"]: r["street"] for r in bulk.downloaded(spark, kept).collect()}
    assert sorted(rows) == sorted(map(str, range(10))) and rows["0"] == "RUA B"


def test_short_pages_and_unknown_fetchers_are_errors(spark, tmp_path) -> None:
    answer(str(tmp_path), "lots", 0, [lot(0)], 3)
    with pytest.raises(Exception, match="1 of 3 features"):
        bulk.download(spark, f"{tmp_path}/kept", SAVED, "lots", folder=f"file://{tmp_path}")
    with pytest.raises(ValueError, match="package.module:function"):
        fetching.fetcher("saved_answer")
    with pytest.raises(AttributeError):
        fetching.fetcher("lotlens.sources.fetching:nothing")


def test_answers_are_asked_for_again(monkeypatch) -> None:
    said = iter([RuntimeError("down"), "<ExceptionReport>", '<x numberMatched="12">'])

    def flaky(request: dict) -> str:
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    monkeypatch.setattr(fetching, "fetcher", lambda path: flaky)
    assert fetching.announced(fetching.fetched("any", {}, wait=0)) == 12
    assert fetching.announced('{"features": [], "numberMatched": 7}') == 7 and fetching.announced("{}") is None


def test_a_long_download_has_few_batches(tmp_path) -> None:
    (tmp_path / "layer=lots" / "start=0").mkdir(parents=True)
    (tmp_path / "layer=lots" / "start=0" / "part-0").write_text('{"numberMatched": 900000, "features": []}')
    reader = bulk.PageRequests({"fetcher": SAVED, "layer": "lots", "size": "100", "pagesPerBatch": "3", "folder": f"file://{tmp_path}"})
    at, batches, asked = reader.initialOffset(), 0, []
    while at["row"] < 900_000:
        rows, at = reader.read(at)
        asked += rows
        batches += 1
    assert batches <= bulk.MOST_BATCHES + 1 and [(r[1], r[2]) for r in asked] == [(n, 100) for n in range(0, 900_000, 100)]
