"""Map layers and bulk downloads: suppliers drawn as features of all kinds around customers, customers as lots of a service."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context as cx
from ..sources import bulk, fetching
from ..sources import features as ft
from ..sources import views as v
from ..storage import shared_folder
from .registry import query

_SAVED = "lotlens.sources.fetching:saved_answer"
_LAYERS = list(cx.LAYERS)
#: What is drawn around a supplier, by kind and variant: parts of rings of offsets in degrees.
_SHAPES: dict[tuple[str, int], tuple[str, list]] = {
    ("linha", 0): ("LineString", [[[(-0.021, -0.011), (-0.0052, 0.0041), (0.0063, -0.0034), (0.0212, 0.0103)]]]),
    ("linha", 1): ("MultiLineString", [[[(-0.0113, 0.0), (0.0107, 0.0031)], [(0.0, 0.0109), (0.0041, -0.0127), (0.0083, -0.0127)]]]),
    ("poligono", 0): ("Polygon", [[[(-0.0071, -0.0052), (0.0013, -0.0088), (0.0079, 0.0011), (0.0, 0.0064), (-0.0071, -0.0052)]]]),
    ("poligono", 1): ("Polygon", [[[(-0.0063, -0.0061), (0.0062, -0.0061), (0.0062, 0.0064), (-0.0063, 0.0064), (-0.0063, -0.0061)], [(-0.0021, -0.0024), (0.0023, -0.0012), (0.0009, 0.0031), (-0.0021, -0.0024)]]]),
    ("poligono", 2): ("MultiPolygon", [[[(-0.0091, 0.0011), (-0.0022, 0.0011), (-0.0022, 0.0083), (-0.0091, 0.0083), (-0.0091, 0.0011)]], [[(0.0031, -0.0032), (0.0102, -0.0071), (0.0084, 0.0042), (0.0031, -0.0032)]]]),
}
_KINDS = {layer: rule.kind for layer, rule in cx.LAYERS.items()}
_CLIP = (-46.70, -23.60, -46.61, -23.51)
_MARGIN = 0.03


def _shape_rows() -> str:
    rows = [("ponto", n, 0, 0, 0, 0.0, 0.0) for n in range(3)]
    for (kind, variant), (_, parts) in _SHAPES.items():
        for n in (variant,) if kind == "poligono" else (variant, 2) if variant else (variant,):
            rows += [(kind, n, p, r, i, dx, dy) for p, part in enumerate(parts) for r, ring in enumerate(part) for i, (dx, dy) in enumerate(ring)]
    return ", ".join(f"('{k}', {n}, {p}, {r}, {i}, {dx}::DOUBLE, {dy}::DOUBLE)" for k, n, p, r, i, dx, dy in rows)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_FT = f"""ft AS (SELECT s_suppkey AS k, {_sql_list(_LAYERS)}[s_suppkey % 20 + 1] AS layer, {_sql_list(list(_KINDS.values()))}[s_suppkey % 20 + 1] AS kind, (s_suppkey // 20 % 3)::INT AS variant, s_suppkey // 20 % 4 < 3 AS open,
  -23.60 + (s_suppkey * 53 % 1000) * 0.0001::DOUBLE AS lat, -46.70 + (s_suppkey * 17 % 1000) * 0.0001::DOUBLE AS lon FROM supplier),
sh(kind, variant, part, ring, seq, dx, dy) AS (VALUES {_shape_rows()}),
vx AS (SELECT k, layer, kind, open, part, ring, seq, round(lon + dx, 6) AS x, round(lat + dy, 6) AS y FROM ft JOIN sh USING (kind, variant))"""

_HITS = f"""WITH pt AS (SELECT c_custkey AS point_id, -23.60 + (c_custkey * 37 % 1000) * 0.0001::DOUBLE AS lat, -46.70 + (c_custkey * 91 % 1000) * 0.0001::DOUBLE AS lon FROM customer), {_FT},
reach(layer, reach) AS (VALUES {', '.join(f"('{k}', {r.reach})" for k, r in cx.LAYERS.items())}),
used AS (SELECT * FROM vx WHERE open OR layer NOT IN ({', '.join(f"'{k}'" for k, r in cx.LAYERS.items() if r.only)})),
ed AS (SELECT a.k, a.layer, a.kind, a.part, a.ring, a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy FROM used a JOIN used b ON b.k = a.k AND b.part = a.part AND b.ring = a.ring AND b.seq = a.seq + (a.kind <> 'ponto')::INT),
s AS (SELECT point_id, k, layer, kind, part, ring, (ay > lat) <> (zy > lat) AND lon < (zx - ax) * (lat - ay) / (zy - ay) + ax AS crosses, CASE WHEN kind = 'ponto' THEN sqrt(pow((ax - lon) * 111320.0::DOUBLE * cos(radians((lat + ay) / 2)), 2) + pow((ay - lat) * 110540.0::DOUBLE, 2)) END AS apart,
  111320.0::DOUBLE * cos(radians(lat)) AS kx, 110540.0::DOUBLE AS ky, (zx - ax) * kx AS dx, (zy - ay) * ky AS dy, (lon - ax) * kx AS ux, (lat - ay) * ky AS uy, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ux * dx + uy * dy) / (dx * dx + dy * dy))) END AS t FROM pt, ed),
r AS (SELECT point_id, k, layer, kind, part, ring, min(coalesce(apart, sqrt(pow(ux - t * dx, 2) + pow(uy - t * dy, 2)))) AS m, count(*) FILTER (crosses) % 2 = 1 AS odd FROM s GROUP BY point_id, k, layer, kind, part, ring),
q AS (SELECT point_id, k, layer, kind, part, min(m) AS m, bool_or(odd AND ring = 0) AND NOT bool_or(odd AND ring > 0) AS inside FROM r GROUP BY point_id, k, layer, kind, part),
h AS (SELECT point_id, layer, k, layer || '.' || k AS feature_id, CASE WHEN kind = 'poligono' AND bool_or(inside) THEN 0 ELSE min(m) END AS metres, kind = 'poligono' AND bool_or(inside) AS inside FROM q GROUP BY point_id, layer, k, kind),
hit AS (SELECT h.* FROM h JOIN reach USING (layer) WHERE inside OR reach > 0 AND metres <= reach),
best AS (SELECT point_id, layer, arg_min(k, ROW(metres, feature_id)) AS k, arg_min(feature_id, ROW(metres, feature_id)) AS feature_id, min(metres) AS metres FROM hit GROUP BY point_id, layer)"""


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "customer").selectExpr("c_custkey as point_id", "-23.60D + (c_custkey * 37 % 1000) * 0.0001D as lat", "-46.70D + (c_custkey * 91 % 1000) * 0.0001D as lon")


def _drawn(spark: SparkSession, sf_dir: str) -> str:
    """The suppliers as answers of a map service, one a layer; the folder that they are saved in."""
    k, lon, lat = F.col("k"), F.col("lon"), F.col("lat")
    s = v.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "-23.60D + (s_suppkey * 53 % 1000) * 0.0001D as lat", "-46.70D + (s_suppkey * 17 % 1000) * 0.0001D as lon").withColumn("layer", F.get(F.lit(_LAYERS), (k % 20).cast("int")))
    variant = F.expr("k div 20 % 3").cast("int")

    def geometry(kind: str, n: int) -> Column:
        if kind == "ponto":
            return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
        name, parts = _SHAPES.get((kind, n)) or _SHAPES[kind, 1]
        nested = F.array(*[F.array(*[F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ring]) for ring in part]) for part in parts])
        for _ in range(3 - ft.LEVELS[name] if name != "MultiLineString" else 1):
            nested = nested[0]
        return F.to_json(F.struct(F.lit(name).alias("type"), nested.alias("coordinates")))

    shape = F.coalesce(*[F.when(F.col("layer").isin(*[x for x in _LAYERS if _KINDS[x] == kind]) & (variant == n), geometry(kind, n)) for kind in ("ponto", "linha", "poligono") for n in range(3)])
    situation = F.expr("k div 20 % 4 < 3")
    props = F.coalesce(*[
        F.when(F.col("layer") == name, F.to_json(F.struct(*[(k % 7 + i).cast("string").alias(p) for i, p in enumerate(rule.props)], *([F.when(situation, rule.only[1]).otherwise("OTHER").alias(rule.only[0])] if rule.only else [F.lit("").alias("blank")]))))
        for name, rule in cx.LAYERS.items()
    ])
    one = s.select("layer", k.alias("k"), F.concat(F.lit('{"id": "'), F.col("layer"), F.lit("."), k.cast("string"), F.lit('", "properties": '), props, F.lit(', "geometry": '), shape, F.lit("}")).alias("f"))
    by = one.groupBy("layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("f")).alias("fs"))
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    fetching.save_answers(by.select("layer", F.lit(0).alias("start"), F.concat(F.lit('{"numberMatched": '), F.col("n").cast("string"), F.lit(', "features": ['), F.array_join("fs", ", "), F.lit("]}")).alias("body")), folder)
    return folder


def layer_rows(spark: SparkSession, sf_dir: str, tiles: int = 1) -> DataFrame:
    """The layers that some supplier is drawn in, within the clip and its margin."""
    folder = _drawn(spark, sf_dir)
    there = [r["layer"] for r in spark.read.text(f"{folder}").select("layer").distinct().collect()]  # at most the 20 layers
    only = {k: r.only for k, r in cx.LAYERS.items() if r.only}
    rows = ft.features(spark, _SAVED, [x for x in _LAYERS if x in there], only, tiles, folder=_uri(folder))
    x0, y0, x1, y1 = _CLIP
    return rows.where((F.col("minx") <= x1 + _MARGIN) & (F.col("maxx") >= x0 - _MARGIN) & (F.col("miny") <= y1 + _MARGIN) & (F.col("maxy") >= y0 - _MARGIN))


@query("layer_features", f"""WITH {_FT} SELECT layer, layer || '.' || k AS feature_id, kind, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(DISTINCT part) AS parts, count(*) AS n_points FROM vx
WHERE layer IN ('parque', 'corredor', 'zona', 'metro') AND (open OR layer NOT IN ('parque', 'metro')) GROUP BY layer, k, kind HAVING min(x) <= -46.62 AND max(x) >= -46.69 AND min(y) <= -23.51 AND max(y) >= -23.59""")
def layer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and a box that the source is asked for, the box in tiles."""
    rows = layer_rows(spark, sf_dir, tiles=3).where(F.col("layer").isin("parque", "corredor", "zona", "metro") & (F.col("minx") <= -46.62) & (F.col("maxx") >= -46.69) & (F.col("miny") <= -23.51) & (F.col("maxy") >= -23.59))
    return rows.select("layer", "feature_id", "kind", "minx", "miny", "maxx", "maxy", F.size("coordinates").cast("long").alias("parts"), F.size(F.flatten(F.flatten("coordinates"))).cast("long").alias("n_points"))


@query("nearest_features", f"{_HITS} SELECT point_id, layer, feature_id, round(metres, 4) AS metres FROM best WHERE layer IN ('metro', 'corredor', 'parque', 'favela', 'risco_geo')")
def nearest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest station, road and areas, inside of which the distance is 0."""
    wanted = {k: cx.LAYERS[k].reach for k in ("metro", "corredor", "parque", "favela", "risco_geo")}
    rows = layer_rows(spark, sf_dir).where(F.col("layer").isin(*wanted))
    return cx.nearest(_points(spark, sf_dir), cx.informed(rows), wanted).select("point_id", "layer", "feature_id", F.round("metres", 4).alias("metres"))


def _context_sql() -> str:
    at = lambda layer, what: f"max(CASE WHEN layer = '{layer}' THEN {what} END)"
    prop = lambda i: f"(k % 7 + {i})::VARCHAR"
    metres = "round_even(metres, 0)::BIGINT"
    columns = [
        f"{at('zona', prop(0))} AS zone", f"{at('zona', prop(1))} AS zone_name", *[f"coalesce(bool_or(layer = '{x}'), false) AS {x}" for x in ("inundavel", "solo_mole", "tombado")], "coalesce(any_value(floods), 0) AS floods",
        *[f"{at(x, metres)} AS {x}_m, {at(x, prop(0))} AS {x}, {at(x, prop(1))} AS {x}_name, {at(x, 'metres = 0')} AS {x}_inside" for x in ("risco_hidro", "risco_geo")], f"{at('risco_geo', prop(2))} AS process",
        f"{at('declividade', prop(0))} AS slope", f"{at('ipvs', 'k % 7')}::INT AS ipvs", f"coalesce({at('contaminada', metres)}, {at('contaminada_potencial', metres)}) AS polluted_m", f"coalesce({at('contaminada', prop(0))}, {at('contaminada_potencial', prop(0))}) AS polluted",
        f"CASE WHEN bool_or(layer = 'contaminada') THEN false WHEN bool_or(layer = 'contaminada_potencial') THEN true END AS potential", f"{at('envoltoria', prop(0))} AS surroundings", f"{at('operacao_urbana', prop(0))} AS operation",
        *[f"{at(x, metres)} AS {x}_m, {at(x, prop(0))} AS {x}" for x in ("favela", "metro", "trem", "parque", "hospital", "corredor")], f"{at('metro', prop(1))} AS line",
    ]
    return f"""{_HITS}, fl AS (SELECT point_id, count(*) AS floods FROM hit WHERE layer IN ('alagamento', 'inundacao') GROUP BY point_id)
SELECT p.point_id, {', '.join(columns)} FROM pt p LEFT JOIN best b ON b.point_id = p.point_id LEFT JOIN fl ON fl.point_id = p.point_id WHERE lon BETWEEN {_CLIP[0]} AND {_CLIP[2]} AND lat BETWEEN {_CLIP[1]} AND {_CLIP[3]} GROUP BY p.point_id"""


@query("spatial_context", _context_sql())
def spatial_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 20 layers around each point, as one row."""
    c = cx.contexts(_points(spark, sf_dir), layer_rows(spark, sf_dir), _CLIP)
    of = lambda path, name: F.col(f"context.{path}").alias(name)
    return c.select(
        "point_id", of("zona.sigla", "zone"), of("zona.nome", "zone_name"), of("inundavel", "inundavel"), of("solo_mole", "solo_mole"), of("tombado", "tombado"), of("alagamentos_300m", "floods"),
        *[of(f"{x}.{a}", f"{x}{b}") for x in ("risco_hidro", "risco_geo") for a, b in (("dist_m", "_m"), ("grau", ""), ("nome", "_name"), ("dentro", "_inside"))], of("risco_geo.tipo", "process"), of("declividade", "slope"), of("ipvs", "ipvs"),
        of("contaminada.dist_m", "polluted_m"), of("contaminada.classe", "polluted"), of("contaminada.potencial", "potential"), of("envoltoria", "surroundings"), of("operacao_urbana", "operation"),
        *[of(f"{x}.{a}", f"{x}{b}") for x in ("favela", "metro", "trem", "parque", "hospital", "corredor") for a, b in (("dist_m", "_m"), ("nome", ""))], of("metro.linha", "line"),
    )


# A bulk download.

@query("bulk_lots", """SELECT lpad((c_custkey // 100)::VARCHAR, 3, '0') AS sector, (c_custkey % 90)::VARCHAR AS lot, 'RUA ' || c_mktsegment AS street, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 4)::VARCHAR || (c_custkey % 10)::VARCHAR ELSE '' END AS number,
  count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS with_land, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 2) AS land FROM customer WHERE c_custkey % 11 > 0 GROUP BY ALL""")
def bulk_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the lots of a service with pages of 100 rows, fetched three pages a batch; those without a street go."""
    c = v.table(spark, sf_dir, "customer")
    first = c.agg(F.min("c_custkey").alias("k"), F.count("*").alias("n")).first()
    field = {
        "cd_setor_fiscal": F.lpad(F.expr("cast(c_custkey div 100 as string)"), 3, "0"), "cd_quadra_fiscal": F.lit(" 7 "), "cd_lote": (F.col("c_custkey") % 90).cast("string"), "tx_complemento_endereco": F.col("c_custkey").cast("string"),
        "nm_logradouro_completo": F.when(F.col("c_custkey") % 11 > 0, F.concat(F.lit(" RUA "), "c_mktsegment")), "cd_numero_porta": F.when(F.col("c_custkey") % 4 > 0, F.concat((F.col("c_custkey") % 4).cast("string"), F.lit("-"), (F.col("c_custkey") % 10).cast("string"))),
        "qt_area_terreno": F.col("c_acctbal").cast("string"),
    }
    place = F.col("c_custkey") - first["k"]
    feature = F.struct(F.struct(*[x.alias(k) for k, x in field.items()]).alias("properties"))
    pages = c.select((F.floor(place / 100) * 100).cast("long").alias("start"), F.struct(F.col("c_custkey"), feature.alias("f")).alias("f")).groupBy("start").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    bodies = pages.select(F.lit("lots").alias("layer"), "start", F.to_json(F.struct(F.lit(first["n"]).alias("numberMatched"), F.transform("fs", lambda f: f["f"]).alias("features"))).alias("body"))
    folder = f"{shared_folder(spark)}/lots-{uuid.uuid4().hex}"
    fetching.save_answers(bodies, f"{folder}/answers")
    bulk.download(spark, f"{folder}/kept", _SAVED, "lots", size=100, pages_per_batch=3, folder=_uri(f"{folder}/answers"))
    found = bulk.downloaded(spark, f"{folder}/kept")
    return found.groupBy("sector", "lot", "street", "number").agg(F.count("*").alias("n"), F.count("land").alias("with_land"), F.round(F.sum("land"), 2).alias("land"))
