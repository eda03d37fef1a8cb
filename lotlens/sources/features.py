"""Map layers as a data source: points, lines and polygons in one type, and filters that reach the service.

A row is a feature. ``coordinates`` is an array of parts of rings of points [lon, lat] for every kind: a point is one
part of one ring of one point, lines are the rings of one part, polygons are the parts, whose further rings are holes.
``layer = ...``, ``layer IN ...`` choose what is asked for; comparisons of minx, miny, maxx and maxy with numbers become the
box of the request, and features outside of it never leave the reader. The box is asked for in tiles, a partition each;
a feature that several tiles send is kept by the one that holds its lower left corner.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .fetching import announced, fetched, fetcher

# The most features of one answer, decimals of a coordinate, and the levels of a geometry above its points.
MOST, DECIMALS = 300_000, 6
LEVELS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
SCHEMA = "layer string, feature_id string, kind string, props map<string, string>, minx double, miny double, maxx double, maxy double, coordinates array<array<array<array<double>>>>"
_KINDS = {"Point": "ponto", "MultiPoint": "ponto", "LineString": "linha", "MultiLineString": "linha", "Polygon": "poligono", "MultiPolygon": "poligono"}

Box = tuple[float, float, float, float]


class Tile(InputPartition):
    def __init__(self, layer: str, box: Box, owned: Box) -> None:
        self.layer, self.box, self.owned = layer, box, owned


def parts(kind: str, coordinates: list) -> list:
    """Coordinates of any kind of geometry as parts of rings of points, rounded."""
    if kind not in LEVELS:
        raise ValueError(f"no geometry of kind {kind}")
    if kind == "MultiPoint":
        coordinates = [[[p]] for p in coordinates]
    elif kind == "MultiLineString":
        coordinates = [coordinates]
    else:
        for _ in range(3 - LEVELS[kind]):
            coordinates = [coordinates]
    return [[[[round(float(p[0]), DECIMALS), round(float(p[1]), DECIMALS)] for p in ring] for ring in part] for part in coordinates]


class FeatureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.fetch = dict(options), options["fetcher"]
        fetcher(self.fetch)
        self.layers = [x for x in options.get("layers", "").split(",") if x]
        self.box = [-math.inf, -math.inf, math.inf, math.inf]
        self.tiles = int(options.get("tiles", "1"))
        #: field=value by layer: features of other values are left out.
        self.only = {k[5:]: v.split("=", 1) for k, v in options.items() if k.startswith("only.")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        bounds = {"minx": (2, min), "miny": (3, min), "maxx": (0, max), "maxy": (1, max)}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column == "layer" and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.layers = [x for x in self.layers if x in wanted]
                continue  # nothing else is asked for, so nothing is left to compare
            upper, lower = isinstance(f, LessThan | LessThanOrEqual), isinstance(f, GreaterThan | GreaterThanOrEqual)
            if column in bounds and (upper if column.startswith("min") else lower):
                side, tighter = bounds[column]
                self.box[side] = tighter(self.box[side], float(f.value))
            yield f

    def partitions(self) -> list[Tile]:
        x0, y0, x1, y1 = self.box
        if self.tiles == 1 or not all(map(math.isfinite, self.box)) or x0 > x1 or y0 > y1:
            return [Tile(layer, (x0, y0, x1, y1), (-math.inf, -math.inf, math.inf, math.inf)) for layer in self.layers]
        xs, ys = ([a + (b - a) * i / self.tiles for i in range(self.tiles + 1)] for a, b in ((x0, x1), (y0, y1)))
        out = []
        for i in range(self.tiles):
            for j in range(self.tiles):
                # The outer tiles own what begins outside of the box.
                owned = (xs[i] if i else -math.inf, ys[j] if j else -math.inf, xs[i + 1] if i + 1 < self.tiles else math.inf, ys[j + 1] if j + 1 < self.tiles else math.inf)
                out += [Tile(layer, (xs[i], ys[j], xs[i + 1], ys[j + 1]), owned) for layer in self.layers]
        return out

    def read(self, part: Tile) -> Iterator[tuple]:
        request = self.options | {"layer": part.layer, "start": "0", "count": str(MOST)}
        if all(map(math.isfinite, part.box)):
            request["box"] = ",".join(map(repr, part.box))
        text = fetched(self.fetch, request)
        answer = json.loads(text)
        features, total = answer.get("features") or [], announced(text[: text.find('"features"')] + text[text.rfind("]") :])
        if total is not None and total > len(features):
            raise RuntimeError(f"{part.layer}: {len(features)} of {total} features")
        field, value = self.only.get(part.layer, (None, None))
        for i, f in enumerate(features):
            geometry, props = f.get("geometry"), f.get("properties") or {}
            if not geometry or not geometry.get("coordinates") or (field and str(props.get(field)) != value):
                continue
            coordinates = parts(geometry["type"], geometry["coordinates"])
            xs, ys = zip(*(p for a in coordinates for ring in a for p in ring), strict=True)
            box = min(xs), min(ys), max(xs), max(ys)
            if box[0] > part.box[2] or box[1] > part.box[3] or box[2] < part.box[0] or box[3] < part.box[1]:
                continue
            if not (part.owned[0] <= box[0] < part.owned[2] and part.owned[1] <= box[1] < part.owned[3]):
                continue
            said = {k: str(v) for k, v in props.items() if v not in (None, "")}
            yield (part.layer, str(f.get("id", f"{part.layer}.{i}")), _KINDS[geometry["type"]], said, *box, coordinates)


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "map_features"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options)


def features(spark: SparkSession, path: str, layers: list[str], only: dict[str, tuple[str, str]] | None = None, tiles: int = 1, **options: str) -> DataFrame:
    """Features of the layers. path: the fetcher's import path; only: field and value that a layer's features must have."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureSource)
    conditions = {f"only.{layer}": f"{field}={value}" for layer, (field, value) in (only or {}).items()}
    return spark.read.format("map_features").options(fetcher=path, layers=",".join(layers), tiles=tiles, **conditions, **options).load()


def store_layers(found: DataFrame, folder: str) -> None:
    """Replaces the layers that the rows are of; the others stay."""
    found.write.partitionBy("layer").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
