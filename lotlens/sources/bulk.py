"""A bulk download that goes on where it was stopped: a stream of page requests, whose offset is the rows asked for so far.

The stream itself only says what to ask for next, which is all that the driver holds; executors fetch the pages, a row of
requests each, and check that a page is as long as the service announced. The checkpoint keeps the offset: after a run that
was killed, or whose page failed, the next one asks for the first page that no finished batch has. A batch that is run again
writes to the folder of its number again, so that no row is lost and none is there twice; rows of a key that the service
sends again later replace the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions.address import street_key
from .fetching import announced, fetched, fetcher

# Rows of a page, batches of a download of any length, and the attributes of a lot.
PAGE_ROWS, MOST_BATCHES = 1000, 32
LOT_FIELDS = [
    "cd_setor_fiscal", "cd_quadra_fiscal", "cd_lote", "tx_complemento_endereco", "nm_logradouro_completo", "cd_numero_porta", "dc_tipo_uso_imovel", "cd_tipo_terreno_imovel", "tx_situ_lote", "qt_area_terreno", "qt_area_construida",
]
LOT_KEY = ["sector", "block", "lot", "complement"]


class PageRequests(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.fetch = dict(options), options["fetcher"]
        fetcher(self.fetch)
        self.layer, self.size, self.per = options["layer"], int(options.get("size", PAGE_ROWS)), int(options.get("pagesPerBatch", "32"))
        self.total = -1

    def initialOffset(self) -> dict:
        return {"row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Requests for the next pages, of what the service says there is now."""
        if start["row"] >= self.total:  # at the beginning, and where the rows known of are all asked for
            total = announced(fetched(self.fetch, self.options | {"layer": self.layer, "hits": "true"}))
            if total is None:
                raise RuntimeError(f"the service doesn't say how many rows {self.layer} has")
            self.total = total
        # A batch costs the same whatever it holds: there are at most MOST_BATCHES or so, and a run that is killed loses at most one.
        pages = max(self.per, -(-self.total // (self.size * MOST_BATCHES)))
        end = {"row": max(start["row"], min(start["row"] + self.size * pages, self.total))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.layer, row, min(self.size, end["row"] - row)) for row in range(start["row"], end["row"], self.size)])


class PageRequestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_requests"

    def schema(self) -> str:
        return "layer string, start long, count long"

    def simpleStreamReader(self, schema: StructType) -> PageRequests:
        return PageRequests(self.options)


def answered(requests: DataFrame, path: str, tasks: int = 8, **options: str) -> DataFrame:
    """layer, start, count, body: the pages, fetched by ``tasks`` executors' tasks at a time. A page with fewer features than asked for is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            for layer, start, count in zip(*(b.column(c).to_pylist() for c in ("layer", "start", "count")), strict=True):
                body = fetched(path, options | {"layer": layer, "start": str(start), "count": str(count)})
                n = len(json.loads(body).get("features") or [])
                if n != count:
                    raise RuntimeError(f"{layer}: {n} of {count} features from {start} on")
                yield pa.RecordBatch.from_pydict({"layer": [layer], "start": [start], "count": [count], "body": [body]})

    return requests.repartition(tasks, "start").mapInArrow(run, "layer string, start long, count long, body string")


_FEATURES = f"features array<struct<properties: struct<{', '.join(f'{f}: string' for f in LOT_FIELDS)}>>>"


def lots(bodies: DataFrame) -> DataFrame:
    """sector, block, lot, complement, street, key, number, use, land_kind, situation, land, built, and start, the page. Lots without a street go; areas that aren't above zero are null."""
    p = bodies.select("start", F.posexplode(F.from_json("body", _FEATURES)["features"]).alias("place", "f")).select("start", "place", "f.properties.*")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))

    def area(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.when(value > 0, value)

    street = text("nm_logradouro_completo")
    return p.where(street != "").select(
        text("cd_setor_fiscal").alias("sector"), text("cd_quadra_fiscal").alias("block"), text("cd_lote").alias("lot"), text("tx_complemento_endereco").alias("complement"), street.alias("street"), street_key(street, 1).alias("key"),
        F.regexp_replace(text("cd_numero_porta"), r"\D", "").alias("number"), text("dc_tipo_uso_imovel").alias("use"), text("cd_tipo_terreno_imovel").alias("land_kind"), text("tx_situ_lote").alias("situation"),
        area("qt_area_terreno").alias("land"), area("qt_area_construida").alias("built"), "start", "place",
    )


def download(spark: SparkSession, target: str, path: str, layer: str, size: int = PAGE_ROWS, pages_per_batch: int = 32, tasks: int = 8, **options: str) -> int:
    """Fetches, by batches of ``pages_per_batch`` pages, more in a long download, all pages that no earlier run has into ``target``; the number of batches of this run. An error ends the run, and the next goes on behind its last batch."""
    spark.dataSource.register(PageRequestSource)
    source = spark.readStream.format("page_requests").options(fetcher=path, layer=layer, size=size, pagesPerBatch=pages_per_batch, **options).load()
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        lots(answered(batch, path, tasks, **options)).write.mode("overwrite").parquet(f"{target}/lots/batch={number}")
        done.append(number)

    query = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{target}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return len(done)


def downloaded(spark: SparkSession, target: str) -> DataFrame:
    """The lots so far: of each key the one that came last."""
    rows = spark.read.parquet(f"{target}/lots")
    last = Window.partitionBy(*LOT_KEY).orderBy(F.col("batch").desc(), F.col("start").desc(), F.col("place").desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "batch", "start", "place")
