"""A data source over paged JSON: one partition a page range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fetching import fetched, fetcher


class PageRange(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.fetch = dict(options), options.get("fetcher", "")
        fetcher(self.fetch)  # an unknown one fails here, not as pages without items
        self.area, self.size = options.get("area", ""), int(options.get("size", "36"))
        self.pages, self.per = int(options.get("pages", "1")), int(options.get("pagesPerPartition", "1"))

    def partitions(self) -> list[PageRange]:
        return [PageRange(a, min(a + self.per, self.pages + 1)) for a in range(1, self.pages + 1, self.per)]

    def read(self, part: PageRange) -> Iterator[tuple]:
        for page in range(part.first, part.last):
            yield (self.area, page, fetched(self.fetch, self.options | {"layer": self.area, "area": self.area, "start": str((page - 1) * self.size), "page": str(page), "count": str(self.size)}))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "area string, page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def paged(spark: SparkSession, **options: str) -> DataFrame:
    """area, page, body of pages 1 to ``pages``. fetcher: an import path; area, size, pagesPerPartition, and what the fetcher asks for."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(**options).load()


ITEM = "items array<struct<url: string, price: double, usable_area: double, total_area: double, unit_types: array<string>, street: string, number: string, zip: string, area_name: string, photos: array<string>>>"


def api_listings(bodies: DataFrame, flats: tuple[str, ...] = ("APARTMENT", "FLAT", "KITNET", "PENTHOUSE")) -> DataFrame:
    """Listings of the pages' items, without flats; bodies that aren't JSON give none."""
    items = bodies.select("area", "page", F.explode(F.from_json("body", ITEM)["items"]).alias("i")).select("area", "page", "i.*")
    flat = F.arrays_overlap(F.coalesce("unit_types", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in flats]))
    return items.where(~flat).drop("unit_types").withColumn("photos", F.array_distinct(F.coalesce("photos", F.array().cast("array<string>"))))
