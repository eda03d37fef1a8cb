"""Pages that a browser has saved: a stream over a landing folder, routed by what a page holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import canonical_url, fallback_title
from ..sources import pages as pg

# Fixed value: what a portal's listing has in its own page; cards mark a page of listings.
DETAIL_MARK = pg.DETAIL_TEXT
SCHEMA = "url string, html string, saved_at timestamp"


def routed(pages: DataFrame) -> DataFrame:
    """Pages with kind: 'detail', 'listing', 'fallback' (listings of the whole country), or 'other', also for pages without text."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    kind = pg.page_kind(html, DETAIL_MARK, pg.CARD_MARK)
    return pages.withColumn("kind", F.when((kind == "listing") & fallback_title(title), "fallback").otherwise(kind))


def capture(spark: SparkSession, landing: str, target: str, site: str = "", files_a_batch: int = 1000) -> None:
    """Reads the landing folder's new files (JSON lines: url, html, saved_at) once each, and adds to details, cards and left below ``target``.

    A batch writes to the folders of its number, so that one that is run again after a failure replaces its own rows. Of pages
    of one address in a batch the last saved counts. A line that isn't JSON is left as a page without text.
    """
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(landing)

    def keep(batch: DataFrame, number: int) -> None:
        known = batch.withColumn("__at", canonical_url(F.col("url"))).groupBy(F.coalesce("__at", F.monotonically_increasing_id().cast("string")).alias("__at")).agg(F.max_by(F.struct("url", "html", "saved_at"), F.struct(F.col("saved_at").isNotNull(), "saved_at", F.length("html"))).alias("p")).select("p.*")
        kinds = routed(known).persist()
        try:
            of = lambda kind: kinds.where(F.col("kind") == kind).drop("kind")
            pg.detail_pages(of("detail")).write.mode("overwrite").parquet(f"{target}/details/batch={number}")
            pg.listing_cards(of("listing").withColumnRenamed("url", "page"), site=site).write.mode("overwrite").parquet(f"{target}/cards/batch={number}")
            kinds.where(F.col("kind").isin("fallback", "other")).select("url", "kind", "saved_at").write.mode("overwrite").parquet(f"{target}/left/batch={number}")
        finally:
            kinds.unpersist()

    query = pages.writeStream.foreachBatch(keep).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
