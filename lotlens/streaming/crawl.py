"""State that follows a crawl page by page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upserts import seen

# Pages without news that stop a crawl; failures in a row that stop a run.
QUIET_PAGES, TRANSPORT_FAILURES, BLOCKED_FAILURES = 2, 5, 3


def stop_rule(pages: DataFrame, key: str, page: str, news: str, quiet: int = QUIET_PAGES, full: bool = False) -> DataFrame:
    """pages with streak (pages without news up to this one, itself included) and visited: no earlier page ended the crawl. Gaps and islands by window."""
    near = Window.partitionBy(key).orderBy(page)
    island = F.sum((F.col(news) > 0).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = pages.withColumn("__island", island)
    streak = F.when(F.col(news) > 0, 0).otherwise(F.sum((F.col(news) == 0).cast("int")).over(Window.partitionBy(key, "__island").orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = marked.withColumn("streak", streak.cast("int"))
    ended = F.coalesce(F.max((F.col("streak") >= quiet).cast("int")).over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return out.withColumn("visited", F.lit(True) if full else ~ended).drop("__island")


def _streaks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, limit: int) -> Iterator[pd.DataFrame]:
    streak, stopped = state.get if state.exists else (0, False)
    out = []
    for row in pd.concat(list(frames)).sort_values("page").itertuples():
        before = stopped
        streak = 0 if row.news > 0 else streak + 1
        stopped = stopped or streak >= limit
        out.append((key[0], row.page, streak, not before))
    state.update((streak, stopped))
    yield pd.DataFrame(out, columns=["key", "page", "streak", "visited"])


def stop_stream(pages: DataFrame, limit: int = QUIET_PAGES) -> DataFrame:
    """The same rule over a stream of key, page, news: state by key."""
    return pages.groupBy("key").applyInPandasWithState(
        lambda key, frames, state: _streaks(key, frames, state, limit), "key string, page long, streak int, visited boolean", "streak int, stopped boolean", "append", GroupStateTimeout.NoTimeout
    )


def breaker(results: DataFrame, key: str, order: str, failed: Column, limit: int = TRANSPORT_FAILURES) -> DataFrame:
    """Results with failures (in a row, up to this one) and tripped: this or an earlier one reached the limit."""
    rows = results.withColumn("__news", (~failed).cast("int"))
    out = stop_rule(rows, key, order, "__news", limit)
    return out.withColumn("tripped", ~F.col("visited") | (F.col("streak") >= limit)).withColumnRenamed("streak", "failures").drop("__news", "visited")


def registry(events: DataFrame, table: str, checkpoint: str, key: str = "url", ts: str = "ts"):
    """Keeps first and last sighting by key in a Parquet table: every batch is merged into a new version, and the version's name moves last, so a batch that is run again gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{table}/version={number - 1}"
        old = spark.read.parquet(before) if number > 0 else None
        seen(old, batch, key, ts).write.mode("overwrite").parquet(f"{table}/version={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_prices(known: DataFrame, batch: DataFrame, change: float = 1.0) -> DataFrame:
    """Rows of the batch whose price is new or moved by ``change`` or more."""
    near = (F.col("k.url") == F.col("b.url")) & (F.abs(F.col("k.price") - F.col("b.price")) < change)
    return batch.alias("b").join(known.alias("k"), near, "left_anti")


# Windows over events; additions of this library.

def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Watermarks need a timestamp with time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, length: str = "6 hours", step: str = "3 hours") -> DataFrame:
    return events.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)


def run_now(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now through the stream, as a table in memory: for queries of bounded results and tests."""
    spark = df.sparkSession
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
