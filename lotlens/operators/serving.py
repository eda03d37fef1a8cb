"""What a site is served from, and the upkeep of stored tables: marts, marks, purges, lookups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Stored tables.

def replace_table(df: DataFrame, path: str) -> None:
    """The table's new content. The old files go first: readers that must see one of both read from a folder of its own for each version, as ``publish`` gets one."""
    df.write.mode("overwrite").parquet(path)


def publish(marts: dict[str, DataFrame], folder: str) -> None:
    """The tables that a site needs, each with only its columns, as files of their own."""
    for name, df in marts.items():
        replace_table(df, f"{folder}/{name}")


def published(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}") for name in names]


def purged(rows: DataFrame, gone: Column, details: DataFrame | None = None, key: str = "url") -> tuple[DataFrame, DataFrame | None]:
    """The rows that don't meet the predicate, for which null is no, and the details of no purged row."""
    kept = rows.where(~F.coalesce(gone, F.lit(False)))
    return kept, None if details is None else details.join(rows.where(gone).select(key), key, "left_anti")


def marked(listings: DataFrame, members: DataFrame) -> DataFrame:
    """All listings with the marks of their group: dup_group, dup_count, dup_best, dup_photos (of the principal), dup_low and dup_detail, null outside
    of groups. Marks of an earlier run go. members: group, url, price, photos, portal. The principal has most photos, then the lowest price, then
    the smallest url; the detail lists the whole group from the cheapest on (copies of one listing: bounded)."""
    rank = F.struct(-F.col("photos"), F.col("price").isNull(), F.col("price"), F.col("url"))
    entry = F.struct(F.col("price").isNull().alias("unknown"), "price", "url", "portal", "photos")
    groups = members.groupBy("group").agg(
        F.count("*").alias("dup_count"), F.min_by("url", rank).alias("principal"), F.max("photos").alias("dup_photos"), F.min("price").alias("dup_low"),
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("unknown"))).alias("dup_detail"),
    )
    marks = members.select("url", "group").join(groups, "group").select("url", F.col("group").alias("dup_group"), "dup_count", (F.col("url") == F.col("principal")).alias("dup_best"), "dup_photos", "dup_low", "dup_detail")
    return listings.drop("dup_group", "dup_count", "dup_best", "dup_photos", "dup_low", "dup_detail").join(marks, "url", "left")


# Lookups.

def pending_analysis(listings: DataFrame, failed: bool = False) -> DataFrame:
    """Active listings whose photos have no analysis, and with ``failed`` those whose analysis failed."""
    todo = F.col("photo_ok").isNull()
    return listings.where(F.col("removed_at").isNull() & ((todo | (F.col("photo_ok") == 0)) if failed else todo))


def pending_details(listings: DataFrame, without_land: bool = True, portal: str | None = None) -> DataFrame:
    """Active listings whose own page wasn't read."""
    out = listings.where(F.col("removed_at").isNull() & (F.coalesce("detail_ok", F.lit(0)) == 0))
    if without_land:
        out = out.where(F.col("land").isNull())
    return out if portal is None else out.where(F.col("portal") == portal)


def stored_already(asked: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """The asked rows whose address is stored as it is, or with other parameters behind it: a semi-join on two keys, where an index would scan a range."""
    base = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    listed = stored.select(F.explode(F.array(F.col(url), F.when(F.contains(url, F.lit("?")), F.concat(F.substring_index(url, "?", 1), F.lit("?"))))).alias("__key"))
    wanted = asked.withColumn("__key", F.explode(F.array(F.col(url), F.concat(base, F.lit("?")))))
    return wanted.join(listed, "__key", "left_semi").drop("__key").dropDuplicates([url])


def of_page(page: DataFrame, *details: DataFrame, key: str = "url") -> list[DataFrame]:
    """The rows of each detail table for the listings of one page: a semi-join, which Spark broadcasts where the keys are as few as a page's are."""
    keys = page.select(key).distinct()
    return [d.join(keys, key, "left_semi") for d in details]


def sampled(rows: DataFrame, key: str, n: int = 5, seed: str = "audit") -> DataFrame:
    """n rows by a hash of seed and key: random, and the same for each run."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(n)


# Reports.

def reuse_plan(listings: DataFrame, done: Column, pending: Column) -> DataFrame:
    """One row: groups, complete, mixed and empty ones, pending listings, those that inherit from their group, those without a group, and what still needs an analysis."""
    grouped = listings.where("dup_group is not null").groupBy("dup_group").agg(F.count_if(done).alias("ok"), F.count_if(pending).alias("todo"))
    groups = grouped.agg(
        F.count("*").alias("groups"), F.count_if((F.col("ok") > 0) & (F.col("todo") > 0)).alias("mixed"), F.count_if((F.col("ok") == 0) & (F.col("todo") > 0)).alias("empty"), F.coalesce(F.sum(F.when(F.col("ok") > 0, F.col("todo"))), F.lit(0)).alias("inherit"),
    )
    rows = listings.agg(F.count_if(pending).alias("pending"), F.count_if(pending & F.col("dup_group").isNull()).alias("alone"))
    return groups.crossJoin(F.broadcast(rows)).select("groups", (F.col("groups") - F.col("mixed") - F.col("empty")).alias("complete"), "mixed", "empty", "pending", "inherit", "alone", (F.col("empty") + F.col("alone")).alias("needed"))  # one row each


def best_members(listings: DataFrame, done: Column, pending: Column) -> DataFrame:
    """dup_group, url: of each group without an analysis the pending member with most photos, the smallest url of equal ones."""
    without = listings.where("dup_group is not null").groupBy("dup_group").agg(F.count_if(done).alias("ok"), F.min_by("url", F.when(pending, F.struct(-F.col("photos"), F.col("url")))).alias("url"), F.count_if(pending).alias("todo"))
    return without.where("ok = 0 and todo > 0").select("dup_group", "url")


def numbered_groups(members: DataFrame) -> DataFrame:
    """Members with the number of their group (largest groups first, then by name of area and group) and its count. members: group, url, area_name."""
    groups = members.groupBy("group").agg(F.count("*").alias("count"), F.min("area_name").alias("__area"))
    numbered = groups.withColumn("number", F.row_number().over(Window.orderBy(F.desc("count"), F.coalesce("__area", F.lit("")), "group")))  # a row a group of a printed report
    return members.join(numbered.drop("__area"), "group")


def write_groups(members: DataFrame, path: str) -> None:
    """number, count, price, title, area_name, street, url as CSV with a header."""
    numbered_groups(members).select("number", "count", "price", "title", "area_name", "street", "url").write.mode("overwrite").option("header", True).csv(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """number, url of the groups with several members of a written file; rows without an address don't count."""
    rows = spark.read.option("header", True).csv(path).where("url is not null and url <> ''").select(F.coalesce("number", F.lit("?")).alias("number"), "url")
    several = rows.groupBy("number").count().where("count > 1").select("number")
    return rows.join(several, "number", "left_semi")


def group_report(members: DataFrame) -> DataFrame:
    """number, place, line: the text of a report, a head line and a line for each member from the cheapest on."""
    rows = numbered_groups(members)
    whole = lambda x: F.format_number(x, 0)
    head = rows.groupBy("number").agg(F.max("count").alias("n"), F.min_by("area_name", "url").alias("area"), F.min("price").alias("low"), F.max("price").alias("high"))
    heads = head.select("number", F.lit(0).alias("place"), F.concat(F.lit("GROUP "), "number", F.lit(" - "), "n", F.lit(" listings | "), F.coalesce("area", F.lit("?")), F.coalesce(F.concat(F.lit(" | R$ "), whole("low"), F.lit(" to R$ "), whole("high")), F.lit(""))).alias("line"))
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.coalesce("price", F.lit(0.0)), "url"))
    lines = rows.select("number", place.alias("place"), F.concat(F.lit("R$ "), F.coalesce(whole("price"), F.lit("?")), F.lit(" | "), F.coalesce("title", F.lit("")), F.lit(" | "), F.col("url").cast("string")).alias("line"))
    return heads.unionByName(lines)
