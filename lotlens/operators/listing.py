"""Filtered, ranked and paginated listings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import search_text
from ..functions.scores import fit_score
from ..storage import growing

# Rows a page, and days that a listing is new.
PAGE, NEW_DAYS = 60, 2


@dataclass
class Filters:
    """What a listing request asks for. Unset fields don't filter; areas that are asked for but unknown give no rows."""

    areas: list[str] = field(default_factory=list)
    price_max: float | None = None
    land_min: float | None = None
    rooms_min: int | None = None
    financing: bool | None = None
    floors: list[str] = field(default_factory=list)
    yard: bool = False
    trees: bool = False
    below_market: bool = False
    new_only: bool = False
    all_copies: bool = False

    @classmethod
    def from_request(cls, args: dict[str, list[str]]) -> Filters:
        """Numbers that aren't numbers don't filter."""

        def number(name: str) -> float | None:
            try:
                return float(args[name][0].replace(",", "."))
            except (KeyError, IndexError, ValueError):
                return None

        flag = lambda name: bool(args.get(name))
        asked = (args.get("financing") or [""])[0]
        rooms = number("rooms_min")
        return cls(
            args.get("area", []), number("price_max"), number("land_min"), None if rooms is None else int(rooms), {"yes": True, "no": False}.get(asked),
            args.get("floor", []), flag("yard"), flag("trees"), flag("below_market"), flag("new"), flag("all"),
        )

    def resolved(self, listings: DataFrame) -> list[str]:
        """The table's area names that have the key of an asked name: a name a neighbourhood, so a bounded list."""
        keys = F.array(*[search_text(F.lit(a)) for a in self.areas])
        names = listings.select("area_name").distinct().where(F.array_contains(keys, search_text(F.col("area_name"))))
        return sorted(r["area_name"] for r in names.collect())

    def predicates(self, areas: list[str] = ()) -> list[Column]:
        """areas: what the asked names are ``resolved`` to. Plain comparisons, which scans take over."""
        c = F.col
        out = [c("removed_at").isNull()]
        if self.areas:
            out.append(c("area_name").isin(list(areas)) if areas else F.lit(False))
        if self.price_max is not None:
            out.append(c("price") <= self.price_max)
        if self.land_min is not None:
            out.append(c("land") >= self.land_min)
        if self.rooms_min is not None:
            out.append(c("rooms") >= self.rooms_min)
        if self.financing is not None:
            out.append(c("financing") if self.financing else c("financing").isNull() | ~c("financing"))
        if self.floors:
            out.append(reduce(lambda a, b: a | b, [c("has_dirt") if f == "terra" else c("floor") == f for f in self.floors]))
        if self.yard:
            out.append(c("yard"))
        if self.trees:
            out.append(c("trees"))
        if self.below_market:
            out.append(c("ratio") < 1)
        if self.new_only:
            out.append(c("is_new"))
        if not self.all_copies:
            out.append(c("dup_group").isNull() | c("dup_best"))
        return out

    def apply(self, listings: DataFrame) -> DataFrame:
        return reduce(lambda df, p: df.where(p), self.predicates(self.resolved(listings) if self.areas else []), listings)


def with_comparisons(listings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Listings with ratio, confidence and score; null where there is no comparison."""
    joined = listings.join(growing(comparisons.select("url", "ratio", "confidence")), "url", "left")
    return joined.withColumn("score", fit_score(F.col("ratio"), F.col("upkeep"), F.col("has_problem"), F.col("confidence")))


def newly_seen(first_seen: DataFrame, today: Column, days: int = NEW_DAYS) -> DataFrame:
    """url, first_seen, is_new: seen first in the last ``days`` days, today included, and not on the table's first day."""
    start = first_seen.agg(F.min(F.to_date("first_seen")).alias("start"))
    new = (F.to_date("first_seen") > F.col("start")) & (F.to_date("first_seen") >= F.date_sub(today, days - 1))
    return first_seen.crossJoin(F.broadcast(start)).select("url", "first_seen", F.coalesce(new, F.lit(False)).alias("is_new"))  # one row


def order(by: str = "fit") -> list[Column]:
    """The columns to sort by; every order ends with the order of arrival, so it is total."""
    cheap = F.coalesce(F.nullif(F.col("price"), F.lit(0.0)), F.lit(9e12))
    best_first = F.coalesce(F.col("dup_best").cast("int"), F.lit(0)).desc()
    orders = {
        "fit": [F.col("score").desc_nulls_last(), cheap],
        "price_asc": [cheap, best_first],
        "price_desc": [F.col("price").desc_nulls_last(), best_first],
        "land": [F.col("land").desc_nulls_last(), best_first],
        "recent": [F.col("ingest_seq").desc()],
        "below": [F.col("ratio").asc_nulls_last(), F.col("text_score").desc_nulls_last(), cheap],
        "text": [F.col("text_score").desc_nulls_last(), cheap],
    }
    return [*orders[by], F.col("ingest_seq")]


def page(listings: DataFrame, by: str = "fit", number: int = 1, size: int = PAGE, total: int | None = None) -> DataFrame:
    """One page of the sorted rows. With the ``total`` of rows the number is kept between 1 and the last page."""
    if total is not None:
        number = max(1, min(number, -(-total // size) or 1))
    return listings.orderBy(*order(by)).offset((number - 1) * size).limit(size)


def counted_page(listings: DataFrame, by: str = "fit", number: int = 1, size: int = PAGE) -> tuple[DataFrame, int]:
    """The page and the number of all rows; a page beyond the last is the last one."""
    total = listings.count()
    return page(listings, by, number, size, total), total


def coverage(listings: DataFrame, filters: Filters) -> DataFrame:
    """Rows, and rows with a vision analysis, under the filters without those that need one."""
    plain = Filters(**{**filters.__dict__, "floors": [], "trees": False})
    return plain.apply(listings).agg(F.count("*").alias("total"), F.count("upkeep").alias("analysed"))


def accepted_pages(rows: DataFrame, page: str, inside: Column, share: float = 0.5) -> DataFrame:
    """page, n, share, accepted: a page counts if enough of its listings are inside of what it was asked for."""
    found = F.avg(inside.cast("int"))
    return rows.groupBy(page).agg(F.count("*").alias("n"), found.alias("share"), (found >= share).alias("accepted"))
