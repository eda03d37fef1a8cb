"""Numbers, dates and formats of listings and registers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brazilian_number(text: Column) -> Column:
    """'R$ 1.234,56' as double; null where there is no number."""
    bare = F.regexp_replace(text, r"[^\d,.]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.(?=\d{3}(\D|$))", ""), ",", ".").try_cast("double")


def lenient_number(text: Column, default: float = 0.0) -> Column:
    """A number with a decimal comma, else the default."""
    return F.coalesce(F.regexp_replace(F.trim(text), ",", ".").try_cast("double"), F.lit(default))


def any_date(text: Column) -> Column:
    """yyyy-mm-dd or dd/mm/yyyy as yyyymmdd; null for anything else."""
    day = F.coalesce(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("dd/MM/yyyy")))
    return F.date_format(day, "yyyyMMdd")


def _dotted(value: Column, decimals: int = 0) -> Column:
    """1.234.567,8: points between thousands, a comma before decimals."""
    return F.translate(F.format_number(value, decimals), ",.", ".,")


def money(value: Column) -> Column:
    """'R$ 1.234.567'."""
    return F.concat(F.lit("R$ "), _dotted(value))


def price_text(price: Column) -> Column:
    return F.coalesce(money(price), F.lit("Preço a consultar"))


def short_money(value: Column) -> Column:
    """'R$ 1,71 mi', 'R$ 480 mil', 'R$ 95'; a dash where there is none."""
    bare = lambda x, n: F.translate(F.format_number(x, n), ".,", ",")
    millions, thousands = F.concat(F.lit("R$ "), bare(value / 1e6, 2), F.lit(" mi")), F.concat(F.lit("R$ "), bare(value / 1e3, 0), F.lit(" mil"))
    return F.when(value.isNull(), "—").when(value >= 1e6, millions).when(value >= 1e3, thousands).otherwise(F.concat(F.lit("R$ "), bare(value, 0)))


def area_text(value: Column) -> Column:
    return F.coalesce(F.concat(_dotted(value), F.lit(" m²")), F.lit("?"))


def number_text(value: Column) -> Column:
    """A whole number without decimals, others with one; '?' where there is none."""
    return F.when(value.isNull(), "?").when(value == F.floor(value), _dotted(value)).otherwise(_dotted(value, 1))


def register_text(number: Column) -> Column:
    """A register's number of 11 digits as 000.000.0000-0; others stay as they are, null is empty."""
    digits = F.regexp_replace(F.coalesce(number.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 11, F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})(\d)$", "$1.$2.$3-$4")).otherwise(F.coalesce(number.cast("string"), F.lit("")))


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.round(metres, 0).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.translate(F.format_number(metres / 1000, 1), ",.", ".,"), F.lit(" km")))


def walking_minutes(metres: Column, metres_a_minute: float = 80.0) -> Column:
    return F.greatest(F.ceil(metres / metres_a_minute), F.lit(1)).cast("int")


def folder_slug(url: Column) -> Column:
    """The last 60 characters of the address, marks as ``_``, and the beginning of its MD5."""
    bare = F.regexp_replace(url, r"[^a-zA-Z0-9]+", "_")
    return F.concat(F.substr(bare, F.greatest(F.length(bare) - 59, F.lit(1))), F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8))


def even_sample(items: Column, k: int) -> Column:
    """At most k items at even distances, the first and the last among them; ties of rounding go to the even place."""
    n = F.size(items)
    if k <= 1:
        return F.slice(items, 1, max(k, 0))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1)), 0).cast("int"))
    return F.when(n <= k, items).otherwise(F.transform(F.array_distinct(places), lambda i: F.get(items, i)))
