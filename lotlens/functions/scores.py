"""Scores and statutory formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the fit score.
WEIGHT_DISCOUNT, WEIGHT_UPKEEP, PROBLEM_PENALTY, DISCOUNT_CAP = 0.5, 0.5, 0.15, 0.5
CONFIDENCE_WEIGHTS = {"alta": 1.0, "media": 0.8, "baixa": 0.5}
# Factors of the law by type of lot, and of the reference value by number of corners.
LOT_TYPE_FACTORS = {"Lote de fundos": 0.60, "Lote encravado": 0.50, "Terreno interno": 0.70}
REFERENCE_FACTORS = {0: 1.157, 1: 1.256, 2: 1.045}
# Area differences in percent.
AREA_OK, AREA_ATTENTION = 15.0, 30.0
# US dollars a million tokens, at off-peak hours; peak hours cost twice as much.
INPUT_USD, OUTPUT_USD = 0.15, 0.60


def _lookup(key: Column, table: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def fit_score(ratio: Column, upkeep: Column, has_problem: Column, confidence: Column | None = None) -> Column:
    """Null without price ratio or upkeep; never below 0; rounded to four places."""
    weight = F.lit(1.0) if confidence is None else _lookup(confidence, CONFIDENCE_WEIGHTS, 1.0)
    discount = F.least(F.lit(DISCOUNT_CAP), F.greatest(F.lit(0.0), 1.0 - ratio)) * weight
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (upkeep - 1.0) / 4.0))
    raw = WEIGHT_DISCOUNT * discount / DISCOUNT_CAP + WEIGHT_UPKEEP * kept - F.when(has_problem, PROBLEM_PENALTY).otherwise(0.0)
    return F.when(ratio.isNotNull() & upkeep.isNotNull(), F.round(F.greatest(F.lit(0.0), raw), 4))


#: The same formula for ``CREATE TEMPORARY FUNCTION``, which Catalyst inlines.
FIT_SCORE_SQL = f"""CREATE OR REPLACE TEMPORARY FUNCTION fit_score(ratio DOUBLE, upkeep DOUBLE, has_problem BOOLEAN, confidence STRING) RETURNS DOUBLE
RETURN CASE WHEN ratio IS NULL OR upkeep IS NULL THEN NULL ELSE round(greatest(0.0D,
 {WEIGHT_DISCOUNT}D * least({DISCOUNT_CAP}D, greatest(0.0D, 1.0D - ratio)) * CASE confidence WHEN 'alta' THEN 1.0D WHEN 'media' THEN 0.8D WHEN 'baixa' THEN 0.5D ELSE 1.0D END / {DISCOUNT_CAP}D
 + {WEIGHT_UPKEEP}D * least(1.0D, greatest(0.0D, (upkeep - 1.0D) / 4.0D)) - CASE WHEN has_problem THEN {PROBLEM_PENALTY}D ELSE 0.0D END), 4) END"""


def near_area(listed: Column, official: Column) -> Column:
    return F.coalesce((official > 0) & (F.abs(listed - official) / official <= AREA_OK / 100), F.lit(False))


def area_match(listed: Column, built: Column, land: Column) -> Column:
    """Which registered area the listed number is: ambos, construcao, terreno, nenhum, sem dado."""
    b, t = near_area(listed, built), near_area(listed, land)
    return F.when(listed.isNull() | (listed == 0), "sem dado").when(b & t, "ambos").when(b, "construcao").when(t, "terreno").otherwise("nenhum")


def area_difference(listed: Column, built: Column, land: Column) -> Column:
    """Percent against the area that matches, else against the built one; 0 where both match."""
    match = area_match(listed, built, land)
    against = F.when(match == "terreno", land).otherwise(F.when(built > 0, built))
    return F.when(match == "ambos", 0.0).when(match != "sem dado", 100 * (F.try_divide(listed, against) - 1))


def grade(difference: Column) -> Column:
    size = F.abs(difference)
    return F.when(size.isNull(), "sem dado").when(size <= AREA_OK, "compativel").when(size <= AREA_ATTENTION, "atencao").otherwise("divergente")


def depth_factor(land: Column, frontage: Column, corners: Column) -> Column:
    depth = F.greatest(F.lit(10.0), F.least(F.lit(200.0), F.floor(F.try_divide(land, frontage)).cast("double")))
    table = F.when(depth < 20, F.sqrt(depth / 20)).when(depth <= 40, 1.0).otherwise(F.sqrt(40 / depth))
    usable = (F.coalesce(corners, F.lit(0)) < 2) & (frontage > 0) & (land > 0)
    return F.when(usable, table).otherwise(1.0)


def statutory_land_value(land: Column, per_m2: Column, frontage: Column, corners: Column, lot_type: Column, share: Column) -> Column:
    return land * per_m2 * depth_factor(land, frontage, corners) * _lookup(lot_type, LOT_TYPE_FACTORS, 1.0) * F.coalesce(F.nullif(share, F.lit(0.0)), F.lit(1.0))


def statutory_building_value(built: Column, per_m2: Column, obsolescence: Column) -> Column:
    return built * per_m2 * F.coalesce(F.nullif(obsolescence, F.lit(0.0)), F.lit(1.0))


def reference_value(assessed: Column, corners: Column) -> Column:
    return assessed * _lookup(corners, REFERENCE_FACTORS, 1.0)


def peak(ts: Column) -> Column:
    """1 to 4 and 6 to 10 o'clock UTC from Monday to Friday."""
    return (F.weekday(ts) < 5) & (F.hour(ts).between(1, 3) | F.hour(ts).between(6, 9))


def token_cost(ts: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * INPUT_USD + tokens_out * OUTPUT_USD) / 1e6 * F.when(peak(ts), 2.0).otherwise(1.0)


def confidence_class(financed_pass: Column, n: Column, numbers: Column, street_level: Column) -> Column:
    top = financed_pass & (n >= 5) & (numbers >= 4) & street_level
    middle = financed_pass | ((n >= 8) & (numbers >= 5) & street_level)
    return F.when(top, "alta").when(middle, "media").otherwise("baixa")
