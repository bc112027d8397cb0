"""Ratios, scores, tiers, segments and prediction post-processing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline import constants as K


def step_label(c: Column, cuts: list[tuple[float | None, str]]) -> Column:
    """Label of the first cut the value is below; the open cut takes the rest. Null stays null."""
    chain = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in cuts:
        chain = chain.otherwise(F.lit(label)) if bound is None else chain.when(c < bound, F.lit(label))
    return chain


def _step_points(c: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first threshold exceeded, 0 for none or null."""
    chain = None
    for bound, points in steps:
        chain = F.when(c > bound, points) if chain is None else chain.when(c > bound, points)
    return chain.otherwise(0)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null on a zero or null divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def batch_ratios(price: Column, living: Column, land: Column, rooms: Column, baths: Column) -> dict[str, Column]:
    total = _zero(living) + _zero(land)
    return {
        "price_per_sqm": ratio(price, living),
        "total_area": total,
        "living_to_land_ratio": ratio(living, land),
        "avg_room_size": ratio(living, rooms),
        "bathroom_room_ratio": ratio(baths, rooms),
        "area_per_room": ratio(total, rooms),
        "price_per_room": ratio(price, rooms),
    }


def serve_ratios(price: Column, living: Column, land: Column, rooms: Column, baths: Column) -> dict[str, Column]:
    """Null-free variant: inputs are already defaulted to 0."""
    one = F.lit(1.0)
    return {
        "price_per_sqm": F.when((living > 0) & (price > 0), price / F.greatest(living, one)).otherwise(0.0),
        "total_area": living + land,
        "living_to_land_ratio": F.when(land > 0, living / F.greatest(land, one)).otherwise(living),
        "avg_room_size": F.when(rooms > 0, living / F.greatest(rooms, F.lit(1))).otherwise(living),
        "bathroom_room_ratio": F.when(rooms > 0, baths / F.greatest(rooms, F.lit(1))).otherwise(0.0),
    }


def room_area(rooms: Column, land: Column) -> Column:
    return _zero(rooms) * _zero(land)


def property_score(living: Column, luxury: Column, city: Column, coast: Column, room_size: Column) -> Column:
    points = (
        _step_points(living, [(200, 3), (100, 2), (50, 1)])
        + F.least(_zero(luxury), F.lit(5))
        + F.when(city == 1, 2).otherwise(0)
        + F.when(coast == 1, 1).otherwise(0)
        + _step_points(room_size, [(25, 2), (15, 1)])
    )
    return F.least(points, F.lit(15))


def tier_by_score(score: Column, luxury: Column) -> Column:
    return (
        F.when((score >= 12) | (luxury >= 4), "Premium")
        .when((score >= 8) | (luxury >= 2), "Standard")
        .when(score >= 5, "Basic")
        .otherwise("Economy")
    )


def tier_by_area(living: Column) -> Column:
    return step_label(_zero(living), K.SERVE_TIER_CUTS)


def market_segment(price: Column, preset: str = "batch") -> Column:
    """Batch: by price. Serve: wider cuts, and no price means Mid-Market."""
    if preset == "serve":
        return F.when(_zero(price) > 0, step_label(price, K.SEGMENT_CUTS["serve"])).otherwise("Mid-Market")
    return step_label(_zero(price), K.SEGMENT_CUTS["batch"])


def investment_score(city: Column, coast: Column, tier: Column, price_per_sqm: Column) -> Column:
    points = (
        F.when(city == 1, 3).otherwise(0)
        + F.when(coast == 1, 2).otherwise(0)
        + F.when(tier == "Premium", 3).when(tier == "Standard", 2).when(tier == "Basic", 1).otherwise(0)
        + F.when((price_per_sqm > 0) & (price_per_sqm < 2000), 2)
        .when((price_per_sqm >= 2000) & (price_per_sqm < 3000), 1)
        .otherwise(0)
    )
    return F.least(points, F.lit(10))


def indicators(c: Column, values: list[str], prefix: str, slug: bool = True) -> dict[str, Column]:
    """0/1 column per value; names are lower-cased with underscores unless ``slug`` is off."""
    name = (lambda v: v.lower().replace(" ", "_")) if slug else (lambda v: v)
    return {f"{prefix}{name(v)}": F.coalesce(c == v, F.lit(False)).cast("int") for v in values}


def completeness_confidence(features: list[Column]) -> Column:
    """Share of non-zero features, held between 0.6 and 0.95."""
    filled = sum((F.coalesce(f != 0, F.lit(False)).cast("int") for f in features), F.lit(0))
    return F.least(F.lit(0.95), F.greatest(F.lit(0.6), filled / len(features)))


def prediction_result(raw: Column, confidence: Column, currency: Column, factors: Column) -> Column:
    """Floored prediction with a 15 % range, the factors and a status."""
    price = F.greatest(F.lit(50_000.0), raw)
    confident = confidence > 0.7
    return F.struct(
        price.cast("bigint").alias("predicted_price"),
        confidence.alias("confidence"),
        F.struct(
            F.greatest(F.lit(0), (price - price * 0.15).cast("bigint")).alias("min"),
            (price + price * 0.15).cast("bigint").alias("max"),
        ).alias("price_range"),
        F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit("Basic property features"))).alias("factors"),
        F.coalesce(currency, F.lit("TND")).alias("currency"),
        F.struct(
            F.when(confident, "market_average").otherwise("uncertain").alias("status"),
            F.when(confident, "AI-based prediction").otherwise("Prediction with limited data").alias("recommendation"),
        ).alias("market_analysis"),
    )


def prediction_factors(living: Column, rooms: Column, luxury: Column, city: Column, pool: Column, coast: Column) -> Column:
    return F.array_compact(F.array(
        F.when(living > 0, F.concat(F.lit("Living area: "), living.cast("string"), F.lit(" m²"))),
        F.when(rooms > 0, F.concat(F.lit("Rooms: "), rooms.cast("string"))),
        F.when(luxury == 1, F.lit("Luxury features")),
        F.when(city == 1, F.lit("Major city location")),
        F.when(pool == 1, F.lit("Swimming pool")),
        F.when(coast == 1, F.lit("Coastal location")),
    ))


def fallback_prediction(listed: Column, currency: Column) -> Column:
    """Without a model: 95 % of the listed price ±10 %, or a fixed middle price."""
    has_price = F.coalesce(listed > 0, F.lit(False))
    price = F.when(has_price, (listed * 0.95).cast("bigint")).otherwise(450_000)
    return F.struct(
        price.alias("predicted_price"),
        F.lit(0.65).alias("confidence"),
        F.struct(
            F.when(has_price, (price * 0.9).cast("bigint")).otherwise(400_000).alias("min"),
            F.when(has_price, (price * 1.1).cast("bigint")).otherwise(500_000).alias("max"),
        ).alias("price_range"),
        F.array(F.lit("Model unavailable - using fallback prediction")).alias("factors"),
        F.coalesce(currency, F.lit("TND")).alias("currency"),
    )


def price_gap(predicted: Column, listed: Column) -> Column:
    """Difference in % of the listed price, and its wording."""
    diff = predicted - listed
    pct = F.round(F.try_divide(diff * 100.0, listed), 1)
    shown = F.format_string("%.1f", F.abs(pct))
    return F.struct(
        pct.alias("gap_pct"),
        F.when(diff > 0, F.concat(F.lit("+"), shown, F.lit("% above market")))
        .when(diff < 0, F.concat(shown, F.lit("% below market")))
        .when(diff == 0, F.lit("At market value"))
        .alias("gap_text"),
    )


def mape_grade(mape: Column) -> Column:
    return step_label(mape, K.MAPE_GRADES)


def r2_grade(r2: Column) -> Column:
    """Grades compare downward, so the cuts are tested with 'greater than'."""
    chain = F.when(r2.isNull(), F.lit(None).cast("string"))
    for bound, label in K.R2_GRADES:
        chain = chain.otherwise(label) if bound is None else chain.when(r2 > bound, label)
    return chain


def overfit_flag(train_r2: Column, test_r2: Column, gap: float = 0.1) -> Column:
    return (train_r2 - test_r2) > gap


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def abs_pct_error(actual: Column, predicted: Column) -> Column:
    return F.abs(F.try_divide(actual - predicted, actual))
