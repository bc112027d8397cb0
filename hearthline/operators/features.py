"""Feature sets: the batch set for training tables and the fixed serving set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline import constants as K
from hearthline.functions import numbers, place, scores, text
from hearthline.operators.columns import align_features
from hearthline.operators.profile import top_values


def size_features(df: DataFrame) -> DataFrame:
    return df.withColumns(scores.batch_ratios(
        *[F.col(c) for c in ("price", "living_area", "land_area", "room_count", "bathroom_count")]))


def location_features(df: DataFrame, major: list[str] = K.MAJOR_CITIES_BATCH, coastal: list[str] = K.COASTAL_BATCH,
                      rules: dict[str, str] = K.GOVERNORATE_RULES) -> DataFrame:
    clean = df.withColumn("governorate_clean", place.standard_governorate(F.col("governorate"), rules))
    return clean.withColumns({
        "is_major_city": place.in_list_flag(F.col("governorate_clean"), major),
        "is_coastal": place.in_list_flag(F.col("governorate_clean"), coastal),
    })


def indicator_features(df: DataFrame, c: str, prefix: str, n: int | None = None, values: list[str] | None = None) -> DataFrame:
    """0/1 columns for the n most frequent values, or for given values (as fitted on training rows)."""
    return df.withColumns(scores.indicators(F.col(c), values if values is not None else top_values(df, c, n), prefix))


def text_features(df: DataFrame, description: str = "description", amenities: dict[str, list[str]] = K.AMENITY_KEYWORDS,
                  conditions: dict[str, list[str]] = K.CONDITION_KEYWORDS) -> DataFrame:
    """Length, word, keyword and condition features of the repaired description."""
    fixed = df.withColumn("description_clean", text.fix_description(F.col(description)))
    clean = fixed.withColumn("__clean", text.clean_text(F.col("description_clean")))
    body, collapsed = F.col("description_clean"), F.col("__clean")
    flags = text.keyword_flags(body, amenities, "has_")
    flagged = clean.withColumns({
        "description_length": F.length(body),
        "description_word_count": text.word_count(collapsed),
        "avg_word_length": text.avg_word_length(collapsed),
        "punctuation_density": text.punctuation_density(body),
        **flags,
        **text.keyword_flags(body, conditions, "is_"),
    })
    return flagged.withColumn("luxury_score", sum((F.col(c) for c in flags), F.lit(0))).drop("__clean")


def market_features(df: DataFrame) -> DataFrame:
    """Scores, tier, segment and investment potential; needs size, location and luxury columns."""
    scored = df.withColumn("ai_property_score", scores.property_score(
        F.col("living_area"), F.col("luxury_score"), F.col("is_major_city"), F.col("is_coastal"), F.col("avg_room_size")))
    tiered = scored.withColumns({
        "property_tier": scores.tier_by_score(F.col("ai_property_score"), F.col("luxury_score")),
        "market_segment": scores.market_segment(F.col("price")),
    })
    invested = tiered.withColumn("investment_potential", scores.investment_score(
        F.col("is_major_city"), F.col("is_coastal"), F.col("property_tier"), F.col("price_per_sqm")))
    return invested.withColumns({
        **scores.indicators(F.col("property_tier"), K.TIERS, "property_tier_", slug=False),
        **scores.indicators(F.col("market_segment"), K.SEGMENTS, "market_segment_", slug=False),
    })


def batch_features(df: DataFrame, n_types: int = 10, n_governorates: int = 8, **location) -> DataFrame:
    """The whole batch feature set of a cleaned listing table with a text description.

    When the text features are there already (computed where the texts live, before a join spreads
    copies of them), they are used as they are.
    """
    located = location_features(size_features(df), **location)
    out = market_features(located if "luxury_score" in df.columns else text_features(located))
    out = indicator_features(out, "property_type", "is_", n_types)
    return indicator_features(out, "governorate_clean", "gov_", n_governorates)


LEAKY = ["price_per_sqm", "price_per_room", "investment_potential", "market_segment_"]


def model_columns(df: DataFrame, include_leaky: bool = False) -> list[str]:
    """Numeric and 0/1 feature columns for modelling; price-derived ones only on request."""
    numeric = [
        "living_area", "land_area", "room_count", "bathroom_count", "price_per_sqm", "total_area",
        "living_to_land_ratio", "avg_room_size", "bathroom_room_ratio", "description_length",
        "description_word_count", "avg_word_length", "punctuation_density", "luxury_score",
        "ai_property_score", "investment_potential",
    ]
    prefixes = ("has_", "is_", "gov_", "property_tier_", "market_segment_")
    found = [c for c in numeric if c in df.columns] + [c for c in df.columns if c.startswith(prefixes)]
    return found if include_leaky else [c for c in found if not c.startswith(tuple(LEAKY))]


def serving_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The fixed serving features, in order, from raw listing columns; absent columns count as empty."""
    have = set(df.columns)
    get = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    description = get("description", "array<string>")
    words = F.lower(F.coalesce(F.array_join(description, " "), F.lit("")))
    governorate = F.lower(F.coalesce(get("governorate"), F.lit("")))
    delegation = F.lower(F.coalesce(get("delegation"), F.lit("")))
    kind = F.lower(F.coalesce(get("property_type"), F.lit("")))
    stored = lambda c: get(c).try_cast("boolean") if c else None
    base = df.withColumns({
        "__text": words, "__living": numbers.safe_float(get("living_area")), "__land": numbers.safe_float(get("land_area")),
        "__rooms": numbers.safe_int(get("room_count")), "__baths": numbers.safe_int(get("bathroom_count")),
        "__price": numbers.safe_float(get("price")),
    }).withColumn("__clean", text.clean_text(F.col("__text")))
    amenities, conditions = ([k for kws in groups for k in kws] for groups in ((kws for _, kws in K.SERVE_AMENITY_FLAGS.values()), K.SERVE_CONDITION_FLAGS.values()))
    lists = {"luxury": K.LUXURY_WORDS, "positive": K.POSITIVE_WORDS, "investment": K.INVESTMENT_WORDS, "amenities": amenities, "conditions": conditions}
    base = base.withColumns({f"__{n}": text.found_keywords(F.col("__text"), kws) for n, kws in lists.items()})
    clean = F.col("__clean")
    flag = lambda n, kws: F.arrays_overlap(F.col(f"__{n}"), F.array(*map(F.lit, kws)))
    yes = lambda s: F.coalesce(s, F.lit(False)) if s is not None else F.lit(False)
    body, living, land, rooms, baths, price = (F.col(f"__{c}") for c in ("text", "living", "land", "rooms", "baths", "price"))
    has = lambda c, part: F.contains(c, F.lit(part)).cast("int")
    features = {
        "living_area": living, "land_area": land, "room_count": rooms, "bathroom_count": baths,
        **scores.serve_ratios(price, living, land, rooms, baths),
        "description_length": F.length(body), "description_word_count": text.word_count(clean),
        "avg_word_length": text.avg_word_length(clean), "punctuation_density": text.punctuation_density(body),
        "luxury_score": F.size("__luxury"),
        "ai_property_score": F.size("__positive"),
        "investment_potential": F.size("__investment"),
        **{c: (flag("amenities", kws) | yes(stored(s))).cast("int") for c, (s, kws) in K.SERVE_AMENITY_FLAGS.items()},
        **{c: has(kind, part) for c, part in K.SERVE_TYPE_FLAGS.items()},
        "is_major_city": place.mentions_flag(K.MAJOR_CITIES_SERVE, governorate, delegation),
        "is_coastal": place.mentions_flag(K.COASTAL_SERVE, governorate),
        **{c: place.mentions_flag(kws, governorate) for c, kws in K.SERVE_GOVERNORATE_FLAGS.items()},
        "gov_unknown": (governorate == "").cast("int"),
        **{c: flag("conditions", kws).cast("int") for c, kws in K.SERVE_CONDITION_FLAGS.items()},
        **scores.indicators(scores.tier_by_area(living), K.TIERS, "property_tier_", slug=False),
        **scores.indicators(scores.market_segment(price, "serve"), K.SEGMENTS, "market_segment_", slug=False),
    }
    keep = keep or []
    built = base.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], *[v.alias(c) for c, v in features.items()])
    kept = [F.col(f"__keep_{c}").alias(c if c not in features else f"raw_{c}") for c in keep]
    return align_features(built, K.SERVING_FEATURES, [f"__keep_{c}" for c in keep]).select(
        *kept, *[F.col(f"`{c}`") for c in K.SERVING_FEATURES])
