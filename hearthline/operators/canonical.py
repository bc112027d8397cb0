"""Raw page fields to the canonical listing, one layout per kind of site.

``options``: option labels and a label/value list. ``boxes``: icon labels and feature boxes.
``estate``: one embedded JSON object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import constants as K
from hearthline.functions import dates, labels, money, numbers, place, text, urls
from hearthline.operators.columns import conform
from hearthline.operators.pages import Rule, embedded_json, extract_fields, unescape
from hearthline.schemas import ESTATE_SCHEMA, GALLERY_SCHEMA, LISTING_SCHEMA

# --- fixed values: where each layout keeps its fields --------------------------------------
RULES = {
    "options": [
        Rule("title", ".product-title-h1 h1[itemprop=name]"),
        Rule("address", ".product-title-h1 p"),
        Rule("price", ".product-price p"),
        Rule("ref", ".block-ref"),
        Rule("date", ".block-ref time[itemprop=datePublished]", "datetime"),
        Rule("photos", ".slider-product img[src*=upload/photos]", "src"),
        Rule("description", ".block-descr p[itemprop=text]"),
        Rule("detail_labels", ".block-detail .block-over span"),
        Rule("detail_values", ".block-detail .block-over strong"),
        Rule("options", ".span-opts strong"),
    ],
    "boxes": [
        Rule("id", ".favDivPickId[id]", "id"),
        Rule("lead_id", "input#adIdLead[value]", "value"),
        Rule("price", ".mainInfoProp h3.orangeTit"),
        Rule("price", "#fullPicturesHeader .fullPicturesPrice"),
        Rule("title", ".blockProp h1.searchTitle"),
        Rule("description", ".blockProp p"),
        Rule("measures", ".adDetails .adDetailFeature span"),
        Rule("detail_labels", ".adMainFeature .adMainFeatureContent .adMainFeatureContentLabel"),
        Rule("detail_values", ".adMainFeature .adMainFeatureContent .adMainFeatureContentValue"),
        Rule("address", "h3.greyTit"),
        Rule("options", ".adFeatures .adFeature span"),
        Rule("agency", ".agency-info .businessInfo .businessName a"),
        Rule("gallery", "[id^=fl-][pics]", "pics"),
        Rule("photos", "#masonryPhoto img[src*=mubawab-media.com]", "src"),
        Rule("photos", "#picturesGallery img[src*=mubawab-media.com]", "src"),
        Rule("date", "meta[itemprop=datePublished][content]", "content"),
        Rule("date", "time[itemprop=datePublished][datetime]", "datetime"),
    ],
    "estate": [
        Rule("estate", "bottom-menu", ":estate"),
        Rule("estate", "bottom-menu", "estate"),
        Rule("paragraphs", "template[slot=estate-description] p"),
        Rule("cost_rows", "template[slot=estate-costs] .row"),
        Rule("cost_rows", ".costs-container .row"),
        Rule("shown_price", ".estate-price .current-price"),
        Rule("feature_rows", "template[slot=estate-features] .row"),
    ],
}


def _all(field: str) -> Column:
    return F.coalesce(F.element_at("fields", F.lit(field)), F.array().cast("array<string>"))


def _one(field: str) -> Column:
    return F.get(F.element_at("fields", F.lit(field)), F.lit(0))


def _cleaned(field: str) -> Column:
    return F.filter(F.transform(_all(field), text.clean_text), lambda x: x.isNotNull())


def _details() -> Column:
    """Label/value pairs by position; the last value of a repeated label wins."""
    pairs = F.arrays_zip(F.transform(_all("detail_labels"), text.clean_text), F.transform(_all("detail_values"), text.clean_text))
    usable = F.filter(pairs, lambda p: p["0"].isNotNull() & p["1"].isNotNull())
    distinct = F.filter(usable, lambda p, i: ~F.exists(F.slice(usable, i + 2, F.size(usable)), lambda q: q["0"] == p["0"]))
    return F.map_from_entries(distinct)


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), text.strip), lambda x: x != "")


def _non_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def raw_options(df: DataFrame) -> DataFrame:
    """Extracted fields of an 'options' page as raw listing columns."""
    return df.select(
        "url", "page_text", text.clean_text(_one("title")).alias("title"), text.clean_text(_one("address")).alias("raw_address"),
        text.clean_text(_one("price")).alias("raw_price"), _one("ref").alias("ref_text"), _one("date").alias("date_text"),
        F.array_distinct(_all("photos")).alias("photos"), F.coalesce(_lines(_one("description")), F.array().cast("array<string>")).alias("lines"),
        _details().alias("details"), F.array_distinct(_cleaned("options")).alias("options"),
    )


def listing_options(raw: DataFrame, source: str, agency_name: str = "Visavis Immobilier", agency_marker: str = "Visavis") -> DataFrame:
    place_parts = place.split_address(F.col("raw_address"))
    priced = money.price_and_currency(F.col("raw_price"))
    hay = F.concat_ws(" ", "title", F.array_join("lines", " "))
    number = {c: numbers.digits_to_int(labels.lookup(F.col("details"), label)) for c, label in K.OPTION_DETAIL_LABELS.items()}
    flags = {c: labels.label_flag(F.col("options"), variants) for c, variants in K.OPTION_LABELS.items()}
    out = raw.withColumn("__a", place_parts).withColumn("__p", priced).select(
        "url", labels.reference_id(F.col("ref_text")).alias("id"), F.lit(source).alias("source"),
        labels.property_type(hay).alias("property_type"), F.col("__p.price").alias("price"), F.col("__p.currency").alias("currency"),
        F.col("lines").alias("description"), "__a.address", F.nullif(F.col("__a.governorate"), F.lit("nan")).alias("governorate"),
        "__a.delegation", "__a.locality", *[v.alias(c) for c, v in number.items()], *[v.alias(c) for c, v in flags.items()],
        text.phones(F.col("page_text")).alias("phone"), labels.agency(F.col("page_text"), agency_name, agency_marker).alias("agency"),
        dates.epoch_ms(F.col("date_text")).alias("listing_date"), _non_empty(F.col("photos")).alias("photos"),
        _non_empty(F.col("options")).alias("features"), labels.transaction_type(hay, "options").alias("transaction_type"),
    )
    return conform(out, LISTING_SCHEMA)


def raw_boxes(df: DataFrame) -> DataFrame:
    """Extracted fields of a 'boxes' page as raw listing columns."""
    gallery = F.transform(F.from_json(unescape(_one("gallery")), GALLERY_SCHEMA), lambda g: g["photo"]["url"])
    photos = F.coalesce(_non_empty(F.filter(gallery, lambda u: u.isNotNull())), _all("photos"))
    return df.select(
        "url", "page_text",
        F.coalesce(F.when(_one("id").rlike(r"^\d+$"), _one("id")), _one("lead_id")).alias("ref_id"),
        text.clean_text(_one("title")).alias("title"), text.clean_text(_one("address")).alias("raw_address"),
        text.clean_text(_one("price")).alias("raw_price"), _one("date").alias("date_text"), text.clean_text(_one("agency")).alias("agency"),
        F.array_distinct(photos).alias("photos"), F.coalesce(_lines(_one("description")), F.array().cast("array<string>")).alias("lines"),
        _details().alias("details"), _cleaned("options").alias("options"), _cleaned("measures").alias("measures"),
    )


def listing_boxes(raw: DataFrame, source: str) -> DataFrame:
    joined = F.array_join("lines", " ")
    hay = F.concat_ws(" ", "title", joined)
    features = F.concat("options", labels.label_list(F.col("details")))
    blob = F.lower(F.concat_ws(" ", joined, F.array_join("__f", " ")))
    names = dict.fromkeys([*K.BOX_LABELS, *K.BOX_TEXT_PATTERNS])
    flags = {c: labels.label_or_text_flag(F.col("__f"), K.BOX_LABELS.get(c), blob, K.BOX_TEXT_PATTERNS.get(c)) for c in names}
    by_label = lambda part: text.clean_text(F.get(F.filter(F.map_entries("details"), lambda e: F.lower(e["key"]).contains(part)), F.lit(0))["value"])
    staged = (
        raw.withColumn("__f", features).withColumn("__t", labels.transaction_type(hay, "boxes"))
        .withColumn("__p", money.choose_price(
            F.col("__t"), money.price_and_currency(F.col("raw_price"), r"\b(?:TND|DT|Dinars?)\b"), money.description_price(joined)))
        .withColumn("__a", place.split_in_phrase(F.col("raw_address")))
    )
    out = staged.select(
        "url", F.col("ref_id").alias("id"), F.lit(source).alias("source"), by_label("type of property").alias("property_type"),
        F.col("__p.price").alias("price"), F.col("__p.currency").alias("currency"), F.col("lines").alias("description"),
        "__a.address", "__a.delegation", "__a.locality",
        labels.measure(F.col("measures"), r"m²").alias("living_area"),
        numbers.decimal_to_int(by_label("outside surface")).alias("land_area"),
        labels.measure(F.col("measures"), r"\b\d+\s*Rooms?\b").alias("room_count"),
        labels.measure(F.col("measures"), r"\b\d+\s*Bathrooms?\b").alias("bathroom_count"),
        *[v.alias(c) for c, v in flags.items()], text.phones(F.col("page_text")).alias("phone"), "agency",
        dates.epoch_ms(F.col("date_text")).alias("listing_date"), _non_empty(F.col("photos")).alias("photos"),
        _non_empty(F.col("__f")).alias("features"), by_label("condition").alias("condition"), F.col("__t").alias("transaction_type"),
    )
    return conform(out, LISTING_SCHEMA)


def raw_estate(df: DataFrame) -> DataFrame:
    """Extracted fields of an 'estate' page as raw listing columns."""
    prices = F.filter(_cleaned("cost_rows"), lambda r: F.lower(r).contains("prix"))
    floors = F.filter(_cleaned("feature_rows"), lambda r: r.rlike(text.UNICODE_ICASE + r"\b[eé]tage\b"))
    return df.select(
        "url", "page_text", embedded_json(_one("estate"), ESTATE_SCHEMA).alias("estate"), _cleaned("paragraphs").alias("lines"),
        F.coalesce(F.get(prices, F.lit(0)), text.clean_text(_one("shown_price"))).alias("raw_price"),
        F.get(floors, F.lit(0)).alias("floor_text"),
    )


def listing_estate(raw: DataFrame, source: str) -> DataFrame:
    e = F.col("estate")
    data = F.map_from_entries(F.transform(
        F.filter(e["data"], lambda d, i: ~F.exists(F.slice(e["data"], 1, i), lambda q: q["label"] == d["label"]) & d["label"].isNotNull()),
        lambda d: F.struct(d["label"].alias("key"), d["valore"].alias("value"))))
    listed = lambda label: labels.lookup(data, label)
    filled = lambda c: F.nullif(c, F.lit(""))
    governorate = F.coalesce(filled(e["province"]["title"]), listed("Région"))
    delegation = F.coalesce(filled(e["city"]["title"]), listed("Municipalité"))
    own = money.estate_price(e)
    shown = money.text_price(F.col("raw_price"))
    swept = money.text_price(F.col("page_text"), unit_required=True)
    price = (
        F.when(own["price"].isNotNull(), own).when(shown["price"].isNotNull(), shown).otherwise(swept)
    )
    described = F.coalesce(_non_empty(text.paragraphs(unescape(e["description"]))), _non_empty(F.col("lines")))
    body = F.array_join(described, " ")
    photos = F.transform(e["media"]["images"], lambda i: F.coalesce(i["url"]["detail"], i["url"]["gallery"], i["url"]["card"]))
    agency = e["agency"]
    year = F.coalesce(filled(e["dates"]["build_year"]), filled(e["features"]["build_year"]))
    out = raw.withColumn("__p", price).select(
        "url", F.coalesce(filled(e["id"]), urls.listing_id(F.col("url"))).alias("id"), F.lit(source).alias("source"),
        text.clean_text(F.coalesce(filled(e["type"]["title"]), listed("Typologie"))).alias("property_type"),
        F.col("__p.price").alias("price"), money.normal_currency(F.col("__p.currency")).alias("currency"), described.alias("description"),
        place.compose_address(delegation, governorate).alias("address"), text.clean_text(governorate).alias("governorate"),
        text.clean_text(delegation).alias("delegation"),
        text.clean_text(F.coalesce(listed("Postal Code"), agency["zip_code"])).alias("postal_code"),
        numbers.digits_to_int(F.coalesce(filled(e["numeric_surface"]), listed("Surface"), e["surface"])).alias("living_area"),
        numbers.first_int(F.coalesce(listed("Pièces"), e["rooms"])).alias("room_count"),
        numbers.digits_to_int(year).alias("construction_year"),
        F.coalesce(numbers.digits_to_int(F.coalesce(filled(e["features"]["floor"]), listed("étage"))),
                   numbers.first_int(F.col("floor_text"))).alias("floor"),
        *[labels.stem_flag(body, stem).alias(c) for c, stem in K.DESCRIPTION_STEMS.items()],
        text.clean_text(F.coalesce(filled(e["features"]["heating"]), e["energy_data"]["heating"])).alias("heating"),
        text.clean_text(e["features"]["air_conditioning"]).alias("air_conditioning"),
        e["features"]["furnitured"].try_cast("boolean").alias("furnished"),
        text.phones_from_fields(agency["phone"], agency["whatsapp"], agency["phone_real"], agency["phone_proxy"]).alias("phone"),
        text.clean_text(agency["name"]).alias("agency"), dates.epoch_ms(e["last_published_at"]).alias("listing_date"),
        F.array_distinct(F.filter(photos, lambda u: u.isNotNull())).alias("photos"),
        labels.contract_transaction(F.coalesce(filled(e["contract"]["slug"]), e["contract"]["slug_estate"])).alias("transaction_type"),
    )
    return conform(out, LISTING_SCHEMA)


_LAYOUTS = {
    "options": (raw_options, listing_options),
    "boxes": (raw_boxes, listing_boxes),
    "estate": (raw_estate, listing_estate),
}


def listings_from_pages(pages: DataFrame, layout: str, source: str) -> DataFrame:
    """Pages of one layout straight to canonical listings."""
    to_raw, to_listing = _LAYOUTS[layout]
    return to_listing(to_raw(extract_fields(pages, RULES[layout])), source)


def listings_by_provider(pages: DataFrame, provider: Column, layouts: dict[str, str]) -> DataFrame:
    """One listing per page: each page is read by its provider's layout only, and ``source`` names the provider.

    Pages of a provider without a layout give a listing with their URL and provider only; a page without a provider is left to the caller.
    """
    routed = pages.withColumn("__provider", provider)
    known = [listings_from_pages(routed.where(F.col("__provider") == p).drop("__provider"), layout, p) for p, layout in layouts.items()]
    other = conform(routed.where(F.col("__provider").isNotNull() & ~F.col("__provider").isin(list(layouts))).select("url", F.col("__provider").alias("source")), LISTING_SCHEMA)
    return reduce(DataFrame.unionByName, known, other)
