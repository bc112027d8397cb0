"""Schemas of raw and normalised listings and of the nested page payloads."""

from __future__ import annotations

from pyspark.sql import types as T

from hearthline.constants import LISTING_FIELDS

_TYPES = {
    "price": T.DoubleType(), "living_area": T.DoubleType(), "land_area": T.DoubleType(),
    "description": T.ArrayType(T.StringType()), "phone": T.ArrayType(T.StringType()),
    "photos": T.ArrayType(T.StringType()), "features": T.ArrayType(T.StringType()),
    "room_count": T.IntegerType(), "bathroom_count": T.IntegerType(),
    "construction_year": T.IntegerType(), "floor": T.IntegerType(),
    "has_garage": T.BooleanType(), "has_garden": T.BooleanType(), "has_pool": T.BooleanType(),
    "has_balcony": T.BooleanType(), "has_terrace": T.BooleanType(),
    "furnished": T.BooleanType(), "listing_date": T.LongType(), "last_updated": T.LongType(),
}

LISTING_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES.get(name, T.StringType())) for name in LISTING_FIELDS]
)

# Sources disagree on types (a price is text, a number or "nan"), so raw files are read as text.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in LISTING_FIELDS])

GALLERY_SCHEMA = "array<struct<photo:struct<url:string>>>"

ESTATE_SCHEMA = (
    "struct<id:string,private_negotiation:boolean,numeric_price:double,price:string,"
    "costs:struct<price:string>,type:struct<title:string>,province:struct<title:string>,"
    "city:struct<title:string>,numeric_surface:string,surface:string,rooms:string,"
    "dates:struct<build_year:string>,"
    "features:struct<floor:string,build_year:string,heating:string,air_conditioning:string,"
    "furnitured:string>,energy_data:struct<heating:string>,"
    "media:struct<images:array<struct<url:struct<detail:string,gallery:string,card:string>>>>,"
    "agency:struct<name:string,phone:string,whatsapp:string,phone_real:string,"
    "phone_proxy:string,zip_code:string>,data:array<struct<label:string,valore:string>>,"
    "description:string,last_published_at:string,"
    "contract:struct<slug:string,slug_estate:string>>"
)

TASK_LOG_SCHEMA = (
    "task_name string, start_time string, end_time string, duration_seconds double, "
    "success boolean, error string, retry_count int, pages_scanned int, found_urls int, "
    "scraped_new int, total_saved int, output_file string"
)
