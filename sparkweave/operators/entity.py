"""The precomputed entity table: every field that blocking and features need, once per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions import text as X


def entities(records: DataFrame, presplit: bool = True, more: bool = True, grams: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """presplit: hyphens and slashes become blanks first; more: the longer stop lists. Both belong together. grams: with the
    four-grams of names, which only the gram features and keys need and which make most of the work. carry: further columns of records to keep."""
    name, address = (X.presplit(F.col(c)) if presplit else X.text_of(F.col(c)) for c in ("business_name", "business_address"))
    first = records.select(
        "entity_id",
        *carry,
        F.substring("entity_id", 1, 2).alias("source"),
        X.country_key(F.col("country")).alias("country"),
        X.text_of(F.col("business_name")).alias("raw_name"),
        X.text_of(F.col("business_address")).alias("raw_address"),
        X.normalize_name(name).alias("name"),
        X.normalize_address(address).alias("address"),
        X.normalize_name(X.presplit(X.transliterate(X.text_of(F.col("business_name"))))).alias("latin_name"),
    )
    return first.select(
        "*",
        X.name_tokens(F.col("name"), more).alias("name_tokens"),
        X.content(F.col("name"), 2, more).alias("content"),
        X.address_tokens(F.col("address"), more).alias("address_tokens"),
        X.address_words(F.col("address"), more).alias("address_words"),
        X.numbers(F.col("address")).alias("numbers"),
        X.pincode(F.col("raw_address")).alias("pincode"),
        *([X.char_grams(F.col("name"), 4).alias("grams")] if grams else []),
        X.url_core(F.col("name")).alias("url"),
        X.url_core(F.col("raw_name")).alias("raw_url"),
        X.content(F.col("latin_name"), 3, more).alias("latin_content"),
        X.aliases(F.col("raw_name")).alias("aliases"),
    )
