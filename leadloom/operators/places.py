"""Provinces by the name of a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import filled, strip_diacritics


def place_key(name: Column) -> Column:
    return filled(F.trim(F.regexp_replace(F.regexp_replace(strip_diacritics(F.lower(name)), r"[^a-z0-9\s]", " "), r"\s+", " ")))


def place_index(places: DataFrame) -> DataFrame:
    """(key, province) of places (place, province): the name, and both halves of a name in two languages. A key of several provinces has null."""
    forms = F.when(F.contains("place", F.lit("/")), F.concat(F.array("place"), F.split("place", "/"))).otherwise(F.array("place"))
    keyed = places.filter("province is not null").select(F.explode(forms).alias("name"), "province").select(place_key(F.col("name")).alias("key"), "province")
    only = F.when(F.min("province") == F.max("province"), F.min("province"))
    return keyed.filter("key is not null").groupBy("key").agg(only.alias("province"))


def fill_province(leads: DataFrame, index: DataFrame, columns: tuple[str, ...] = ("business_city", "city", "query_location")) -> DataFrame:
    """leads with province filled where it is empty, from the first of the columns whose place is known and in one province."""
    sure, out = index.filter("province is not null"), leads
    names = [c for c in columns if c in leads.columns]
    for k, c in enumerate(names):
        own = sure.select(F.col("key").alias(f"_key{k}"), F.col("province").alias(f"_province{k}"))
        out = out.withColumn(f"_key{k}", F.when(F.coalesce(F.trim("province"), F.lit("")) == "", place_key(F.col(c)))).join(own, f"_key{k}", "left")
    guess = F.coalesce(*[F.col(f"_province{k}") for k in range(len(names))]) if names else F.lit(None).cast("string")
    kept = F.when(F.coalesce(F.trim("province"), F.lit("")) != "", F.col("province"))
    return out.withColumn("province", F.coalesce(kept, guess, F.col("province"))).select(*leads.columns)
