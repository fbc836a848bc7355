"""Guessing and ranking of web domains, and search queries for a lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import company_key_text, key_text

TLDS = ["it", "com", "eu", "net", "org"]
#: Words of a name that don't tell firms apart.
COMMON = ["ditta", "societa", "impresa", "studio", "agenzia", "servizi", "srl", "srls", "spa", "snc", "sas", "sapa"]
#: Points of a top-level domain.
TLD_POINTS = {"it": 8, "com": 4, "eu": 2}


def _words(name: Column) -> Column:
    return F.filter(F.split(company_key_text(name), " "), lambda w: (w != "") & ~w.isin(["srl", "srls", "spa", "snc", "sas", "sapa"]))


def _spelled(leads: DataFrame) -> DataFrame:
    """(seq, full, dashed, brand, town) of leads; the words are a column of their own, so that they are made once a lead."""
    rows = leads.select("seq", _words(F.col("company_name")).alias("words"), F.regexp_replace(key_text(F.col("city")), " ", "").alias("town"))
    brand = F.array_join(F.filter("words", lambda w: ~w.isin(COMMON)), "")
    return rows.select("seq", F.array_join("words", "").alias("full"), F.array_join("words", "-").alias("dashed"), brand.alias("brand"), "town")


def domain_candidates(leads: DataFrame, most: int = 60) -> DataFrame:
    """(seq, domain, stem, tld, ord): names that a firm may have registered."""
    named = _spelled(leads.filter("company_name is not null"))
    stems = F.array_distinct(F.filter(F.array("full", "dashed", "brand", F.concat("brand", "town"), F.concat("full", "town")), lambda s: F.length(s).between(4, 60)))
    pairs = F.flatten(F.transform(stems, lambda s: F.array(*[F.struct(s.alias("stem"), F.lit(t).alias("tld")) for t in TLDS])))
    rows = named.select("seq", F.posexplode(F.slice(pairs, 1, most)).alias("ord", "p"))
    return rows.select("seq", F.concat_ws(".", "p.stem", "p.tld").alias("domain"), F.col("p.stem").alias("stem"), F.col("p.tld").alias("tld"), "ord")


def rank_candidates(candidates: DataFrame, leads: DataFrame, top: int = 6) -> DataFrame:
    """(seq, domain, points, place): the best candidates by likeness of stem and name; stems under six letters drop."""
    rows = candidates.join(_spelled(leads).drop("dashed"), "seq").withColumn("bare", F.regexp_replace("stem", "-", ""))
    flag = lambda c, w: F.when(c, w).otherwise(0)
    likeness = F.when(F.col("bare") == F.col("full"), 100).when(F.contains(F.col("bare"), F.col("full")), 80).when(F.col("bare") == F.col("brand"), 70).when((F.length("brand") >= 3) & F.contains(F.col("bare"), F.col("brand")), 50).otherwise(0)
    tld = F.lit(0)
    for t, w in TLD_POINTS.items():
        tld = F.when(F.col("tld") == t, w).otherwise(tld)
    points = likeness + flag((F.length("brand") >= 3) & (F.col("bare") == F.concat("brand", "town")), 20) + flag(F.col("bare") == F.col("town"), -80) + flag(F.col("bare").isin(COMMON), -200) + tld + flag(F.length("bare") >= 12, 4)
    kept = rows.withColumn("points", points.cast("bigint")).filter((F.length("bare") >= 6) & (F.col("points") >= -50))
    place = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("points"), "ord"))
    return kept.withColumn("place", place).filter(F.col("place") <= top).select("seq", "domain", "points", "place")


def query_variants(leads: DataFrame, most: int = 10) -> DataFrame:
    """(seq, priority, query): search queries from the most to the least specific, once each, at most 200 letters."""
    name, city = F.col("company_name"), F.col("city")
    phone = F.when(F.col("phone") != "", F.col("phone"))
    rows = F.array(
        F.struct(F.lit(1).alias("priority"), F.concat(F.lit('"'), name, F.lit('" '), city).alias("query")),
        F.struct(F.lit(2).alias("priority"), F.concat_ws(" ", name, city, F.lit("sito ufficiale")).alias("query")),
        F.struct(F.lit(3).alias("priority"), F.concat(name, F.lit(" "), F.col("vat_code")).alias("query")),
        F.struct(F.lit(4).alias("priority"), F.concat(F.lit('"'), phone, F.lit('"')).alias("query")),
        F.struct(F.lit(5).alias("priority"), F.concat_ws(" ", name, F.col("category")).alias("query")),
    )
    each = leads.filter("company_name is not null").select("seq", F.explode(rows).alias("r")).select("seq", "r.*").filter("query is not null")
    one = each.withColumn("query", F.substring("query", 1, 200)).groupBy("seq", "query").agg(F.min("priority").alias("priority"))
    place = F.row_number().over(Window.partitionBy("seq").orderBy("priority"))
    return one.withColumn("place", place).filter(F.col("place") <= most).select("seq", F.col("priority").cast("bigint").alias("priority"), "query")
