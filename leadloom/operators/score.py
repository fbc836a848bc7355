"""Lead quality, lead score, ranks and quantiles."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.contact import vat_valid
from leadloom.functions.numbers import clamp, parse_number, round_up
from leadloom.functions.text import has

#: How far an e-mail of a status counts.
EMAIL_FACTORS = {"deliverable": 1.0, "pec": 0.9, "catch_all": 0.55, "invalid": 0.05}
EMAIL_UNKNOWN = 0.5
SOCIAL = ["instagram", "facebook", "linkedin", "tiktok", "youtube"]


def quality() -> Column:
    """Share of identifying fields of an input lead; a name alone has 0.1, a name with site and code at least 0.85."""
    name, city = has(F.col("company_name")), has(F.col("city"))
    mail = F.coalesce(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    total = part(name & city, 0.5) + part(mail, 0.2) + part(has(F.col("vat_code")), 0.2) + part(has(F.col("website")), 0.15) + part(has(F.col("phone")) | has(F.col("address")), 0.1) + part(has(F.col("province")), 0.05)
    total = F.when(name & has(F.col("website")) & vat_valid(F.col("vat_code")), F.greatest(total, F.lit(0.85))).otherwise(total)
    return round_up(F.when(total == 0, part(name, 0.1)).otherwise(F.least(total, F.lit(1.0))), 3)


def lead_score(columns: list[str]) -> Column:
    """Weighted completeness and reputation, 0 to 1 with three decimals, of a lead with the columns; a part that is missing
    or has no column counts nothing, and the other parts keep their weights."""
    part = lambda *names: functools.reduce(operator.or_, [has(F.col(c)) for c in names if c in columns], F.lit(False))
    one = lambda *names: F.when(part(*names), 1.0).otherwise(0.0)
    text = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    yes = lambda c: F.when(text(c) == "true", 1.0).otherwise(0.0)
    email = F.lit(EMAIL_UNKNOWN)
    for status, factor in EMAIL_FACTORS.items():
        email = F.when(text("email_status") == status, factor).otherwise(email)
    rating, reviews = parse_number(text("rating")), F.coalesce(parse_number(text("reviews_count")), F.lit(0.0))
    fame = 0.3 + 0.7 * clamp((rating - 3) / 2) * F.least(F.lit(1.0), F.log10(1 + reviews) / 2)
    social = sum((one(c) for c in SOCIAL), F.lit(0.0))
    listings = F.least(F.lit(1.0), F.log10(1 + F.coalesce(parse_number(text("portal_listings_count")), F.lit(0.0))) / 2)
    total = (
        0.3 * F.when(part("email_inferred", "email"), email).otherwise(0.0)
        + 0.15 * F.when(part("official_website"), 1.0).when(part("website"), 0.4).otherwise(0.0)
        + 0.15 * 0.25 * (one("vat_code_final") + one("revenue") + one("employees", "share_capital", "legal_form") + one("decision_maker_name"))
        + 0.1 * one("phone")
        + 0.1 * F.when(rating.between(0, 5), fame).otherwise(0.0)
        + 0.1 * F.least(F.lit(3.0), social) / 3
        + 0.05 * one("pec")
        + 0.05 * (0.5 * listings + 0.25 * yes("portal_is_paid") + 0.25 * yes("portal_fiaip"))
    )
    return round_up(clamp(total), 3)


def scored(leads: DataFrame) -> DataFrame:
    return leads.withColumn("score", lead_score(leads.columns))


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The best leads in order; ties keep the input order."""
    cut = scores.orderBy(F.desc("score"), "seq").limit(top)  # a top list by definition
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))


def quantiles(scores: DataFrame, shares: list[float]) -> DataFrame:
    """(share, score): the value at place floor(share * n) of the sorted scores, from the counts of each score."""
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))  # a score has at most 1,001 values
    w = Window.orderBy("score")
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    wanted = placed.select("score", "upto", "n", F.explode(F.array(*map(F.lit, shares))).alias("share"), "all")
    at = F.least(F.floor(F.col("share") * F.col("all")), F.col("all") - 1)
    return wanted.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select("share", "score")


def histogram(scores: DataFrame) -> DataFrame:
    """(decile, n) of scores."""
    return scores.groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("bigint").alias("decile")).agg(F.count("*").alias("n"))
