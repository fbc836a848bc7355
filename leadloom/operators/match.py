"""Joins between leads and other lists: suppression, portal records, outbound lists, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.contact import phone_key, suppression_phone, vat_digits
from leadloom.functions.text import company_key_text, filled, key_text
from leadloom.operators.gates import match_keys, name_tokens, tokens_match


def suppression_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """(seq, key): phone and tax-code keys by which a row can be suppressed."""
    keys = [suppression_phone(F.col(c)) if "phone" in c else filled(vat_digits(F.col(c))) for c in columns]
    return rows.select("seq", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def suppress(leads: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): leads without and with a key on the list (column key)."""
    hit = suppression_keys(leads, "phone", "vat_code").join(listed.select("key").distinct(), "key", "left_semi").select("seq").distinct()
    return leads.join(hit, "seq", "left_anti"), leads.join(hit, "seq", "left_semi")


def clear_emails(leads: DataFrame, listed: DataFrame) -> DataFrame:
    """Leads with listed e-mail addresses, and what depends on them, set to null."""
    marks = listed.select(F.lower("email").alias("e")).distinct().withColumn("hit", F.lit(True))
    out = leads.join(marks, F.lower("email") == F.col("e"), "left")
    return out.withColumns({c: F.when(F.col("hit").isNull(), F.col(c)) for c in ("email", "email_status")}).drop("e", "hit")


def _named(rec: DataFrame, own: DataFrame, place: str) -> DataFrame:
    """(place, words, n, first): how many leads of a record's place have a matching name, and the first of them.

    Each spelling of a place is compared once, with spellings that share a key; leads are counted by spelling before.
    """
    known = own.filter(F.col(place).isNotNull()).groupBy(place, F.col("words").alias("own")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    asked = rec.filter(F.col(place).isNotNull()).select(place, "words").distinct()
    hits = asked.withColumn("k", F.explode(match_keys(F.col("words")))).join(known.withColumn("k", F.explode(match_keys(F.col("own")))), [place, "k"])
    hits = hits.filter(tokens_match(F.col("words"), F.col("own"))).select(place, "words", "own", "n", "first").distinct()
    return hits.groupBy(place, "words").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def match_portal(leads: DataFrame, portal: DataFrame) -> DataFrame:
    """(rec, seq, how): each portal record's lead, or a null seq where none is sure.

    A phone that one lead has decides: that lead (phone), or nothing if its name is another firm's (mismatch). Of
    several leads with the phone, the only one with a matching name (phone_name), else nothing (ambiguous). Without
    leads of the phone: the only lead of the same name and city (name_city), else the only one of the city with a
    matching name (fuzzy), else nothing (ambiguous or unmatched). Leads are counted for each key before the joins.
    """
    name, city = company_key_text(F.col("company_name")), key_text(F.col("city"))
    keys = [
        phone_key(F.col("phone")).alias("phone"), F.when(city != "", city).alias("city"), F.array_sort(name_tokens(F.col("company_name"))).alias("words"),
        F.when((F.length(name) >= 3) & (F.length(city) >= 2), F.concat_ws("|", name, city)).alias("key"),
    ]
    own, rec = leads.select("seq", *keys), portal.select("rec", filled(F.col("company_name")).isNotNull().alias("named"), *keys)
    count = lambda k: own.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"n_{k}"), F.min("seq").alias(f"seq_{k}"), F.min_by("words", "seq").alias(f"words_{k}"))
    out = rec.join(count("phone"), "phone", "left").join(count("key").drop("words_key"), "key", "left")
    shared = out.filter("n_phone > 1")
    for place, some in (("phone", shared), ("city", rec)):
        found = _named(some, own, place).select(place, "words", F.col("n").alias(f"like_{place}"), F.col("first").alias(f"first_{place}"))
        out = out.join(found, [place, "words"], "left")
    same = ~F.col("named") | tokens_match(F.col("words"), F.col("words_phone"))
    how = (
        F.when(F.col("n_phone") == 1, F.when(same, "phone").otherwise("mismatch"))
        .when(F.col("n_phone") > 1, F.when(F.col("like_phone") == 1, "phone_name").otherwise("ambiguous"))
        .when(F.col("n_key") == 1, "name_city")
        .when(F.col("like_city") == 1, "fuzzy")
        .when(F.col("like_city") > 1, "ambiguous")
        .otherwise("unmatched")
    )
    seq = F.when(F.col("how") == "phone", F.col("seq_phone")).when(F.col("how") == "phone_name", F.col("first_phone"))
    seq = seq.when(F.col("how") == "name_city", F.col("seq_key")).when(F.col("how") == "fuzzy", F.col("first_city"))
    return out.withColumn("how", how).select("rec", seq.alias("seq"), "how")


def attach_portal(leads: DataFrame, portal: DataFrame, matches: DataFrame) -> DataFrame:
    """(seq, phone, listings, portal_records): leads with what their records add, of the first record that has it. The
    lead's phone stays as it is, since a portal may print a number of its own."""
    found = matches.filter("seq is not null").join(portal.select("rec", "listings"), "rec")
    best = found.groupBy("seq").agg(F.min_by("listings", F.when(F.col("listings").isNotNull(), F.col("rec"))).alias("listings"), F.count("*").alias("portal_records"))
    return leads.join(best, "seq").select("seq", filled(F.col("phone")).alias("phone"), "listings", "portal_records")


def outbound(leads: DataFrame) -> DataFrame:
    """One row for each phone and city: first values by seq, united categories, a second phone spelling if there is one."""
    rows = leads.withColumn("k", F.concat_ws("|", phone_key(F.col("phone")), key_text(F.col("city")))).filter(phone_key(F.col("phone")).isNotNull())
    pick = lambda c: F.min_by(filled(F.col(c)), F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("seq"))).alias(c)
    return rows.groupBy("k").agg(F.min("seq").alias("seq"), F.count("*").alias("merged"), *[pick(c) for c in ("company_name", "city", "phone", "email", "website")], F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(value, n_before, n_after, delta): tallies of two snapshots; values of either side appear."""
    b = before.groupBy(F.coalesce(value, F.lit("<unset>")).alias("value")).agg(F.count("*").alias("n_before"))
    a = after.groupBy(F.coalesce(value, F.lit("<unset>")).alias("value")).agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    both = b.join(a, "value", "full_outer")
    return both.select("value", zero(F.col("n_before")).alias("n_before"), zero(F.col("n_after")).alias("n_after"), (zero(F.col("n_after")) - zero(F.col("n_before"))).alias("delta"))


def gains(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): keys with a value after and none before; of repeated keys the last by seq counts."""
    last = lambda df: df.groupBy(key).agg(F.max_by(value, "seq").alias(value))
    old = last(before).select(key, F.col(value).alias("old"))
    return last(after).join(old, key, "left").filter((F.coalesce(F.col(value), F.lit("")) != "") & (F.coalesce("old", F.lit("")) == "")).select(key, value)


def first_success(candidates: DataFrame, row: str, order: list[str], verdict: str) -> DataFrame:
    """A ladder's outcome: of each row's candidates the first that holds, and how many were tried before."""
    w = Window.partitionBy(row).orderBy(*order)
    ranked = candidates.withColumn("place", F.row_number().over(w))
    return ranked.groupBy(row).agg(F.min(F.when(F.col(verdict), F.col("place"))).alias("place"), F.count("*").alias("tried"))
