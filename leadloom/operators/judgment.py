"""From what sources answered to a checked judgment: footprint of channels, signals of every dimension, critic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.numbers import clamp, round_up
from leadloom.functions.text import has

#: Dimensions of axis A and surfaces of axis B.
DIMENSIONS = ["2.1", "2.2", "2.3", "2.4", "2.5", "2.6", "2.7"]
SURFACES = ["3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.7", "3.8", "3.9", "3.10", "3.11", "3.12", "3.13", "3.14", "3.15"]
#: Channels in order and the surface that each speaks for.
CHANNELS = {
    "website": "3.1", "instagram": "3.5", "facebook": "3.5", "linkedin_company": "3.8", "linkedin_founder": "3.8", "tiktok": "3.6",
    "youtube": "3.7", "gbp": "3.3", "ad_library": "3.11", "ecommerce": "3.10", "marketplace": "3.9",
}
NETWORKS = {"instagram": "instagram", "facebook": "facebook", "linkedin_company": "linkedin", "tiktok": "tiktok", "youtube": "youtube"}
PRESENT, ABSENT, UNKNOWN = "confirmed_present", "confirmed_absent", "unknown_not_found"
LEAST_COVERAGE = 0.34


def _found(state: str, ownership: str, confidence: float, method: str) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(ownership).alias("ownership"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def footprint(answers: DataFrame) -> DataFrame:
    """(seq, channel, state, ownership, confidence, method): all eleven channels of each lead.

    answers has one row a lead: site (its address), site_ok (fetched and its own), linked and searched (maps from network to
    profile found on the site and by search), search_ok (search was made), missing (networks it found absent), places and ads
    (states or null), places_ok and ads_ok, shop (markers of a shop on the site). Null flags are false. A channel is absent
    only where a search was made; without one it is unknown.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda method: F.struct(F.lit(UNKNOWN).alias("state"), F.lit("na").alias("ownership"), F.lit(0.0).alias("confidence"), method.alias("method"))
    via = lambda ok, method: F.when(ok, method).otherwise("none")
    rows = {
        "website": F.when(yes("site_ok"), _found(PRESENT, "owned_confirmed", 0.9, "website_fetch"))
        .when(has(F.col("site")), _found(UNKNOWN, "candidate_unverified", 0.2, "input"))
        .otherwise(none(F.lit("none"))),
        "linkedin_founder": none(F.lit("none")),
        "gbp": F.when(yes("places_ok") & (F.col("places") == PRESENT), _found(PRESENT, "owned_confirmed", 0.8, "places_api")).otherwise(none(via(yes("places_ok"), "places_api"))),
        "ad_library": F.when(yes("ads_ok") & (F.col("ads") == PRESENT), _found(PRESENT, "na", 0.8, "ad_library"))
        .when(yes("ads_ok") & (F.col("ads") == ABSENT), _found(ABSENT, "na", 0.7, "ad_library"))
        .otherwise(none(via(yes("ads_ok"), "ad_library"))),
        "ecommerce": F.when(yes("site_ok") & yes("shop"), _found(PRESENT, "owned_confirmed", 0.6, "website_markers")).otherwise(none(via(yes("site_ok"), "website_markers"))),
        "marketplace": none(F.lit("none")),
    }
    for channel, network in NETWORKS.items():
        at = lambda c: has(F.try_element_at(F.col(c), F.lit(network)))  # noqa: B023, E731
        rows[channel] = (
            F.when(yes("site_ok") & at("linked"), _found(PRESENT, "owned_confirmed", 0.85, "website_link"))
            .when(yes("search_ok") & at("searched"), _found(PRESENT, "candidate_unverified", 0.6, "social_search"))
            .when(yes("search_ok") & F.coalesce(F.array_contains("missing", network), F.lit(False)), _found(ABSENT, "na", 0.5, "social_search"))
            .otherwise(none(via(yes("search_ok"), "social_search")))
        )
    long = F.array(*[F.struct(F.lit(c).alias("channel"), rows[c].alias("x")) for c in CHANNELS])
    return answers.select("seq", F.explode(long).alias("c")).select("seq", "c.channel", "c.x.*")


def surface_states(channels: DataFrame) -> DataFrame:
    """(seq, key, state) of each surface that channels speak for: present if one is, else absent if one is, else unknown."""
    key = F.lit(None).cast("string")
    for channel, surface in CHANNELS.items():
        key = F.when(F.col("channel") == channel, surface).otherwise(key)
    state = F.when(F.bool_or(F.col("state") == PRESENT), PRESENT).when(F.bool_or(F.col("state") == ABSENT), ABSENT).otherwise(UNKNOWN)
    return channels.groupBy("seq", key.alias("key")).agg(state.alias("state"))


def all_signals(companies: DataFrame, signals: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(seq, axis, key, state): the collected signals, and each dimension without one as unknown, a surface as absent where
    the footprint found it so. companies has one row a company; repeated signals stay."""
    keys = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(k).alias("key")) for a, ks in (("A", DIMENSIONS), ("B", SURFACES)) for k in ks])
    one = F.struct(*[F.col(c).cast("string").alias(c) for c in ("axis", "key", "state")])
    none = lambda c: F.lit(None).cast(c)
    kind = "struct<axis:string,key:string,state:string>"
    # A company's few rows meet in one group, and its dimensions are written out after that.
    rows = companies.select("seq", F.lit(True).alias("own"), none(kind).alias("signal"), none("string").alias("gone"))
    rows = rows.unionByName(signals.select("seq", F.lit(False).alias("own"), one.alias("signal"), none("string").alias("gone")))
    rows = rows.unionByName(surfaces.filter(F.col("state") == ABSENT).select("seq", F.lit(False).alias("own"), none(kind).alias("signal"), F.col("key").alias("gone")))
    each = rows.groupBy("seq").agg(F.bool_or("own").alias("own"), F.collect_list("signal").alias("said"), F.collect_set("gone").alias("gone"))
    lacking = F.filter(keys, lambda k: ~F.exists("said", lambda s: (s["axis"] == k["axis"]) & (s["key"] == k["key"])))
    filled = F.transform(lacking, lambda k: F.struct(k["axis"].alias("axis"), k["key"].alias("key"), F.when((k["axis"] == "B") & F.array_contains("gone", k["key"]), ABSENT).otherwise(UNKNOWN).alias("state")))
    return each.select("seq", F.inline(F.concat("said", F.when(F.col("own"), filled).otherwise(F.array().cast(f"array<{kind}>")))))


def critic(verdicts: DataFrame, claims: DataFrame, signals: DataFrame) -> DataFrame:
    """(seq, flags, consistent, validation): whether a verdict (seq, a, b, confidence) follows from its claims.

    claims (seq, axis, key, graded, citations) are graded unless evidence was insufficient. Flags: a claim that cites the other
    axis, one without any known signal of its key, one without citations, an axis whose signals are mostly unknown or
    missing, a missing axis score. A null of citations is none.
    """
    known = signals.filter(F.col("state") != UNKNOWN).select("seq", "axis", "key").distinct().withColumn("known", F.lit(True))
    cited = F.coalesce("citations", F.array().cast("array<string>"))
    other = F.when(F.col("axis") == "A", "signal_b:").otherwise("signal_a:")
    judged = claims.join(known, ["seq", "axis", "key"], "left").groupBy("seq").agg(
        F.max(F.exists(cited, lambda c: c.startswith(other)).cast("int")).alias("breach"),
        F.count_if(F.col("graded") & F.col("known").isNull()).alias("invented"),
        F.count_if(F.col("graded") & (F.size(cited) == 0)).alias("uncited"),
    )
    share = lambda axis: F.coalesce(F.try_divide(F.count_if((F.col("axis") == axis) & (F.col("state") != UNKNOWN)), F.count_if(F.col("axis") == axis)), F.lit(0.0)) < LEAST_COVERAGE
    thin = signals.groupBy("seq").agg((share("A") | share("B")).alias("thin"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = verdicts.join(judged, "seq", "left").join(thin, "seq", "left").withColumn("lost", (F.col("a").isNull() | F.col("b").isNull()).cast("int"))
    rows = rows.withColumn("thin", F.coalesce("thin", F.lit(True)).cast("int"))
    critical = n("breach") + n("invented") + F.col("lost")
    penalty = 0.4 * critical + 0.1 * (n("uncited") + F.col("thin"))
    return rows.select("seq", (critical + n("uncited") + F.col("thin")).cast("bigint").alias("flags"), (critical == 0).alias("consistent"), round_up(clamp(F.least(F.col("confidence"), 1 - penalty)), 3).alias("validation"))
