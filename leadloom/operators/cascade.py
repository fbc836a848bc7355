"""Field cascades and ladders: ordered steps with costs, of which the first good enough decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Confidence that stops a field's cascade, and its ceiling in euros.
FIELDS = {"vat": (0.6, 0.0), "email": (0.75, 0.05), "pec": (0.8, 0.0), "revenue": (0.7, 0.0), "employees": (0.6, 0.0), "decision_maker": (0.6, 0.15)}
#: Reasons that any better one replaces.
GENERIC = ["DISCOVERY_EXHAUSTED", "NOT_FOUND_NO_CANDIDATES"]


def run_cascade(steps: DataFrame, paid: bool = False) -> DataFrame:
    """(lead, field, value, confidence, cost, tried) from (lead, field, ord, enabled, tier, cost, value, confidence).

    Steps run in order while nothing has stopped the cascade: disabled ones and, unless paid, those of tier two and up
    don't run; a costed step runs only if it fits what the ceiling leaves. What earlier costed steps spent depends on
    which of them ran, so the steps of one field (a handful) are folded in order.
    """
    limits = F.create_map(*[x for f, (stop, ceiling) in FIELDS.items() for x in (F.lit(f), F.struct(F.lit(stop).alias("stop"), F.lit(ceiling).alias("ceiling")))])
    limit = limits[F.col("field")]
    fields = ["ord", "enabled", "tier", "cost", "value", "confidence"]
    listed = steps.groupBy("lead", "field").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).alias("tried"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit(False).alias("done"))

    def step(acc, s):
        runs = ~acc["done"] & s["enabled"] & ((s["tier"] < 2) | F.lit(paid)) & ((s["cost"] <= 0) | (acc["spent"] + s["cost"] <= limit["ceiling"]))
        good = runs & s["value"].isNotNull() & (s["confidence"] >= limit["stop"])
        return F.struct(
            (acc["spent"] + F.when(runs, s["cost"]).otherwise(0.0)).alias("spent"),
            (acc["tried"] + runs.cast("int")).alias("tried"),
            F.when(good, s["value"]).otherwise(acc["value"]).alias("value"),
            F.when(good, s["confidence"]).otherwise(acc["confidence"]).alias("confidence"),
            (acc["done"] | F.coalesce(good, F.lit(False))).alias("done"),
        )

    out = listed.select("lead", "field", F.aggregate("steps", start, step).alias("r"))
    return out.select("lead", "field", "r.value", "r.confidence", F.col("r.spent").alias("cost"), "r.tried")


def ladder_status(outcomes: DataFrame) -> DataFrame:
    """(lead, status, stage, reason) from (lead, ord, stage, found, reason): the first stage that found a site, else the
    first informative reason, else the last one."""
    found = F.col("found")
    own = outcomes.groupBy("lead").agg(
        F.min_by("stage", F.when(found, F.col("ord"))).alias("stage"),
        F.bool_or(found).alias("any"),
        F.min_by("reason", F.when(F.col("reason").isNotNull() & ~F.col("reason").isin(GENERIC), F.col("ord"))).alias("first"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("ord"))).alias("last"),
    )
    reason = F.when(F.col("any"), "FOUND_WEBSITE_ONLY").otherwise(F.coalesce("first", "last", F.lit("DISCOVERY_EXHAUSTED")))
    return own.select("lead", F.when(F.col("any"), "FOUND_WEBSITE_ONLY").otherwise("NOT_FOUND").alias("status"), F.when(F.col("any"), F.col("stage")).alias("stage"), reason.alias("reason"))


def fresh(cache: DataFrame, now: str, days: dict[str, int]) -> DataFrame:
    """Cache rows that their source's time to live still covers; sources without one never expire."""
    ttl = F.create_map(*[x for s, d in days.items() for x in (F.lit(s), F.lit(d))])[F.col("source")]
    return cache.filter(ttl.isNull() | (F.col("at") >= F.expr(f"timestamp '{now}'") - F.make_dt_interval(ttl)))


def retained(jobs: DataFrame, now_ms: int, ttl_ms: int = 3_600_000, most: int = 200) -> DataFrame:
    """Running jobs, and finished ones within their time to live, the newest of them up to a number (a retention rule)."""
    live = jobs.filter((F.col("status") == "running") | (F.lit(now_ms) - F.coalesce("finished_at", F.lit(-(1 << 62))) <= ttl_ms))
    rank = F.row_number().over(Window.partitionBy("status_group").orderBy(F.desc("finished_at"), "id"))
    grouped = live.withColumn("status_group", F.col("status") == "running").withColumn("rank", rank)
    return grouped.filter(F.col("status_group") | (F.col("rank") <= most)).drop("status_group", "rank")
