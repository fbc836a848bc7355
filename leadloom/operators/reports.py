"""Dashboard aggregates, provider ledger, evaluation, category profiles, judgment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.numbers import clamp, percent, round_up
from leadloom.functions.text import has

#: Judgment thresholds.
HIGH, MID, TARGET_A, TARGET_GAP, BORDER = 0.66, 0.40, 0.60, 0.30, 0.10
#: Levels of evidence on axis A and states on axis B.
LEVELS_A = {"strong": 1.0, "moderate": 0.6, "weak": 0.15}
STATES_B = {"excellence": 1.0, "mediocrity": 0.45, "absence": 0.05}


def fill_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, total, pct): one pass over the rows."""
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(has(F.col(f).cast("string"))).alias(f) for f in fields])
    long = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    return one.select(F.explode(long).alias("x"), "total").select("x.field", "x.filled", "total", percent(F.col("x.filled"), F.col("total")).alias("pct"))


def export_columns(rows: DataFrame, fields: list[str], least_pct: float) -> list[str]:
    """Fields whose fill rate exceeds the threshold, from one aggregate row."""
    return [r.field for r in fill_rates(rows, fields).filter(F.col("pct") > least_pct).collect()]


def tally(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("<unset>")).alias("value")).agg(F.count("*").alias("n"))


def by_province(leads: DataFrame) -> DataFrame:
    key = F.coalesce(F.when(has(F.col("province")), F.trim("province")), F.lit("(none)"))
    return leads.groupBy(key.alias("province")).agg(F.count("*").alias("n"), F.count_if(has(F.col("website"))).alias("with_site"))


def markets(leads: DataFrame) -> DataFrame:
    """By category: leads, distinct provinces, and the province with most leads (ties: the first by name)."""
    each = leads.filter(has(F.col("province"))).groupBy("category", "province").agg(F.count("*").alias("n"))
    top = each.groupBy("category").agg(F.min_by("province", F.struct(-F.col("n"), "province")).alias("top_province"), F.count("*").alias("provinces"))
    return leads.groupBy("category").agg(F.count("*").alias("n")).join(top, "category", "left")


def page(leads: DataFrame, limit: int, offset: int, with_site: bool | None = None) -> DataFrame:
    """A page in input order."""
    rows = leads if with_site is None else leads.filter(has(F.col("website")) == with_site)
    return rows.orderBy("seq").offset(offset).limit(min(limit, 2000))


def _exact() -> Column:
    """Costs as decimals, so that sums don't depend on the order of rows."""
    return F.col("cost_eur").cast("decimal(18,6)")


def _cost(total: Column) -> Column:
    return round_up(total.cast("double"), 4)


def ledger_by_provider(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("provider").agg(
        F.count("*").alias("calls"),
        _cost(F.sum(_exact())).alias("cost_eur"),
        percent(F.count_if("success"), F.count("*")).alias("success_pct"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("timeout", "empty", "blocked")],
    )


def dead_providers(ledger: DataFrame, least_calls: int = 10) -> DataFrame:
    """Providers with enough calls and no success, with their most frequent failure."""
    kinds = ledger.groupBy("provider", "kind").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    out = kinds.groupBy("provider").agg(F.sum("n").alias("calls"), F.sum("ok").alias("ok"), F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("main_kind"))
    return out.filter((F.col("calls") >= least_calls) & (F.col("ok") == 0)).select("provider", "calls", "main_kind")


def cost_per_lead(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("lead_id").agg(F.count("*").alias("calls"), _cost(F.sum(_exact())).alias("cost_eur"))


def running_budget(ledger: DataFrame, cap: float) -> DataFrame:
    """(seq, lead_id, spent, within): each call's cumulative cost for its lead, and whether the cap still held."""
    w = Window.partitionBy("lead_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    spent = _cost(F.sum(_exact()).over(w))
    return ledger.select("seq", "lead_id", spent.alias("spent"), (spent <= cap).alias("within"))


def yield_anomalies(runs: DataFrame, share: float = 0.3) -> DataFrame:
    """(category, run, yield, mean, suspect): the last run of each category against the mean of its earlier positive ones."""
    last = Window.partitionBy("category").orderBy(F.desc("run"))
    ranked = runs.withColumn("r", F.row_number().over(last))
    history = ranked.filter("r > 1 and yield > 0").groupBy("category").agg(F.avg("yield").alias("mean"))
    out = ranked.filter("r = 1").join(history, "category", "left")
    return out.select("category", "run", "yield", round_up(F.col("mean"), 3).alias("mean"), F.coalesce(F.col("yield") < share * F.col("mean"), F.lit(False)).alias("suspect"))


def stalls(runs: DataFrame, least: int) -> DataFrame:
    """(category, from_run, length): stretches of runs without any yield, by sums of the runs that had one."""
    w = Window.partitionBy("category").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    island = runs.withColumn("island", F.sum(F.when(F.col("yield") > 0, 1).otherwise(0)).over(w)).filter("yield = 0")
    return island.groupBy("category", "island").agg(F.min("run").alias("from_run"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("island")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def evaluation(pairs: DataFrame) -> DataFrame:
    """(n, accuracy, precision, recall, f1) of 0/1 predictions."""
    tp, fp, fn = (F.count_if((F.col("predicted") == p) & (F.col("expected") == e)).cast("double") for p, e in ((1, 1), (1, 0), (0, 1)))
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    agree = F.count_if(F.col("predicted") == F.col("expected")) / F.count("*")
    return pairs.agg(F.count("*").alias("n"), *[round_up(c, 4).alias(k) for k, c in (("accuracy", agree), ("precision", precision), ("recall", recall), ("f1", f1))])


def category_profile(signals: DataFrame, least: int = 8) -> DataFrame:
    """(category, companies, presence, p50, p90, provisional): nearest-rank p90 from counts of each value."""
    companies = signals.groupBy("category").agg(F.count_distinct("company").alias("companies"), F.count_distinct(F.when(F.col("present"), F.col("company"))).alias("with_any"))
    values = signals.filter("value is not null").groupBy("category", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category")
    placed = values.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("all", F.sum("n").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2
    quant = placed.groupBy("category").agg(round_up(middle, 3).alias("p50"), at(F.floor(0.9 * (F.col("all") - 1) + 0.5)).alias("p90"))
    out = companies.join(quant, "category", "left")
    return out.select("category", "companies", round_up(F.col("with_any") / F.col("companies"), 3).alias("presence"), "p50", "p90", (F.col("companies") < least).alias("provisional"))


def _level(score: Column) -> Column:
    return F.when(score >= HIGH, "+").when(score >= MID, "?").when(score.isNotNull(), "-").otherwise("unknown")


def judge(signals: DataFrame) -> DataFrame:
    """(company, a, b, quadrant, target, confidence) from (company, axis, dimension, state, weight).

    An axis is the weighted mean over known dimensions; unknown ones leave the denominator and lower the coverage.
    """
    value = F.lit(None).cast("double")
    for state, v in {**LEVELS_A, **STATES_B}.items():
        value = F.when(F.col("state") == state, v).otherwise(value)
    rows = signals.withColumn("value", value)
    mean = lambda axis: F.sum(F.when((F.col("axis") == axis) & F.col("value").isNotNull(), F.col("value") * F.col("weight"))) / F.sum(F.when((F.col("axis") == axis) & F.col("value").isNotNull(), F.col("weight")))
    known = lambda axis: F.count_if((F.col("axis") == axis) & F.col("value").isNotNull()) / F.greatest(F.lit(1), F.count_if(F.col("axis") == axis))
    out = rows.groupBy("company").agg(round_up(mean("A"), 3).alias("a"), round_up(mean("B"), 3).alias("b"), known("A").alias("ka"), known("B").alias("kb"))
    gap = F.col("a") - F.col("b")
    target = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "borderline")
        .when((F.col("a") < MID) & (F.col("b") >= HIGH), "no")
        .when((F.col("a") >= TARGET_A) & (gap >= TARGET_GAP), "yes")
        .when((F.col("a") >= TARGET_A - BORDER) & (gap >= TARGET_GAP - BORDER), "borderline")
        .otherwise("no")
    )
    confidence = round_up(clamp(0.3 + 0.7 * (F.col("ka") + F.col("kb")) / 2), 3)
    return out.select("company", "a", "b", F.concat(_level(F.col("a")), F.lit("/"), _level(F.col("b"))).alias("quadrant"), target.alias("target"), confidence.alias("confidence"))
