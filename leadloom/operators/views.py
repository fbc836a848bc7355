"""What the dashboard shows: company views, saved filters, searches, roll-ups of regions and towns, indicators, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.contact import digits
from leadloom.functions.numbers import round_up
from leadloom.functions.text import has, key_text
from leadloom.operators.score import quality
from leadloom.sources import tables

#: Fields that make a company complete, and the tier of each quadrant.
COMPLETE = ["official_website", "phone", "email_inferred", "pec", "vat_code_final", "revenue", "employees"]
TIERS = {"A-B+": "Tier C", "A?B+": "Tier B", "A+B+": "Tier A", "A-B?": "Tier C", "A?B?": "Tier C", "A+B?": "Tier B", "A-B-": "Tier D", "A?B-": "Tier D", "A+B-": "Tier C"}
NO_TIER, EMPTY = "Non giudicata", "n/d"
#: Saved views.
SAVED = ["tutte", "grezze", "arricchite", "giudicate", "target", "escluse"]
MIN_QUALITY = 0.3


def quality_gate(leads: DataFrame) -> DataFrame:
    """All leads with quality and status: SKIPPED below the least quality, else PENDING."""
    return leads.withColumn("quality", quality()).withColumn("status", F.when(F.col("quality") < MIN_QUALITY, "SKIPPED").otherwise("PENDING"))


def revenue_millions(text: Column) -> Column:
    """All digits of a text in millions with a decimal; 0 without digits."""
    d = digits(text)
    return F.coalesce(F.when(d != "", round_up(d.cast("double") / 1e6, 1)), F.lit(0.0))


def mean_employees(text: Column) -> Column:
    """Mean of the numbers of a text, so that a range gives its middle; 0 without."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(F.size(numbers) > 0, F.floor(total / F.size(numbers) + 0.5)), F.lit(0)).cast("bigint")


def company_view(leads: DataFrame) -> DataFrame:
    """One row for each lead as lists show it; quadrant (as A+B-) and target may be null, of a field only null and the empty text are missing."""
    share = sum(((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in COMPLETE if c in leads.columns), F.lit(0)) / len(COMPLETE)
    tier = F.lit(NO_TIER)
    for quadrant, name in TIERS.items():
        tier = F.when(F.col("quadrant") == quadrant, name).otherwise(tier)
    maturity = (
        F.when(F.col("target") == "yes", "Target").when(F.col("share") >= 0.7, "Qualificata").when((F.col("share") >= 0.4) | (F.coalesce(F.col("official_website"), F.lit("")) != ""), "Arricchita").when(F.col("share") > 0.15, "Grezza").otherwise("Base")
    )
    return leads.withColumn("share", share).select(
        "seq",
        F.coalesce("company_name", F.lit(EMPTY)).alias("name"),
        F.coalesce("city", "province", F.lit(EMPTY)).alias("town"),
        F.coalesce("category", F.lit(EMPTY)).alias("sector"),
        revenue_millions(F.col("revenue")).alias("revenue_m"),
        mean_employees(F.col("employees")).alias("staff"),
        maturity.alias("maturity"),
        F.floor(F.col("share") * 100 + 0.5).alias("complete_pct"),
        tier.alias("tier"),
        F.coalesce(F.col("target") == "no", F.lit(False)).alias("excluded"),
    )


def in_view(view: str) -> Column:
    """Whether a row of company_view belongs to a saved view."""
    m = F.col("maturity")
    return {"tutte": F.lit(True), "grezze": m.isin("Base", "Grezza"), "arricchite": m == "Arricchita", "giudicate": F.col("tier") != NO_TIER, "target": m == "Target", "escluse": F.col("excluded")}[view]


def view_counts(view: DataFrame) -> DataFrame:
    """(saved, n) of all saved views in one pass."""
    one = view.agg(*[F.count_if(in_view(v)).alias(v) for v in SAVED])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("saved"), F.col(v).alias("n")) for v in SAVED])))


def search_view(view: DataFrame, saved: str, text: str) -> DataFrame:
    """Rows of a saved view that hold a text, in any case."""
    shown = F.lower(F.concat_ws(" ", "name", "town", "sector", "tier"))
    return view.filter(in_view(saved) & F.contains(shown, F.lit(text.strip().lower())))


def palette(leads: DataFrame, text: str, most: int = 8) -> DataFrame:
    """The first leads whose name, town or tax code hold a text of 2 or more letters."""
    wanted = key_text(F.lit(text))
    shown = key_text(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("company_name", "city", "vat_code_final")]))
    return leads.filter((F.length(wanted) >= 2) & F.contains(shown, wanted)).orderBy("seq").limit(most)  # a short list by definition


def map_intensity(coverage: Column, firms: Column, recent: Column, mode: str) -> Column:
    """0 to 100 under one of seven map modes; an unknown mode shows the coverage."""
    whole = lambda c: F.floor(c + 0.5)
    n = F.coalesce(firms, F.lit(0))
    modes = {
        "profondita": whole(coverage * 0.72),
        "fatturato": whole(coverage * 0.6),
        "target": whole(coverage * 0.46),
        "settori": F.when(coverage > 0, F.least(F.lit(100), whole(coverage * 0.9 + 10))).otherwise(0),
        "recenza": F.coalesce(recent, F.lit(0)),
        "opportunita": F.when(n == 0, 0).otherwise(F.least(F.lit(100), whole((100 - coverage) * 0.55 + n / 1400))),
    }
    return modes.get(mode, coverage).cast("double")


def region_view(leads: DataFrame) -> DataFrame:
    """(region, n, with_site, coverage, provinces, markets): provinces that have leads, distinct categories with none as one."""
    placed = leads.withColumn("province", F.upper(F.trim("province"))).join(F.broadcast(tables.regions(leads.sparkSession)), "province")
    out = placed.groupBy("region").agg(
        F.count("*").alias("n"), F.count_if(has(F.col("website"))).alias("with_site"), F.count_distinct("province").alias("provinces"), F.count_distinct(F.coalesce("category", F.lit(""))).alias("markets")
    )
    return out.select("region", "n", "with_site", F.floor(100 * F.col("with_site") / F.col("n") + 0.5).alias("coverage"), "provinces", "markets")


def town_view(leads: DataFrame, province: str) -> DataFrame:
    """(city, n, with_site, top_category) of a province; of categories equally frequent the one seen first."""
    own = leads.filter(F.upper(F.coalesce("province", F.lit(""))) == province.upper())
    each = own.groupBy(F.coalesce("city", F.lit("")).alias("city"), F.coalesce("category", F.lit("")).alias("category"))
    each = each.agg(F.count("*").alias("c"), F.count_if(F.coalesce("official_website", F.lit("")) != "").alias("s"), F.min("seq").alias("first"))
    return each.groupBy("city").agg(F.sum("c").alias("n"), F.sum("s").alias("with_site"), F.max_by("category", F.struct("c", -F.col("first"))).alias("top_category"))


def indicators(rates: DataFrame, judged: DataFrame) -> DataFrame:
    """(completeness, target_rate, unknown_rate) from fill rates (pct) and judged rows (target, quadrant); null where there is nothing."""
    mean = rates.agg(F.floor(F.avg("pct") + 0.5).alias("completeness"))
    rate = lambda c, n: F.when(n > 0, F.floor(1000 * c / n + 0.5) / 10)
    n, quad = F.count_if(F.col("target").isNotNull()), F.count("quadrant")
    shares = judged.agg(rate(F.count_if(F.col("target") == "yes"), n).alias("target_rate"), rate(F.count_if(F.contains("quadrant", F.lit("?"))), quad).alias("unknown_rate"))
    return mean.join(shares, F.lit(True))  # one row each


def consolidation(gross: DataFrame, unique: DataFrame, fields: list[str], origin: str = "source") -> DataFrame:
    """(origin, gross, kept, <field>...): rows handed over and kept by origin, filled fields of the kept, and all in the row '(all)'."""
    all_ = F.coalesce(F.col(origin), F.lit("OTHER"))
    label = F.when(F.grouping("o") == 1, "(all)").otherwise(F.col("o")).alias("origin")
    counted = lambda df, *aggs: df.withColumn("o", all_).rollup("o").agg(label, *aggs).drop("o")
    kept = counted(unique, F.count("*").alias("kept"), *[F.count_if(has(F.col(f))).alias(f) for f in fields])
    out = counted(gross, F.count("*").alias("gross")).join(kept, "origin", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["kept", *fields]]
    return out.select("origin", "gross", *zero).withColumn("dedup_ratio", round_up(1 - F.col("kept") / F.col("gross"), 3))


def gate_outcome(rows: DataFrame) -> DataFrame:
    """One row from (directory, allow, truth): what a gate behind the directory filter keeps of labelled gains; a null allow is a
    page that could not be had and is rejected."""
    allowed = ~F.coalesce("directory", F.lit(False)) & F.coalesce("allow", F.lit(False))
    count = lambda c: F.count_if(c)
    tp, fp = F.coalesce(F.col("truth") == "TP", F.lit(False)), F.coalesce(F.col("truth") == "FP", F.lit(False))
    out = rows.agg(
        count(allowed).alias("allowed"), count(~allowed).alias("rejected"), F.count_if("directory").alias("directory"),
        count(allowed & tp).alias("tp_kept"), count(~allowed & tp).alias("tp_lost"), count(allowed & fp).alias("fp_kept"), count(~allowed & fp).alias("fp_caught"),
    )
    share = lambda n: F.when(n > 0, F.col("tp_kept") / n).otherwise(0.0)
    return out.withColumns({"precision": round_up(share(F.col("allowed")), 3), "recall": round_up(share(F.col("tp_kept") + F.col("tp_lost")), 3)})


def latest(history: DataFrame, key: str, year: str, *values: str) -> DataFrame:
    """The values of the largest year of each key that has any of them; ties take the largest values."""
    known = history.filter(F.coalesce(*[F.col(v).isNotNull() for v in values]) & F.col(year).isNotNull())
    best = known.groupBy(key).agg(F.max(F.struct(year, *values)).alias("best"))
    return best.select(key, "best.*")


def last_runs(runs: DataFrame, order: str, most: int = 50) -> DataFrame:
    """The newest runs first, as the list shows them."""
    return runs.orderBy(F.desc(order)).limit(most)


def provider_plan(steps: DataFrame, most: int) -> DataFrame:
    """(field, provider, place): the first providers of each field by tier, then in the caller's order."""
    w = Window.partitionBy("field").orderBy("tier", "ord")  # a field has a handful of providers
    return steps.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("field", "provider", "place")


def once_per_record(records: DataFrame, *keys: Column) -> DataFrame:
    """The first record of each key; the key is the first of keys that is not null, and records without any all stay."""
    keyed = records.withColumn("_key", F.coalesce(*keys))
    whole = F.struct(*[F.col(c) for c in records.columns])
    first = keyed.filter("_key is not null").groupBy("_key").agg(F.min_by(whole, "rec").alias("r")).select("r.*")
    return first.unionByName(keyed.filter("_key is null").drop("_key"))


def join_verdicts(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Leads with the verdict of their address in any case (email, verdict); each address is asked for once, so one row answers many leads."""
    known = verdicts.groupBy(F.lower(F.trim("email")).alias("_mail")).agg(F.min("verdict").alias("verdict"))
    return leads.withColumn("_mail", F.lower(F.trim("email"))).join(known, "_mail", "left").drop("_mail")


def distinct_addresses(leads: DataFrame) -> DataFrame:
    """Addresses to ask for, once each."""
    return leads.filter(has(F.col("email"))).select(F.lower(F.trim("email")).alias("email")).distinct()
