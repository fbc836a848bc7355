"""The coverage cube: leads against the universe of firms, by division and province, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.numbers import clamp, percent, round_up
from leadloom.functions.text import has, key_text, slug
from leadloom.sources import tables

TARGET, MIN_SAMPLE, MIN_SAMPLE_REGION, BOOST = 0.6, 15, 30, 1.5
WEAK, TOP_PROVINCES, ITEMS, ENRICH_BELOW = 50.0, 4, 50, 50.0
FIELDS = ["website", "phone", "email", "pec", "vat"]


def classify(leads: DataFrame) -> DataFrame:
    """Adds division: of the crosswalk words that the category contains, the longest (then the first) decides."""
    cross = F.broadcast(tables.crosswalk(leads.sparkSession))  # a fixed table of a few dozen rows
    categories = leads.select("category").distinct()
    best = F.min_by("division", F.struct(-F.length("token"), "ord"))
    found = categories.join(cross, F.contains(key_text(F.col("category")), F.col("token"))).groupBy("category").agg(best.alias("division"))
    return leads.join(found, "category", "left")


def placed(leads: DataFrame) -> DataFrame:
    """Adds province code, region, macro area, division and the bucket: in_scope, out_of_scope or unclassified."""
    code = F.upper(F.trim(F.coalesce("province", F.lit(""))))
    out = classify(leads.withColumn("province", code)).join(F.broadcast(tables.regions(leads.sparkSession)), "province", "left")
    bucket = F.when(F.col("region").isNull(), "out_of_scope").when(F.col("division").isNull(), "unclassified").otherwise("in_scope")
    return out.withColumn("bucket", bucket)


def buckets(leads: DataFrame) -> DataFrame:
    """(bucket, key, n): nothing is dropped; leads out of scope by province, unclassified ones by category."""
    key = F.when(F.col("bucket") == "out_of_scope", F.when(F.col("province") == "", "—").otherwise(F.col("province"))).when(
        F.col("bucket") == "unclassified", F.when(has(F.col("category")), F.trim("category")).otherwise("sconosciuto")
    )
    return placed(leads).groupBy("bucket", F.coalesce(key, F.lit("all")).alias("key")).agg(F.count("*").alias("n"))


def universe_by_cell(spark) -> DataFrame:
    """(division, province, firms, provenance): divisions of one sector share the sum of the sector's universe."""
    groups = tables.sectors(spark)
    known = tables.universe(spark)
    single = known.select("division", F.col("division").alias("member")).distinct().join(groups.select("division").distinct(), "division", "left_anti")
    every = groups.unionByName(single).join(known.withColumnRenamed("division", "member"), "member")
    provenance = F.when(F.bool_or(F.col("provenance") == "sample"), "sample").otherwise("istat-asia")
    return every.groupBy("division", "province").agg(F.sum("active_firms").alias("firms"), provenance.alias("provenance"))


def _metrics(cells: DataFrame, least: int) -> DataFrame:
    """Coverage, needs and priority of cells that have have and addressable."""
    sample_ok = F.col("have") >= least
    need = F.greatest(F.lit(0), F.ceil(F.lit(TARGET) * F.col("addressable")) - F.col("have"))
    need_sample = F.greatest(F.lit(0), F.lit(least) - F.col("have"))
    priority = F.col("need_for_target") * F.when(F.col("sample_ok"), 1.0).otherwise(BOOST) + F.when(F.col("sample_ok"), 0).otherwise(F.col("need_for_sample"))
    return (
        cells.withColumn("coverage", round_up(clamp(F.col("have") / F.col("addressable")), 3))
        .withColumn("sample_ok", sample_ok)
        .withColumn("need_for_target", F.when(F.col("addressable").isNotNull(), need))
        .withColumn("need_for_sample", need_sample.cast("bigint"))
        .withColumn("priority", round_up(priority, 2))
    )


def cells(leads: DataFrame) -> DataFrame:
    """The cube: one row for each division and province with leads in scope."""
    spark = leads.sparkSession
    fields = {"website": has(F.col("website")), "phone": has(F.col("phone")), "email": has(F.col("email")), "pec": F.coalesce(F.col("email_status") == "pec", F.lit(False)), "vat": has(F.col("vat_code"))}
    counts = [F.count_if(c).alias(f"with_{k}") for k, c in fields.items()]
    grouped = placed(leads).filter("bucket = 'in_scope'").groupBy("macro_area", "region", "division", "province").agg(F.count("*").alias("have"), *counts)
    section = F.lit(None).cast("string")
    for division, s in tables.SECTIONS.items():
        section = F.when(F.col("division") == division, s).otherwise(section)
    factor = F.lit(tables.DEFAULT_FACTOR)
    for s, f in tables.FACTORS.items():
        factor = F.when(section == s, f).otherwise(factor)
    out = grouped.join(F.broadcast(universe_by_cell(spark)), ["division", "province"], "left")
    out = out.withColumn("addressable", F.when(F.col("firms").isNotNull(), F.greatest(F.lit(1), F.floor(F.col("firms") * factor + 0.5))))
    for k in FIELDS:
        out = out.withColumn(f"{k}_pct", percent(F.col(f"with_{k}"), F.col("have")))
    out = out.withColumn("enrichment", round_up(sum((F.col(f"{k}_pct") for k in FIELDS), F.lit(0.0)) / 5, 1))
    return _metrics(out, MIN_SAMPLE)


def region_rollup(cube: DataFrame) -> DataFrame:
    """By region and division: sums, and means of the cells' rounded fill rates weighted by their leads."""
    rates = [round_up(F.sum(F.col(f"{k}_pct") * F.col("have")) / F.sum("have"), 1).alias(f"{k}_pct") for k in FIELDS]
    out = cube.groupBy("macro_area", "region", "division").agg(F.sum("have").alias("have"), F.sum("addressable").alias("addressable"), F.count("*").alias("cells"), *rates)
    return _metrics(out, MIN_SAMPLE_REGION)


def hierarchy(cube: DataFrame) -> DataFrame:
    """(macro_area, region, division, level, have): totals of every level by ROLLUP."""
    level = F.grouping_id().alias("level")
    return cube.rollup("macro_area", "region", "division").agg(level, F.sum("have").alias("have"))


def backlog(cube: DataFrame, items: int = ITEMS) -> DataFrame:
    """Ranked actions: scrape where coverage or sample falls short, by priority; else enrich poor cells, by leads."""
    rank = F.row_number().over(Window.partitionBy("region", "division").orderBy(F.desc(F.coalesce("priority", F.lit(-1.0))), "province"))
    weak_places = cube.withColumn("r", rank).filter(F.col("r") <= TOP_PROVINCES).groupBy("region", "division")
    weak_places = weak_places.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "province"))), lambda x: x["province"]), ",").alias("provinces"))
    roll = region_rollup(cube)
    score = round_up(sum((F.col(f"{k}_pct") for k in FIELDS), F.lit(0.0)) / 5, 1)
    short = F.coalesce(F.col("need_for_target") > 0, F.lit(False)) | ~F.col("sample_ok")
    action = F.when(short, "scrape").when(score < ENRICH_BELOW, "enrich")
    weak = F.array_join(F.filter(F.array(*[F.when(F.col(f"{k}_pct") < WEAK, F.lit(k)) for k in FIELDS]), lambda x: x.isNotNull()), ",")
    rows = roll.join(weak_places, ["region", "division"]).withColumn("action", action).filter("action is not null").withColumn("weak_fields", weak)
    order = [F.when(F.col("action") == "scrape", 0).otherwise(1), F.desc(F.when(F.col("action") == "scrape", F.coalesce("priority", F.lit(-1.0))).otherwise(F.col("have"))), F.col("region"), F.col("division")]
    cut = rows.orderBy(*order).limit(items)  # the backlog is a top list by definition
    return cut.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "action", "region", "division", "have", "priority", "provinces", "weak_fields", slug(F.concat_ws("_", "division", "region")).alias("slug"))
