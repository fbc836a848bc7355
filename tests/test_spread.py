"""Work is dealt out by rows, and no growing side goes through the driver."""

from __future__ import annotations

from leadloom.operators import judgment
from leadloom.plans import parsed, queries, views
from leadloom.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_customers_are_dealt_out(spark):
    assert parsed._customers(spark, SMALL).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted(tables.dealt(spark.range(9)).collect()) == sorted(spark.range(9).collect())


def test_years_and_customers_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in parsed._yearly(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_signals_stay_and_the_rest_is_written_out(spark):
    companies = spark.createDataFrame([(1,), (2,)], "seq long")
    signals = spark.createDataFrame([(1, "A", "2.1", "x"), (1, "A", "2.1", "x"), (1, "A", "9", "y"), (3, "B", "3.1", "z")], "seq long, axis string, key string, state string")
    surfaces = spark.createDataFrame([(1, "3.2", judgment.ABSENT), (2, "3.1", judgment.PRESENT), (3, "3.2", judgment.ABSENT)], "seq long, key string, state string")
    out = judgment.all_signals(companies, signals, surfaces)
    rows = [tuple(r) for r in out.collect()]
    n = len(judgment.DIMENSIONS) + len(judgment.SURFACES)
    assert [r for r in rows if r[0] == 3] == [(3, "B", "3.1", "z")] and rows.count((1, "A", "2.1", "x")) == 2 and rows.count((1, "A", "9", "y")) == 1
    assert sum(r[0] == 1 for r in rows) == n - 1 + 3 and sum(r[0] == 2 for r in rows) == n
    assert [r for r in rows if r[3] == judgment.ABSENT] == [(1, "B", "3.2", judgment.ABSENT)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # one shuffle of a company's few rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_addresses_are_made_after_dealing(spark):
    above, below = plan_of(views.q_website_candidates(spark, SMALL)).split("REPARTITION_BY_NUM")
    assert "regexp_extract" in above and "regexp_extract" not in below


def test_words_of_a_name_are_made_once_after_dealing(spark):
    above, below = plan_of(queries.q_domain_candidates(spark, SMALL)).split("REPARTITION_BY_NUM")
    assert above.count("srls, 1)") == 1 and "srls, 1)" not in below
    ranked = plan_of(queries.q_candidate_rank(spark, SMALL))
    assert ranked.count("srls, 1)") == 2  # of the candidates and of the leads they are held against
