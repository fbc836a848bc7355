from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.operators import cascade, gates


def pair(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [
        ("Blurebus", "Blurebus Srl", True),
        ("Rossi Impianti", "Rossi Arredi", False),
        ("Immobiliare Giglio", "Immobiliare Giglio di Cecchinato Ornella", True),
        ("Immobiliare Nord Est Casa", "Immobiliare Nord Ovest Terra Mare", False),
        (None, "Rossi", False),
        ("", "", False),
    ],
)
def test_entity_guard(spark, a, b, wanted):
    assert pair(spark, gates.names_match, a, b) is wanted
    assert pair(spark, gates.wrong_entity, a, b) is not wanted


def test_category_match(spark):
    got = [pair(spark, gates.category_match, "agenzie immobiliari", t) for t in ("Studio immobiliari", "Ristorante", "", None)]
    assert got == ["confirmed", "mismatch", "unknown", "unknown"]


def test_off_target(spark):
    names = ["Taxi Rossi", "Traslochi Bianchi", "Traslochi e trasporto merci Verdi", "Autotrasporti Neri", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(gates.off_target(F.col("n"))).collect()] == [True, True, False, False, False]


def test_page_gate(spark):
    rows = [
        ("x", "https://a.it", "Rossi Impianti", "Este", None, None),
        ("P.IVA 076 435 20567 " + "." * 60, "https://a.it", "Rossi Impianti", "Este", "07643520567", None),
        ("chiama 0422/000177 " + "." * 60, "https://a.it", "Rossi Impianti", "Este", None, "+390422000177"),
        ("Benvenuti da Rossi Impianti Termici " + "." * 60, "https://www.rossiimpianti.it", "Rossi Impianti Termici", "Este", None, None),
        ("gli impianti di rossi a Este " + "." * 60, "https://www.altro.it", "Rossi Impianti", "Este", None, None),
        ("nulla " * 20, "https://www.altro.it", "Rossi Impianti", "Este", None, None),
    ]
    df = spark.createDataFrame(rows, "t string, u string, n string, c string, v string, p string")
    got = [r[0] for r in df.select(gates.page_gate(*map(F.col, "tuncvp"))).collect()]
    assert got == ["reject_tiny", "vat", "phone", "semantic_a", "anchor", "reject_no_evidence"]


def test_search_relevance(spark):
    rows = [("rossi impianti este", "Rossi Impianti", "", "u"), ("rossi impianti este", "x", "", "u"), ("bianchi verdi", "neri", "", "u")]
    got = {r["query"]: r.relevant for r in gates.search_relevant(spark.createDataFrame(rows, "query string, title string, snippet string, url string")).collect()}
    assert got == {"rossi impianti este": True, "bianchi verdi": False}


def test_cascade_order_ceiling_and_stop(spark):
    rows = [
        (1, "email", 1, False, 0, 0.0, "off", 1.0), (1, "email", 2, True, 0, 0.0, "weak", 0.5), (1, "email", 3, True, 1, 0.04, None, 0.0),
        (1, "email", 4, True, 1, 0.04, "dear", 0.9), (1, "email", 5, True, 2, 0.0, "paid", 0.9), (1, "email", 6, True, 0, 0.0, "good", 0.8), (1, "email", 7, True, 0, 0.0, "late", 0.9),
        (2, "vat", 1, True, 0, 0.0, None, 0.0),
    ]
    steps = spark.createDataFrame(rows, "lead int, field string, ord int, enabled boolean, tier int, cost double, value string, confidence double")
    got = {r.lead: (r.value, r.confidence, round(r.cost, 2), r.tried) for r in cascade.run_cascade(steps).collect()}
    assert got == {1: ("good", 0.8, 0.04, 3), 2: (None, 0.0, 0.0, 1)}


def test_ladder_status(spark):
    rows = [(1, 1, "input", False, "DIRECTORY_SITE"), (1, 2, "search", True, None), (2, 1, "input", False, "DISCOVERY_EXHAUSTED"), (2, 2, "guess", False, "PARKED"), (3, 1, "input", False, "NOT_FOUND_NO_CANDIDATES"), (4, 1, "input", False, None)]
    got = {r.lead: (r.status, r.stage, r.reason) for r in cascade.ladder_status(spark.createDataFrame(rows, "lead int, ord int, stage string, found boolean, reason string")).collect()}
    assert got == {1: ("FOUND_WEBSITE_ONLY", "search", "FOUND_WEBSITE_ONLY"), 2: ("NOT_FOUND", None, "PARKED"), 3: ("NOT_FOUND", None, "NOT_FOUND_NO_CANDIDATES"), 4: ("NOT_FOUND", None, "DISCOVERY_EXHAUSTED")}


def test_time_to_live_and_retention(spark):
    cache = spark.sql("SELECT * FROM VALUES ('website', timestamp '2024-01-01'), ('website', timestamp '2024-01-09'), ('registry', timestamp '2000-01-01') t(source, at)")
    assert cascade.fresh(cache, "2024-01-10", {"website": 7}).count() == 2
    jobs = spark.createDataFrame([("a", "running", None), ("b", "done", 1000), ("c", "done", 900), ("d", "done", 1), ("e", "done", None)], "id string, status string, finished_at bigint")
    assert sorted(r.id for r in cascade.retained(jobs, 1000, 500, 1).collect()) == ["a", "b"]
