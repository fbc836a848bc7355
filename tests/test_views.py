"""Websites, names, mailboxes, views and judgment: cases by hand, and every query against its SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.operators import judgment, people, views, website
from leadloom.plans import queries
from leadloom.plans import views as plans
from tests.test_queries import SMALL, db, plain  # noqa: F401

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == plans.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):  # noqa: F811
    got = queries.QUERIES[name](spark, str(SMALL)).toPandas()
    assert plain(got) == plain(db.execute(queries.ORACLES[name]).df())


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<int>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_website_candidates(spark):
    got = one(spark, website.website_candidates(F.col("u")), u="http://www.rossi.it/chi-siamo/")
    assert got == [
        "http://www.rossi.it/chi-siamo", "http://www.rossi.it", "https://www.rossi.it/chi-siamo", "https://www.rossi.it",
        "http://rossi.it/chi-siamo", "http://rossi.it", "https://rossi.it/chi-siamo", "https://rossi.it",
    ]
    assert one(spark, website.website_candidates(F.col("u")), u="https://shop.rossi.it") == ["https://shop.rossi.it", "https://www.shop.rossi.it", "https://rossi.it", "https://www.rossi.it"]
    for bad in (None, "", "x", "wa.me/1", "facebook.com/x", "https://-a.it"):
        assert one(spark, website.website_candidates(F.col("u")), u=bad) == []


@pytest.mark.parametrize("url, name, owned", [("immobiliareziero.it", "Immobiliare Ziero", True), ("agenziaimmobiliare.it", "Agenzia Immobiliare", False), (None, "Ziero", False), ("ziero.it", None, False)])
def test_domain_has_name(spark, url, name, owned):
    assert one(spark, website.domain_has_name(F.col("u"), F.col("n")), u=url, n=name) is owned


def test_contact_links(spark):
    html = """<a href="/contatti?x=1">C</a><a class=k href='https://www.rossi.it/contatti/'>again</a><a href="mailto:a@b.it">contact</a>
      <A HREF="info.html"><b>Chi siamo</b></A><a href="https://other.it/contact">x</a><a href="/">contact</a><a href="about">a</a><a href="azienda">b</a>"""
    link = website.contact_links(F.col("h"), F.col("s"))
    assert one(spark, link, h=html, s="https://www.rossi.it/") == ["https://www.rossi.it/contatti", "https://www.rossi.it/info.html", "https://www.rossi.it/about"]
    assert one(spark, link, h=None, s="https://www.rossi.it/") == [] and one(spark, link, h=html, s=None) == []


def test_name_parts(spark):
    p = one(spark, people.name_parts(F.col("n")), n="Officina Rossi & Figli S.R.L.")
    assert (p.legal_form, p.descriptors, p.brand, p.core) == ("s.r.l.", ["officina", "figli"], ["rossi"], "rossi")
    p = one(spark, people.name_parts(F.col("n")), n="Studio Immobiliare srl")
    assert (p.descriptors, p.core) == ([], "studio immobiliare")
    assert one(spark, people.name_parts(F.col("n")), n=None).core in (None, "")


def test_email_candidates(spark):
    got = one(spark, people.email_candidates(F.col("d"), F.col("n"), F.col("p")), d="Rossi.it.", n="Rossi srl", p="Niccolò D'Angelo")
    assert [x.email.split("@")[0] for x in got] == ["info", "contatti", "niccolo.dangelo", "amministrazione", "n.dangelo", "commerciale", "segreteria", "niccolodangelo", "dangelo"]
    assert got[0].email == "info@rossi.it"
    assert one(spark, people.email_candidates(F.col("d"), F.col("n"), F.col("p")), d="nodot", n="a", p=None) == []


def test_mail_verdict_without_answers(spark):
    v = one(spark, people.mail_verdict(F.lit(1), F.lit(True), F.lit(True), F.lit(250), F.lit(250), F.lit(550), F.col("a")), a=[550, None, 550, 250])
    assert (v["class"], v.place, v.note) == ("undeliverable", None, "rejected")  # the fourth is not asked for
    v = one(spark, people.mail_verdict(F.lit(1), F.lit(True), F.lit(True), F.lit(250), F.lit(250), F.lit(550), F.col("a")), a=[550, 250])
    assert (v["class"], v.place) == ("deliverable", 2)


def test_absent_needs_a_search(spark):
    schema = "seq int, site string, site_ok boolean, linked map<string,string>, searched map<string,string>, search_ok boolean, missing array<string>, places string, places_ok boolean, ads string, ads_ok boolean, shop boolean"
    rows = [(1, None, None, None, None, False, ["tiktok"], None, None, "confirmed_absent", None, None), (2, "x.it", None, None, None, True, ["tiktok"], None, None, "confirmed_absent", True, None)]
    got = {(r.seq, r.channel): r.state for r in judgment.footprint(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 22
    assert got[1, "tiktok"] == got[1, "ad_library"] == got[2, "website"] == judgment.UNKNOWN
    assert got[2, "tiktok"] == got[2, "ad_library"] == judgment.ABSENT


def test_empty_tables(spark):
    leads = spark.createDataFrame([], "seq int, company_name string, city string, province string, category string, official_website string, website string, revenue string, employees string, quadrant string, target string")
    assert views.company_view(leads).count() == 0
    assert {r.n for r in views.view_counts(views.company_view(leads)).collect()} == {0}
    assert views.region_view(leads).count() == views.town_view(leads, "PD").count() == 0
    assert views.gate_outcome(spark.createDataFrame([], "directory boolean, allow boolean, truth string")).first().precision == 0.0
