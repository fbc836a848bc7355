"""Contact facts of pages and their filling into leads."""

from __future__ import annotations

import json

from leadloom.sources import bodies, suffixes

PAD = " <p>" + "x " * 40


def facts(spark, *rows):
    given = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id int, html string, official_website string")
    return [r.asDict() for r in bodies.body_facts(given, suffixes.suffix_rules(spark)).orderBy("page_id").collect()]


def hidden(mail: str, key: int = 0x42) -> str:
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in mail)


def test_mail_order_own_domain_and_pec(spark):
    a, b, c, d, e = facts(
        spark,
        ('<a href="mailto:other@gmail.com?subject=x">x</a><a href="MAILTO:Info@Rossi.it">y</a> <p>z@pec.rossi.it' + PAD, "https://www.rossi.it"),
        (f'<span class="__cf_email__" data-cfemail="{hidden("info@shop.rossi.it")}"></span>' + PAD, "rossi.it"),
        (f'<a href="/cdn-cgi/l/email-protection#{hidden("a@b.it")}">x</a> c@d.it' + PAD, None),
        ("<body>scrivi a vendite [at] rossi (punto) it, 14053 Canelli (AT) www.rossi.it" + PAD, "https://rossi.it"),
        ("<p>nobody@gmail.com" + PAD, "https://rossi.it"),
    )
    assert (a["email"], a["pec"]) == ("info@rossi.it", "z@pec.rossi.it")
    assert (b["email"], c["email"], d["email"], e["email"]) == ("info@shop.rossi.it", "a@b.it", "vendite@rossi.it", None)


def test_linked_data_before_what_is_shown(spark):
    node = {"@graph": [{"@type": "WebSite", "name": "no"}, {"@type": ["Thing", "LocalBusiness"], "name": "Shown", "legalName": "Rossi Srl", "telephone": "+39 049 1234567", "email": "mailto:INFO@rossi.it", "vatID": "IT00159560366",
            "sameAs": ["https://www.instagram.com/rossi/?hl=it", "https://facebook.com/sharer/x"], "founder": {"name": "M. R."}, "foundingDate": "1988-02-01", "aggregateRating": {"ratingValue": 4.5, "ratingCount": "12"}}]}
    html = f'<html><head><meta property="og:site_name" content="Open"><script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">bad</script></head><body><a href="https://instagram.com/other">i</a><a href="//www.facebook.com/rossi/">f</a><a href="tel:+39 0498765432">t</a> tel. 049 1234567 P.IVA 01654010345{PAD}</body>'
    (row,) = facts(spark, (html, "https://rossi.it"))
    assert (row["site_name"], row["email"], row["founder"], row["founding_year"], row["rating"], row["reviews"]) == ("Rossi Srl", "info@rossi.it", "M. R.", "1988", "4.5", "12")
    assert (row["instagram"], row["facebook"], row["linkedin"]) == ("https://instagram.com/rossi", "https://facebook.com/rossi", None)
    assert row["vat_codes"] == ["00159560366", "01654010345"] and row["phones"] == ["0498765432", "0491234567", "01654010345"]


def test_nothing(spark):
    a, b, c = facts(spark, (None, None), ("short a@b.it", None), (PAD, "http://[bad"))
    assert all(r["email"] is None and r["phones"] == [] and r["vat_codes"] == [] for r in (a, b, c))


def test_filling_never_changes_what_is_there(spark):
    leads = spark.createDataFrame([(0, "1", None, None, "x"), (1, " ", "pec", "a@b.it", "y"), (2, None, None, None, "z"), (3, "9", "personal", "k@k.it", None)], "seq int, phone string, email_type string, email_inferred string, filler string")
    found = spark.createDataFrame([
        (0, "e@e.it", "p@pec.it", ["v1", "v2"], ["049"]), (1, "f@f.it", None, [], ["02"]), (2, None, "p@pec.it", [], []),
    ], "seq int, email string, pec string, vat_codes array<string>, phones array<string>")
    for c in ("instagram", "facebook", "linkedin", "tiktok", "youtube", "rating", "reviews", "founding_year", "founder"):
        from pyspark.sql import functions as F

        found = found.withColumn(c, F.when(F.col("seq") == 0, c).cast("string"))
    out = {r["seq"]: r.asDict() for r in bodies.apply_facts(leads, found).collect()}
    assert (out[0]["phone"], out[0]["email_inferred"], out[0]["email_type"], out[0]["vat_code_final"], out[0]["decision_maker_name"]) == ("1", "e@e.it", "business", "v1", "founder")
    assert out[0]["filled"] == ["email_inferred", "pec", "instagram", "facebook", "linkedin", "tiktok", "youtube", "rating", "reviews_count", "founding_year", "decision_maker_name", "vat_code_final"]
    assert (out[1]["phone"], out[1]["email_inferred"], out[1]["email_type"], out[1]["filled"]) == ("02", "a@b.it", "pec", ["phone"])
    assert (out[2]["pec"], out[2]["email_type"], out[2]["filled"]) == ("p@pec.it", "pec", ["pec"])
    assert out[3]["filled"] == [] and out[3]["email_type"] == "personal" and out[3]["filler"] is None
