"""Parsers of saved pages and payloads on small inputs whose results are read off them."""

from __future__ import annotations

import base64
import json

import pytest

from leadloom.sources import items, markup, suffixes

PAD = "<p>" + "x " * 150 + "</p>"


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def by_id(df):
    return {r["page_id"]: r.asDict() for r in df.collect()}


# --- element scan -----------------------------------------------------------------------------------------------


def test_scan_of_broken_markup(spark):
    html = "<ul><li class='a b'>one<li class=c>two <b>bold</b></ul><table><tr><td>1<td>2<tr><td>3</table><script>if (a<b) x();</script><a href='?a=1&amp;b=2'>&euro; 5<br>x"
    rows = [(r["tag"], r["classes"], r["text"], r["nth"]) for r in sorted(markup.elements(pages(spark, html), ["li", "td", "script", "a"]).collect(), key=lambda r: r["place"])]
    assert rows == [("li", ["a", "b"], "one", 0), ("li", ["c"], "two bold", 1), ("td", [], "1", 0), ("td", [], "2", 1), ("td", [], "3", 0), ("script", [], "if (a<b) x();", 2), ("a", [], "€ 5x", 3)]
    link = markup.elements(pages(spark, html), ["a"]).first()
    assert link["attrs"] == {"href": "?a=1&b=2"}


def test_scan_of_nothing(spark):
    assert markup.elements(spark.createDataFrame([(1, None), (2, ""), (3, "plain")], "page_id long, html string"), ["a"]).count() == 0
    assert markup.elements(spark.createDataFrame([], "page_id long, html string"), ["a"]).count() == 0


# --- detail pages -----------------------------------------------------------------------------------------------


def ld(value) -> str:
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def test_linked_data_comes_first_in_its_order(spark):
    graph = {"@graph": [{"name": 5, "telephone": " "}, {"a": {"Name": " Ditta Uno "}, "telephone": "049 1", "vatID": "IT 01234567890", "email": "INFO@Uno.IT"}], "name": "Later"}
    html = "<h1>Heading</h1>" + ld("not json {") + ld(graph) + PAD
    row = by_id(markup.detail_pages(pages(spark, html)))[0]
    assert (row["name"], row["phone"], row["vat_code"], row["email"]) == ("Ditta Uno", "049 1", "01234567890", "info@uno.it")


def test_patterns_and_visible_text_where_there_is_no_linked_data(spark):
    html = '<h1>Ditta <b>Due</b></h1><div class="x sede__indirizzo"> Via\n Roma  1 </div>{"vatID":"IT01234567890", "email": " A@b.it ", "telephone":"1"' + PAD
    row = by_id(markup.detail_pages(pages(spark, html)))[0]
    assert row == {"page_id": 0, "official_website": None, "vat_code": "01234567890", "phone": "1", "email": "a@b.it", "name": "Ditta Due", "address": "Via Roma 1"}


@pytest.mark.parametrize(
    ("links", "site"),
    [
        ('<a href="https://b.example" title="Il Sito Web">x</a><a data-tr="scheda_azienda__cta_sitoweb" href="https://a.example">x</a>', "https://a.example"),
        ('<a data-tr="scheda_azienda__cta_sitoweb" href="https://www.facebook.com/x">x</a><a href="https://b.example">vai al sito web</a>', "https://b.example"),
        ('<a data-tr="x_sitoweb" href="mailto:a@b.it">x</a><a href="javascript:x">sito web</a><a href="https://c.example">altro</a>', None),
    ],
)
def test_the_site_a_page_names(spark, links, site):
    row = by_id(markup.detail_pages(pages(spark, "<h1>N</h1>" + links + PAD)))[0]
    assert row["official_website"] == site


def test_short_and_empty_pages_give_nothing(spark):
    assert markup.detail_pages(pages(spark, "<h1>Short</h1>", PAD, "")).count() == 0


# --- search results ---------------------------------------------------------------------------------------------


def wrapped(url: str, prefix: str = "a1") -> str:
    return "https://www.bing.com/ck/a?!&&p=1&u=" + prefix + base64.urlsafe_b64encode(url.encode()).decode().rstrip("=") + "&ntb=1"


def test_boxes(spark):
    box = lambda href, title, rest="": f'<li class="b_algo"><h2><a href="{href}">{title}</a></h2>{rest}</li>'
    html = "<ol>" + box(wrapped("https://è.example/?q=1"), "One", '<div class="b_caption"><p> Snip </p></div>') + box("", "no link") + box("https://x.example", "") + box(wrapped("not a url"), "Two", '<p class="b_lineclamp4">L</p>') + "<li><h2><a href='https://other'>no</a></h2></li></ol>"
    rows = [(r["rank"], r["title"], r["url"], r["snippet"]) for r in markup.results_in_boxes(pages(spark, html)).orderBy("rank").collect()]
    assert rows == [(1, "One", "https://è.example/?q=1", "Snip"), (4, "Two", wrapped("not a url"), "L")]
    assert markup.results_in_boxes(pages(spark, html + "Please verify that")).count() == 0
    assert markup.results_in_boxes(pages(spark, html), limit=1).count() == 1


def test_rows_of_results(spark):
    row = lambda href, title, snippet: f'<tr><td><a class="result-link" href="{href}">{title}</a></td></tr><tr><td class="result-snippet">{snippet}</td></tr>'
    html = "<table>" + row("https://duckduckgo.com/y.js?ad", "Ad", "a") + row("//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.example%2F%3Fa%3D1%2B2&amp;rut=1", "One", "s1") + row("https://y.example", "Two", "s2") + "</table>"
    rows = [(r["rank"], r["title"], r["url"], r["snippet"]) for r in markup.results_in_rows(pages(spark, html)).orderBy("rank").collect()]
    assert rows == [(2, "One", "https://x.example/?a=1+2", "s1"), (3, "Two", "https://y.example", "s2")]


def test_plain_links_where_no_result_is_marked(spark):
    html = '<a href="/settings">s</a><a href="https://x.example">X</a><a href="https://help.duckduckgo.com/a">h</a><a href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fz.example">Z</a>'
    rows = [(r["rank"], r["url"]) for r in markup.results_in_rows(pages(spark, html)).orderBy("rank").collect()]
    assert rows == [(2, "https://x.example"), (4, "https://z.example")]
    assert markup.results_in_rows(pages(spark, html + "an anomaly")).count() == 0


# --- financial pages --------------------------------------------------------------------------------------------


def test_the_latest_year_counts_whatever_the_order(spark):
    chart = "<script>var labelChart = ['2020','2022','2021']; var datiChartFatturato = [10, 30, 20]; var datiChartUtile=[1,0,-2];</script>"
    gap = "<script>var labelChart=['2023','2022']; var datiChartFatturato=[0, 7];</script><h1>Gap</h1>"
    table = '<table><tr><th scope="row">Fatturato 2021</th><td>&euro; 1,5 mln</td></tr><tr><th scope="row">Fatturato 2023</th><td>€ 2.000.000</td></tr><tr><th scope="row">Utile 2022</th><td>5</td></tr></table>'
    grid = '<div><div class="col-xs-5">Fatturato</div><div class="col-xs-7">€ 9</div><div class="col-sm-5">N. dipendenti</div><div class="col-sm-7">oltre 1000</div><div class="col-xs-5">Partita IVA</div><div class="col-xs-7">IT 01234567890</div></div>'
    out = by_id(markup.financials(pages(spark, chart + "<h1>A</h1>", table, grid, "<h1>Only a name</h1>", "<p>nothing</p>", gap)))
    take = lambda k: (out[k]["revenue_amount"], out[k]["revenue_year"], out[k]["profit"], out[k]["confidence"])
    assert take(0) == (30, 2022, None, 0.9) and [tuple(y) for y in out[0]["years"]] == [(2020, 10, 1), (2022, 30, None), (2021, 20, -2)]
    assert take(1) == (2_000_000, 2023, 5, 0.75)
    assert take(2) == (9, None, None, 0.75) and out[2]["employees"] == "1000+" and out[2]["vat_code"] == "01234567890"
    assert take(3) == (None, None, None, 0.4) and take(4) == (None, None, None, 0.0)
    assert take(5) == (7, 2022, None, 0.9)


@pytest.mark.parametrize(("text", "band"), [("da 10 a 15", "10-15"), ("10–15", "10-15"), ("oltre 1000", "1000+"), ("fino a 5", "<5"), ("8.200", "8200"), ("10 15", None), ("molti", None)])
def test_staff_bands(spark, text, band):
    from pyspark.sql import functions as F

    assert spark.range(1).select(markup.staff_band(F.lit(text))).first()[0] == band


# --- map feeds --------------------------------------------------------------------------------------------------


def test_map_cards(spark):
    span = lambda t: f"<span>· {t}</span>"
    card = lambda name, *lines: f'<div class="Nv2PK"><a href="/maps/place/{name}"></a><div class="qBF1Pd">{name}</div><div class="W4Efsd">{"".join(map(span, lines))}</div></div>'
    html = '<div class="Nv2PK">before</div><div role="feed">' + card("A", "Aperto", "Agenzia immobiliare", "Via Roma 1, 35100 Padova PD", "049 123456") + card("B", "Chiuso definitivamente", "V.le Trento") + card("", "x") + "</div>" + PAD
    a, b = markup.map_cards(pages(spark, html)).orderBy("place").collect()
    assert (a["name"], a["category"], a["address"], a["zip"], a["city"], a["province"], a["phone"], a["closed"], a["total"], a["dropped"]) == ("A", "Agenzia immobiliare", "Via Roma 1, 35100 Padova PD", "35100", "Padova", "PD", "049 123456", False, 3, 1)
    assert (b["name"], b["maps_url"], b["closed"], b["address"], b["category"]) == ("B", "https://www.google.com/maps/place/B", True, "V.le Trento", None)
    assert markup.map_cards(pages(spark, card("A") + PAD)).count() == 0


# --- payloads ---------------------------------------------------------------------------------------------------


def payloads(spark, *rows):
    return spark.createDataFrame([(k, p, v if isinstance(v, str) or v is None else json.dumps(v)) for k, (p, v) in enumerate(rows)], "item_id long, portal string, payload string")


def test_portal_shapes(spark):
    rows = [
        ("immobiliare", {"name": "Acme", "phone": "+39 049 1", "email": "INFO@ACME.IT", "website": "https://www.acme.it", "city": "Padova", "socials": ["https://instagram.com/acme?utm=1", "https://facebook.com/acme"], "listingsCount": 42}),
        ("immobiliare", {"title": "B", "phones": [{"isVirtual": True, "value": "1"}, {"formattedValues": "+392"}], "location": {"city": {"name": "Roma"}, "province": {"id": "RM"}}, "website": "https://www.google.de/maps/place/x"}),
        ("immobiliare_ads", {"agencyName": "C", "totalAds": "17", "premium": "true", "fiaip": False, "telefono": "049"}),
        ("wikicasa", {"name": "Rossi", "website": "rossiimmobiliare.it", "hidden_display_phone": "041", "active_real_estates": 3.0}),
        ("wikicasa", {"city": "x"}), ("wikicasa", "{bad"), ("wikicasa", None), ("other", {"name": "x"}), ("wikicasa", [1]),
    ]
    out = [r.asDict() for r in items.portal_records(payloads(spark, *rows)).orderBy("item_id").collect()]
    a, b, c, d = out[:4]
    assert (a["email"], a["website"], a["instagram"], a["facebook"], a["listings"], a["reason"]) == ("info@acme.it", "https://www.acme.it", "https://instagram.com/acme", "https://facebook.com/acme", 42, None)
    assert (b["name"], b["phone"], b["city"], b["province"], b["website"]) == ("B", "+392", "Roma", "RM", None)
    assert (c["listings"], c["paid"], c["association"], c["phone"]) == (17, True, False, "049")
    assert (d["website"], d["phone"], d["listings"]) == ("https://rossiimmobiliare.it", None, 3)
    assert [r["reason"] for r in out[4:]] == ["no_identity", "bad_json", "bad_json", "unknown_portal", "bad_json"]


def test_register_place_and_mail_payloads(spark):
    given = payloads(spark, ("", {"denominazione": "X", "esponenti": [{"nome": "M R", "carica": "a.u."}], "fatturato": 1000.5, "atecoCode": "68", "atecoDescription": "imm"}), ("", {"ragioneSociale": "Y", "titolare": "T", "partitaIva": "IT 01", "utile": 9}))
    x, y = items.register_records(given).orderBy("item_id").collect()
    assert (x["person"], x["role"], x["revenue"], x["sector"], x["vat"]) == ("M R", "a.u.", "1000.5", "68 — imm", None)
    assert (y["name"], y["person"], y["role"], y["vat"], y["revenue"], y["profit"]) == ("Y", "T", "titolare", "01", None, "9")
    place = items.place_records(payloads(spark, ("", {"title": "A", "website": "https://maps.google.com/?cid=1", "totalScore": 4.5, "instagrams": ["https://x", "https://instagram.com/a?b"]}))).first()
    assert (place["website"], place["rating"], place["instagram"]) == (None, "4.5", "https://instagram.com/a")
    checks = [{"email": "A@B.it", "status": "Valid"}, {"result": "bounced"}, {"result": "accept_all"}, {"isCatchAll": True, "status": "ok"}, {"status": "greylisted"}, {"status": 5}, "x"]
    assert [r["status"] for r in items.mail_checks(payloads(spark, *[("", c) for c in checks])).orderBy("item_id").collect()] == ["deliverable", "invalid", "catch_all", "catch_all", "unknown", "unknown", "unknown"]


def test_registry_payloads(spark):
    def payload(fn, adr=None, extra=""):
        return json.dumps({"entities": [{"roles": []}, {"vcardArray": ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", fn], *([["adr", {}, "text", adr]] if adr else [])]]}], "x": extra})

    far = ["", "", "", "Roma", "RM", "", "IT"]
    rows = [
        (1, payload("Other", far, "IT01234567890"), "Acme Italia", "01234567890", "Padova", "PD"),
        (2, payload("Acme Italia SRL", far), "Acme Italia S.r.l.", None, "Padova", "PD"),
        (3, payload("Acme", ["", "", "", "Roma", "", "", ""]), "Acme Beta", None, "Padova", None),
        (4, payload("Other", ["", "", "", "", "", "", "de"], "acme-beta"), "Acme Beta", None, None, None),
        (5, "{}", "Acme", None, None, None), (6, None, None, None, None, None),
    ]
    out = {r[0]: tuple(r)[1:] for r in items.registry_evidence(spark.createDataFrame(rows, "lead_id long, payload string, company_name string, vat_code string, city string, province string")).collect()}
    assert out[1] == (0.9, "piva_in_payload", False, None)
    assert out[2] == (0.4, "name_in_vcard", True, "registrant_region=RM lead=PD")
    assert out[3] == (0.2, "name_in_vcard", True, 'registrant_locality="roma" lead="padova"')
    assert out[4] == (0.2, "name_in_payload", True, "registrant_country=DE")
    assert out[5] == out[6] == (0.0, "none", False, None)


# --- domains ----------------------------------------------------------------------------------------------------

DOMAINS = [
    ("rossi.it", "rossi.it", "", "rossi.it"), ("https://www.rossi.it/contatti?x=1#top", "rossi.it", "", "rossi.it"), ("a.b.rossi.it", "rossi.it", "a.b", "rossi.it"), ("ROSSI.IT.", "rossi.it", "", "rossi.it"),
    ("rossi.it:8080", "rossi.it", "", "rossi.it"), ("//rossi.it/x", "rossi.it", "", "rossi.it"), ("www.foo.pd.it", "foo.pd.it", "", "foo.pd.it"), ("shop.foo.co.uk", "foo.co.uk", "shop", "foo.co.uk"),
    ("x.altervista.org", "x.altervista.org", "", None), ("https://foo.blogspot.com/", "foo.blogspot.com", "", None), ("https://müller.de", "xn--mller-kva.de", "", "xn--mller-kva.de"), ("www2.rossi.it", "rossi.it", "www2", "rossi.it"),
    ("a.b.ck", "a.b.ck", "", "a.b.ck"), ("x.www.ck", "www.ck", "x", "www.ck"), ("a.b.nosuchtld", "b.nosuchtld", "a", "b.nosuchtld"),
    *[(u, None, "", None) for u in (None, "   ", "192.168.1.1", "http://10.0.0.1/admin", "http://[::1]/", "localhost", "co.uk", "pd.it", "it", "http://[bad")],
]


def test_public_suffixes(spark):
    given = spark.createDataFrame([(k, u, "kept") for k, (u, *_) in enumerate(DOMAINS)], "k int, url string, host2 string")
    out = {r["k"]: (r["registrable"], r["subdomain"], r["registry"]) for r in suffixes.with_domains(given, "url", suffixes.suffix_rules(spark)).collect()}
    assert out == {k: tuple(rest) for k, (_, *rest) in enumerate(DOMAINS)}


def test_a_list_of_ones_own(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// ===BEGIN ICANN DOMAINS===\nzz\n*.yy\n!own.yy\n// ===BEGIN PRIVATE DOMAINS===\nhost.zz\n")
    rules = suffixes.suffix_rules(spark, str(tmp_path / "list.dat"))
    given = spark.createDataFrame([("a.b.zz",), ("a.host.zz",), ("a.b.c.yy",), ("a.own.yy",)], "url string")
    assert {r["url"]: (r["registrable"], r["registry"]) for r in suffixes.with_domains(given, "url", rules).collect()} == {"a.b.zz": ("b.zz", "b.zz"), "a.host.zz": ("a.host.zz", None), "a.b.c.yy": ("b.c.yy", "b.c.yy"), "a.own.yy": ("own.yy", "own.yy")}


# --- findings of round 3 ----------------------------------------------------------------------------------------


def test_the_code_of_a_place_is_no_house_number(spark):
    html = '<body><div role="feed"><div class="Nv2PK"><div class="qBF1Pd">A</div><div class="W4Efsd"><span>Via Roma 10000, 32100 Belluno BL</span></div></div></div>' + PAD
    row = markup.map_cards(pages(spark, html)).first()
    assert (row["zip"], row["city"], row["province"]) == ("32100", "Belluno", "BL")


def test_references_without_a_semicolon(spark):
    html = "<h1>R&amp;D &ampx &#65; a&b</h1><script>a&&b</script>" + PAD
    assert markup.detail_pages(pages(spark, html)).first()["name"] == "R&D &x A a&b"
    assert markup.detail_pages(pages(spark, html), closed=True).first()["name"] == "R&D &ampx A a&b"
    assert markup.elements(pages(spark, html), ["script"], closed=True).first()["text"] == "a&&b"


def test_boxes_with_references_without_a_semicolon(spark):
    html = '<ol><li class="b_algo"><h2><a href="https://x.example">A &amp</a></h2></li></ol>'
    assert markup.results_in_boxes(pages(spark, html), closed=True).first()["title"] == "A &amp"


def test_rows_with_references_without_a_semicolon(spark):
    html = '<table><tr><td><a class="result-link" href="https://x.example">A &amp</a></td></tr></table>'
    assert markup.results_in_rows(pages(spark, html), closed=True).first()["title"] == "A &amp"


def test_a_tracking_link_whose_code_has_line_breaks(spark):
    url = "https://www.shop.example.com/de/8708?utm_source=feed&utm_medium=a-long-word-for-two-lines"
    code = base64.encodebytes(url.encode()).decode().rstrip("=\n").replace("\n", "\r\n")
    html = f'<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1{code}&ntb=1">A</a></h2></li></ol>'
    assert markup.results_in_boxes(pages(spark, html)).first()["url"] == url
