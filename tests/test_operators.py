from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from leadloom.operators import coverage, match, reports, resolve, score
from leadloom.sources import files, pages, tables
from leadloom.streaming import live

LEAD = "seq bigint, company_name string, category string, city string, province string, address string, phone string, website string, email string, email_status string, vat_code string, revenue string, employees string, rating string, reviews_count string, source string"


def leads(spark, *rows):
    names = [c.split()[0] for c in LEAD.split(", ")]
    return spark.createDataFrame([tuple({"seq": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], LEAD)


def test_coverage_cell_values(spark):
    some = [dict(company_name=f"Ditta {k}", category="Agenzie immobiliari", province="pd ", website="https://x.it" if k else None) for k in range(3)]
    cell = coverage.cells(leads(spark, *some)).first()
    assert (cell.division, cell.province, cell.have, cell.firms, cell.addressable) == ("68", "PD", 3, 2200, 1540)
    assert (cell.coverage, cell.need_for_sample, cell.need_for_target, cell.website_pct) == (0.002, 12, 921, 66.7)
    assert cell.priority == 921 * 1.5 + 12


def test_buckets_keep_every_lead(spark):
    some = leads(spark, dict(category="Agenzie immobiliari", province="RM"), dict(category="Varie", province="PD"), dict(category="Impresa edile", province="PD"), dict(province="PD"), dict())
    got = {(r.bucket, r.key): r.n for r in coverage.buckets(some).collect()}
    assert got == {("out_of_scope", "RM"): 1, ("unclassified", "Varie"): 1, ("in_scope", "all"): 1, ("unclassified", "sconosciuto"): 1, ("out_of_scope", "—"): 1}


def test_divisions_of_a_sector_share_its_universe(spark):
    known = {(r.division, r.province): r.firms for r in coverage.universe_by_cell(spark).collect()}
    assert known["68", "PD"] == 2200
    assert ("41", "PD") not in known


def fold(spark, *rows):
    keyed = resolve.with_keys(leads(spark, *rows))
    return {r.seq: r.kept for r in resolve.dedupe_ordered(keyed).collect()}


A, B, C = dict(phone="0422000177"), dict(website="https://h.it"), dict(phone="0422000177", website="https://h.it")


def test_fold_depends_on_the_order(spark):
    assert fold(spark, A, B, C) == {0: 0, 1: 1, 2: 0}
    assert fold(spark, A, C, B) == {0: 0, 1: 0, 2: 0}


def test_components_do_not(spark):
    for order in ((A, B, C), (A, C, B)):
        keyed = resolve.with_keys(leads(spark, *order))
        assert {r.entity for r in resolve.components(keyed).collect()} == {0}


def test_fold_merges_spellings_and_keeps_forms_apart(spark):
    rows = [dict(company_name=n, city="Padova") for n in ("Rossi S.R.L.", "ROSSI srl", "Rossi SPA")]
    assert fold(spark, *rows) == {0: 0, 1: 0, 2: 2}


def test_review_pairs(spark):
    rows = [dict(company_name="Alfa Beta", city="Padova"), dict(company_name="Beta Alfa", city="Padova"), dict(company_name="Gamma", city="Este", website="https://www.x.it"), dict(company_name="Delta", city="Este", website="https://x.it"), dict(company_name="Eta", website="https://p1.m.it"), dict(company_name="Zeta", website="https://p2.m.it")]
    got = {(r.rule, r.existing, r.incoming) for r in resolve.review_pairs(resolve.with_keys(leads(spark, *rows))).collect()}
    assert got == {("token_sort_name_city", 0, 1), ("shared_registrable_host", 2, 3)}


def test_upsert_fills_only_what_is_missing(spark):
    store = spark.createDataFrame([("a", "x", None), ("b", "", "q")], "k string, v string, w string")
    new = spark.createDataFrame([("a", "y", "z", 1), ("c", "n", None, 2), (None, "l", "l", 3), ("b", "r", "s", 4)], "k string, v string, w string, seq int")
    got = {r.k: (r.v, r.w, r.state) for r in resolve.upsert(store, new, "k", ["v", "w"]).collect()}
    assert got == {"a": ("x", "z", "kept"), "b": ("r", "q", "kept"), "c": ("n", None, "inserted")}


def test_suppression_and_cleared_emails(spark):
    some = leads(spark, dict(phone="+39 0422 000177"), dict(vat_code="IT07643520567", email="A@x.it", email_status="pec"), dict(phone="0422999999"))
    kept, dropped = match.suppress(some, spark.createDataFrame([("0422000177",), ("07643520567",)], "key string"))
    assert [r.seq for r in kept.collect()] == [2] and dropped.count() == 2
    clean = match.clear_emails(some, spark.createDataFrame([("a@X.it",)], "email string"))
    assert [(r.email, r.email_status) for r in clean.filter("seq = 1").collect()] == [(None, None)]


PORTAL = "rec bigint, company_name string, city string, phone string, listings int"


def test_portal_match_never_guesses(spark):
    own = leads(spark, dict(company_name="Rossi srl", city="Este", phone="0422000177"), dict(company_name="Verdi srl", city="Este", phone="0422000177"), dict(company_name="Bianchi", city="Este"))
    rec = spark.createDataFrame([(1, "Rossi S.R.L.", "Padova", "0422 000177", 3), (2, "Neri", "Este", "0422000177", 1), (3, "BIANCHI", "este", None, 2), (4, "Nessuno", "Este", None, 0), (5, "Bianchi", "Este", "0422000177", 0)], PORTAL)
    got = {r.rec: (r.seq, r.how) for r in match.match_portal(own, rec).collect()}
    # A phone of several leads decides alone, even where name and city would name one lead.
    assert got == {1: (0, "phone_name"), 2: (None, "ambiguous"), 3: (2, "name_city"), 4: (None, "unmatched"), 5: (None, "ambiguous")}


def test_portal_match_guards_the_phone_and_reads_names_loosely(spark):
    own = leads(
        spark, dict(company_name="Rossi srl", city="Este", phone="0422000177"), dict(company_name="Casa Bella Immobiliare srl", city="Este"),
        dict(company_name="Casa Nuova Affitti", city="Este"), dict(company_name="Casa Nuova Affitti srl", city="Este"), dict(company_name=None, city="Este", phone="0422000188"),
    )
    rec = spark.createDataFrame(
        [(1, "Altra Agenzia", "Este", "0422000177", 3), (2, None, None, "0422000177", 1), (3, "Casa Bella Immobiliare di Mario", "ESTE", None, 2), (4, "Casa Nuova", "Este", None, 1), (5, "Casa", "Este", None, 1), (6, "Uno", "Este", "0422000188", 1), (7, None, None, None, None)],
        PORTAL,
    )
    got = {r.rec: (r.seq, r.how) for r in match.match_portal(own, rec).collect()}
    assert got == {1: (None, "mismatch"), 2: (0, "phone"), 3: (1, "fuzzy"), 4: (None, "ambiguous"), 5: (None, "unmatched"), 6: (None, "mismatch"), 7: (None, "unmatched")}
    added = {r.seq: (r.phone, r.listings, r.portal_records) for r in match.attach_portal(own, rec, match.match_portal(own, rec)).collect()}
    assert added == {0: ("0422000177", 1, 1), 1: (None, 2, 1)}


def test_score_is_monotone_and_bounded(spark):
    full = dict(email="a@b.it", email_status="deliverable", website="https://x.it", revenue="1", employees="1", phone="1", rating="5", reviews_count="1000")
    grown = [dict(list(full.items())[:k]) for k in range(len(full) + 1)]
    got = [r.score for r in score.scored(leads(spark, *grown)).orderBy("seq").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 0.635


def test_score_of_all_parts(spark):
    parts = dict(email_inferred="a@b.it", email_status="pec", official_website="x", vat_code_final="1", share_capital="1", decision_maker_name="M", phone="1", rating="4", reviews_count="9", instagram="i", youtube="y", pec="p", portal_listings_count="9", portal_is_paid="true", portal_fiaip="false")
    rows = spark.createDataFrame([tuple(parts.values())], ", ".join(f"{k} string" for k in parts))
    wanted = 0.3 * 0.9 + 0.15 + 0.15 * 0.75 + 0.1 + 0.1 * (0.3 + 0.7 * 0.5 * 0.5) + 0.1 * 2 / 3 + 0.05 + 0.05 * (0.25 + 0.25)
    assert score.scored(rows).first().score == round(wanted, 3)


def test_quantiles_by_counts(spark):
    rows = spark.createDataFrame([(x / 10,) for x in (1, 1, 2, 3, 9)], "score double")
    assert {r.share: r.score for r in score.quantiles(rows, [0.1, 0.5, 0.9]).collect()} == {0.1: 0.1, 0.5: 0.2, 0.9: 0.9}


def test_profile_uses_the_nearest_rank(spark):
    rows = spark.createDataFrame([("c", k, True, float(v)) for k, v in enumerate((1, 2, 3, 4, 10))], "category string, company int, present boolean, value double")
    got = reports.category_profile(rows).first()
    assert (got.p50, got.p90, got.presence, got.provisional) == (3.0, 10.0, 1.0, True)


def test_judgment_keeps_unknown_out(spark):
    rows = spark.createDataFrame([("x", "A", 1, "strong", 1.0), ("x", "A", 2, "unknown", 1.0), ("x", "B", 1, "absence", 1.0), ("y", "A", 1, "unknown", 1.0)], "company string, axis string, dimension int, state string, weight double")
    got = {r.company: (r.a, r.b, r.quadrant, r.target, r.confidence) for r in reports.judge(rows).collect()}
    assert got == {"x": (1.0, 0.05, "+/-", "yes", 0.825), "y": (None, None, "unknown/unknown", "borderline", 0.3)}


def test_dead_providers(spark):
    rows = [("p", False, "timeout")] * 6 + [("p", False, "empty")] * 6 + [("q", True, None)] * 12 + [("r", False, "x")] * 9
    got = reports.dead_providers(spark.createDataFrame(rows, "provider string, success boolean, kind string")).collect()
    assert [(r.provider, r.calls, r.main_kind) for r in got] == [("p", 12, "empty")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿Ragione_Sociale, comune ,piva,note\n Rossi , Este,07643520567,x\n,Padova,,y\n", encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "in.csv")).orderBy("city").collect()
    assert [(r.company_name, r.city, r.vat_code, r.extra["note"], r.ingest_error) for r in rows] == [("Rossi", "Este", "07643520567", "x", None), (None, "Padova", None, "y", "missing company_name")]
    df = spark.createDataFrame([("Rossi", ["a", "b"], True)], "company_name string, sources array<string>, closed boolean")
    files.write_leads(df, str(tmp_path / "out"), ["company_name", "city", "sources", "closed"])
    got = spark.read.csv(str(tmp_path / "out/csv"), header=True).first()
    assert tuple(got) == ("Rossi", None, "a+b", "true")
    (tmp_path / "x.jsonl").write_text('{"company_name": "A"}\n{broken\n', encoding="utf-8")
    assert [r.company_name for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "company_name string").collect()] == ["A"]


def test_page_facts(spark):
    html = '<html><title>Ditta</title><script>x@y.zz</script><a href="mailto:Info@ditta.it?s=1">m</a><a href="https://www.facebook.com/ditta">f</a><p>P.IVA 07643520567 ditta [at] pec.it</p></html>'
    got = pages.contacts(spark.createDataFrame([(1, html)], "page_id bigint, html string")).first()
    assert (sorted(got.emails), got.pec, got.vat_codes, got.socials) == (["ditta@pec.it", "info@ditta.it"], ["ditta@pec.it"], ["07643520567"], ["https://www.facebook.com/ditta"])
    card = '<div data-card><a href="/d/1"><h2 data-field="name">Rossi</h2></a><p data-field="address">Via Roma 1, 35042 Este (PD)</p></div>'
    got = pages.cards(spark.createDataFrame([(1, card), (2, None)], "page_id bigint, html string")).collect()
    assert [(r.name, r.zip, r.province, r.url) for r in got] == [("Rossi", "35042", "PD", "/d/1")]


def test_breaker_opens_and_cools_down():
    state = ([], 0.0)
    for k in range(5):
        state, through = live.breaker_step(state, float(k), True, False)
        assert through
    state, through = live.breaker_step(state, 10.0, False, False)
    assert not through
    state, through = live.breaker_step(state, 4.0 + live.COOLDOWN_S, False, False)
    assert through
    state = ([], 0.0)
    for k in range(9):
        state, _ = live.breaker_step(state, float(k), True, True)
    assert live.breaker_step(state, 9.0, False, False)[1]


def test_fold_holds_keys_and_kept_leads_not_rows():
    rule = resolve.Fold()
    assert {rule.add(k, ["042200001", f"n{k % 3}|pd", None, ""]) for k in range(5000)} == {0}
    assert len(rule.kept) == 1 and sum(map(len, rule.index)) == 2  # a kept lead's keys are those it came with


def test_fold_is_read_batch_by_batch(spark, monkeypatch):
    monkeypatch.setattr(resolve, "FOLD_ROWS", 3)
    leads = spark.createDataFrame([(k, "042200001" if k % 2 else None, f"n{k // 4}|pd", None, None) for k in range(40)], "seq long, k_phone string, k_name_city string, k_name_addr string, k_host string")
    rows = leads.toPandas()
    rows = rows.astype(object).where(rows.notna(), None)
    whole = dict(resolve.fold(rows))
    assert {r.seq: r.kept for r in resolve.dedupe_ordered(leads).collect()} == whole
    assert "MapInArrow" in resolve.dedupe_ordered(leads)._jdf.queryExecution().executedPlan().toString()


def test_breaker_of_a_bucket_keeps_its_users_apart(spark, tmp_path):
    at = [(k, 10 * k + u, u, 1.0 if u == 1 else 50.0) for k in range(12) for u in (1, 2)]
    table = spark.createDataFrame(at, "s long, event_id long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "value")
    for part in (0, 1):  # two batches, so that the state of a bucket is read back
        table.filter(f"(event_id >= 60) = {bool(part)}".lower()).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = live.event_stream(spark, str(tmp_path / "events"), table.schema)
    out = live.run_once(live.breaker(stream, buckets=1), "breaker", "update").groupBy("user_id").sum("calls", "rejected").collect()
    state, shut = ([], 0.0), 0
    for k in range(12):
        state, through = live.breaker_step(state, float(k), True, True)
        shut += not through
    assert shut and {tuple(r) for r in out} == {(1, 12, shut), (2, 12, 0)}


def test_fold_of_empty_group():
    assert list(resolve.fold(pd.DataFrame(columns=resolve.FOLD))) == []


def test_yield_anomaly_and_stalls(spark):
    runs = spark.createDataFrame([("a", f"{k}", v) for k, v in enumerate((10, 0, 0, 12, 2))], "category string, run string, yield bigint")
    got = reports.yield_anomalies(runs).first()
    assert (got["yield"], got["mean"], got.suspect) == (2, 11.0, True)
    assert [tuple(r) for r in reports.stalls(runs, 2).collect()] == [("a", "1", 2)]


def test_view_reads_only_named_tables(spark):
    out = tables.view(spark, "/root/testdata/sf0.001", "ledger")
    assert out.filter(F.col("cost_eur").isNull()).count() == 0
