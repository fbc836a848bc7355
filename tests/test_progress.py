"""Progress logs, lookup, places, gates and sessions on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import evidence, lookup, places, progress
from leadloom.sources import suffixes
from leadloom.streaming import live, sessions

LOG = "run_id string, key string, kind string, status string, parsed long, empty_verified boolean, attempts long, reason string, ts long"


def log(spark, *rows):
    """Rows (key, status, parsed, empty_verified, reason, ts[, kind, run])."""
    return spark.createDataFrame([(r[7] if len(r) > 7 else "r", r[0], r[6] if len(r) > 6 else "query", r[1], r[2], r[3], None, r[4], r[5]) for r in rows], LOG)


@pytest.mark.parametrize(("reason", "name"), [("net::ERR_FAILED", "network_exhausted"), ("Timeout 30s exceeded", "network_exhausted"), ("Consent page", "consent_wall"), ("HTTP 403 Forbidden", "blocked_or_captcha"), ("no_feed", "maps_no_feed"), ("matched 0 elements", "selector_drift"), ("prior jsonl gone", "checkpoint_integrity"), ("odd", "unknown"), (None, "unknown")])
def test_error_classes(spark, reason, name):
    assert spark.range(1).select(progress.error_class(F.lit(reason).cast("string"))).first()[0] == name


@pytest.mark.parametrize(("key", "parts"), [("pg:a%3Ab:c%253Ad:p12", ("pg", "a:b", "c%3Ad", 12)), ("maps:x:y", ("maps", "x", "y", None)), ("pg:x", (None,) * 4), ("pg::y", (None,) * 4), ("web:x:y", (None,) * 4), ("pg:x:y:p0", (None,) * 4), (None, (None,) * 4)])
def test_key_parts(spark, key, parts):
    df = spark.createDataFrame([(key,)], "k string")
    assert tuple(df.select(*progress.key_parts(F.col("k"))).first()) == parts


def test_states_need_proof(spark):
    rows = log(
        spark, ("pg:a:1", "failed", 0, False, "no_feed", 1), ("pg:a:1", "done", 3, False, None, 2), ("pg:a:2", "done", 0, True, None, 1), ("pg:a:3", "done", 0, False, None, 1), ("pg:a:4", "pending", None, None, None, 1),
        ("pg:a:5", "skipped", None, None, "captcha", 1), ("pg:a:6", "done", 0, None, None, 1, "preflight"), ("pg:a:7", "failed", None, None, "x", 1, "preflight"), ("pg:a:8", "done", None, None, None, 1),
    )
    out = {r["location"]: (r["status"], r["attempts"], r["error_class"], r["reason"]) for r in progress.query_states(rows).collect()}
    assert out == {
        "1": ("success", 1, None, None), "2": ("empty_verified", 1, None, None), "3": ("failed", 1, "selector_drift", "unverified_empty_result"), "4": ("failed", 0, "checkpoint_integrity", "checkpoint_pending_without_terminal_result"),
        "5": ("failed", 0, "blocked_or_captcha", "captcha"), "7": ("failed", 1, "unknown", "x"), "8": ("failed", 1, "selector_drift", "unverified_empty_result"),
    }


def test_manifests(spark):
    rows = log(
        spark, ("pg:a:1", "done", 3, False, None, 1, "query", "whole"), ("pg:a:2", "done", 0, True, None, 1, "query", "whole"), ("pg:a:1", "failed", 0, False, "captcha", 1, "query", "part"), ("pg:a:0", "pending", None, None, None, 1, "query", "part"),
        ("pg:a:1", "done", 0, None, None, 1, "preflight", "empty"), ("bad", "done", 1, None, None, 1, "query", "odd"),
    )
    out = {r["run_id"]: r for r in progress.manifests(rows).collect()}
    assert {k: (r["status"], r["queries"], r["failed"], r["error_classes"]) for k, r in out.items()} == {"whole": ("complete", 2, 0, ""), "part": ("partial", 2, 2, "blocked_or_captcha,checkpoint_integrity"), "empty": ("partial", 0, 0, ""), "odd": ("complete", 1, 0, "")}
    import hashlib

    assert out["part"]["incident_id"] == hashlib.sha256(b"pg:a:0:checkpoint_integrity|pg:a:1:blocked_or_captcha").hexdigest()[:24] and out["whole"]["incident_id"] is None
    progress.check_manifest(progress.manifests(rows.filter("run_id <> 'odd'")))
    with pytest.raises(progress.IncompleteManifest):
        progress.check_manifest(progress.manifests(rows))
    assert {r["status"] for r in progress.manifests(rows, interrupted=F.lit(True)).collect()} == {"partial"}


def test_resume_keeps_proved_rows_and_stops_where_they_are_gone(spark):
    work = spark.createDataFrame([(str(k),) for k in range(6)], "key string")
    made = lambda todo: todo.select("key", F.lit("new").alias("v"))
    old = spark.createDataFrame([("0", "old"), ("0", "old"), ("1", "half"), ("2", "old")], "key string, v string")
    entries = log(spark, ("0", "done", 2, False, None, 1), ("1", "pending", None, None, None, 1), ("2", "failed", None, None, None, 1), ("2", "done", 1, None, None, 2), ("3", "done", 0, True, None, 1), ("4", "done", 0, None, None, 1))
    out = sorted(map(tuple, progress.resume(work, entries, old, made).collect()))
    assert out == [("0", "old"), ("0", "old"), ("1", "new"), ("2", "old"), ("4", "new"), ("5", "new")]
    with pytest.raises(progress.MissingPriorRows):
        progress.resume(work, entries, old.filter("key <> '2'"), made)
    assert progress.resume(work, entries, old.filter("key <> '2'"), made, allow_missing=True).count() == 5
    assert progress.resume(work, entries.limit(0), old.limit(0), made).count() == 6


# --- lookup -----------------------------------------------------------------------------------------------------


def test_lines_of_files_are_counted_over_blocks(spark, tmp_path):
    for name, n in (("a.csv", 5000), ("deep/b.jsonl", 3)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"row {k} of {name}\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = lookup.file_lines(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r["text"].startswith(f"row {r['line']} of") for r in rows)


@pytest.mark.parametrize("block", [1, 500_000])
def test_subjects(spark, block):
    lines = spark.createDataFrame([
        ("f", 1, '"Rossi, ""X""",+39 049 123 4567,x'), ("f", 2, '{"company_name": "Bianchi", "vat": "IT 012345.67890", "tel": "0491234567"}'), ("f", 3, "nothing 04912345"), ("g", 1, "01234567890"), ("g", 2, None), ("g", 3, ""),
    ], "file string, line long, text string")
    subjects = spark.createDataFrame([("s", "+39 0491234567", "01234567890"), ("t", "12345", "0123"), ("u", None, None), ("v", None, "IT01234567890")], "subject_id string, phone string, vat string")
    out = sorted(tuple(r) for r in lookup.find_subjects(lines, subjects, block).collect())
    assert out == [("s", "f", 1, "Rossi", "phone"), ("s", "f", 2, "Bianchi", "phone"), ("s", "g", 1, "01234567890", "vat"), ("v", "f", 2, "Bianchi", "vat"), ("v", "g", 1, "01234567890", "vat")]
    assert lookup.find_subjects(lines, subjects.limit(0), block).count() == 0 and lookup.find_subjects(lines.limit(0), subjects, block).count() == 0


# --- places -----------------------------------------------------------------------------------------------------


def test_places(spark):
    index = places.place_index(spark.createDataFrame([("Bolzano/Bozen", "BZ"), ("San Donà", "VE"), ("Castro", "BG"), ("Castro", "LE"), ("Castro", "BG"), (None, "X"), ("Nowhere", None)], "place string, province string"))
    assert {r[0]: r[1] for r in index.collect()} == {"bolzano bozen": "BZ", "bolzano": "BZ", "bozen": "BZ", "san dona": "VE", "castro": None}
    rows = [("1", None, "BOZEN", None, "x"), (" ", "Castro", "san-donà", None, "x"), ("", None, None, "Bolzano", "x"), (None, "Castro", None, None, "x"), ("PD", "Bozen", None, None, "x"), ("", "Bozen", "San Donà", None, "x")]
    leads = spark.createDataFrame([(k, None if p == "1" else p, *rest) for k, (p, *rest) in enumerate(rows)], "seq int, province string, business_city string, city string, query_location string, _key0 string")
    assert {r["seq"]: r["province"] for r in places.fill_province(leads.withColumnRenamed("_key0", "extra"), index).collect()} == {0: "BZ", 1: "VE", 2: "BZ", 3: None, 4: "PD", 5: "BZ"}


# --- gates ------------------------------------------------------------------------------------------------------


def test_page_evidence(spark):
    long = "<p>" + "x " * 120
    codes = " ".join(f"0123456789{k}" for k in range(4))
    rows = ["short", long + "<p>affitto casa", long + "<p>Affitti, appartamenti, locazioni", long + codes + " affitto affitto affitto", long + codes[:35] + " affitto" * 3, None]
    out = {r["page_id"]: (r["allow"], r["reason"], r["codes"], r["density"]) for r in evidence.page_evidence(spark.createDataFrame(list(enumerate(rows)), "page_id int, html string")).collect()}
    assert out == {0: (False, "tiny_or_empty_html", None, None), 1: (False, "sector_density_too_low", 0, 1), 2: (True, "allowed", 0, 3), 3: (False, "aggregator_many_vats", 4, None), 4: (True, "allowed", 3, 3), 5: (False, "tiny_or_empty_html", None, None)}


def test_search_gate(spark):
    rows = [("Foo S.r.l.", None, None, None, None, None, None), ("Bloom S.r.l.", "01234567890", "049 1234567", None, None, None, None), ("S.r.l.", None, "049 1234567", None, None, None, None), ("Bloom Art", None, None, "x@www.Bloom.it", "http://l", "Via Roma 1, x", "Padova"), (None, None, None, None, None, None, None)]
    leads = spark.createDataFrame([(k, n, v, p, e, u, a, c, None) for k, (n, v, p, e, u, a, c) in enumerate(rows)], "seq int, company_name string, vat_code string, phone string, email string, pg_url string, address string, city string, province string")
    assert {r["seq"]: (r["allow"], r["reason"]) for r in evidence.search_gate(leads).collect()} == {
        0: (False, "deny:no_signal_beyond_name"), 1: (False, "deny:common_bare_stem:bloom"), 2: (False, "deny:name_is_stopwords_only"), 3: (True, "allow:signals=email_domain,pg_url,address_with_locality"), 4: (False, "deny:no_signal_beyond_name"),
    }


def test_corroborated_hits(spark):
    leads = spark.createDataFrame([(1, "Rossi Impianti S.r.l.", "https://www.rossi.it", None, "Padova", "PD", "01234567890", "https://instagram.com/rossi/"), (2, "Costruzioni Generali", None, None, "Padova", None, None, None)], "seq long, company_name string, website string, official_website string, city string, province string, vat_code string, instagram string")
    cases = [
        (1, "https://news.example/a", "Rossi Impianti", "a Padova", True), (1, "https://news.example/a", "Rossi Impianti", "( pd )", True), (1, "https://news.example/a", "Rossi impianti", "P.IVA 01234567890.", True), (1, "https://news.example/a", "Rossi impianti", "see www.rossi.it.", True),
        (1, "https://news.example/a", "Rossi impianti", "in Milano 012345678901", False), (1, "https://shop.rossi.it/x", "Rossi impianti", "Padova", False), (1, "http://www.instagram.com/rossi/p", "Rossi impianti", "Padova", False), (1, "https://news.example", "Rossi", "Padova", False),
        (2, "https://news.example", "Costruzioni Generali", "Padova", False), (3, "https://news.example", "Rossi", "Padova", False), (1, None, "Rossi impianti", "Padova", False), (1, "https://news.example", None, None, False),
    ]
    hits = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "hit_id int, lead_id long, url string, title string, snippet string")
    assert {r["hit_id"]: r["corroborated"] for r in evidence.corroborated_hits(hits, leads, suffixes.suffix_rules(spark)).collect()} == {k: c[4] for k, c in enumerate(cases)}


# --- streams ----------------------------------------------------------------------------------------------------


def test_sessions_and_late_rows(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    files = [[(1, at(0), 1.0), (1, at(1), 2.0), (2, at(5), 1.0), (None, at(0), 9.0)], [(1, at(30), 3.0), (1, at(4), 4.0)], [(1, at(1.5), 5.0), (1, at(31), 6.0), (2, None, 7.0), (2, at(4), 8.0)]]
    schema = "user_id long, ts timestamp, value double"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = live.event_stream(spark, str(tmp_path / "s"), spark.read.parquet(str(tmp_path / "s")).schema)
    out = live.run_once(sessions.mark_late(stream, 3600 * 10), "late", "append")
    assert sorted((r["user_id"], r["value"]) for r in out.filter("late").collect()) == [(1, 5.0)]
    assert out.count() == sum(map(len, files))
    table = spark.createDataFrame([r for f in files for r in f], schema)
    got = sorted((r["user_id"], r["start"].hour + 24 * (r["start"].day - 1), r["events"], float(r["value"])) for r in sessions.sessions(table.filter("ts is not null")).collect())
    assert got == [(1, 0, 3, 8.0), (1, 4, 1, 4.0), (1, 30, 2, 9.0), (2, 4, 2, 9.0)]


# --- findings of round 3 ----------------------------------------------------------------------------------------


def test_a_table_of_several_files_is_one_batch(spark, tmp_path):
    """Files side by side in reverse order of time: no event is late by chance."""
    from leadloom.plans import parsed, queries  # noqa: F401  the former registers its queries

    for day in (20, 10, 1):
        rows = spark.sql(f"select id + {day} * 10 as event_id, timestamp_ntz'2024-01-01' + make_dt_interval({day}, cast(id as int)) as ts, id % 2 as user_id, 'view' as event_type, 1.5d as value, '' as props from range(4)")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert queries.QUERIES["s_unique_events"](spark, str(tmp_path)).first()["n"] == 12
    assert queries.QUERIES["s_sessions"](spark, str(tmp_path)).agg({"events": "sum"}).first()[0] == 12
    late = queries.QUERIES["s_late_rows"](spark, str(tmp_path)).orderBy("user_id").collect()
    assert sum(r["late"] + r["in_time"] for r in late) == 12 and sum(r["late"] for r in late) > 0
