"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from leadloom.plans import parsed, queries  # noqa: F401  the former registers its queries

SMALL = Path("/root/testdata/sf0.001")
SOME = ["q_coverage_cells", "q_buckets", "q_metrics", "q_dedup_keys", "q_upsert", "q_suppression_kept", "q_portal_join", "q_portal_attach", "q_portal_sidecar", "q_review_pairs", "q_outbound", "q_lead_score", "q_ledger_by_provider", "q_running_budget", "q_judge_axes", "q_page_links", "q_gates", "q_company_pages", "q_portal_items", "q_manifests", "q_registry", "q_search_gate"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    return con


def plain(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False)
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, str(SMALL)).toPandas()
    wanted = db.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_entry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parent.parent)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr[-2000:]
