"""Derived views over the given tables, in SQL that Spark and DuckDB both read, and small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Northern regions, their macro area and provinces.
REGIONS = {
    "Piemonte": ("Nord-Ovest", "TO VC NO CN AT AL BI VB"),
    "Valle d'Aosta": ("Nord-Ovest", "AO"),
    "Liguria": ("Nord-Ovest", "GE IM SP SV"),
    "Lombardia": ("Nord-Ovest", "MI BG BS CO CR LC LO MN MB PV SO VA"),
    "Trentino-Alto Adige": ("Nord-Est", "TN BZ"),
    "Veneto": ("Nord-Est", "VR VI BL TV VE PD RO"),
    "Friuli-Venezia Giulia": ("Nord-Est", "UD GO PN TS"),
    "Emilia-Romagna": ("Nord-Est", "BO FC FE MO PR PC RA RE RN"),
}
#: The sample universe (division, province, active firms), year 2023.
UNIVERSE = [
    ("68", "BL", 520), ("68", "TV", 2100), ("68", "VR", 2300), ("68", "VI", 1800), ("68", "VE", 2400), ("68", "PD", 2200), ("68", "RO", 420),
    ("68", "MI", 12000), ("56", "BL", 640), ("56", "PD", 3200), ("56", "MI", 15000), ("25", "VI", 3600), ("25", "BS", 4200),
]
#: Words of a category and their division (the categories of the derived views), longest first at use.
CROSSWALK = {
    "68": ["immobiliare", "immobiliari", "agenzia immobiliare", "agenzie immobiliari"],
    "56": ["ristorante", "pizzeria", "trattoria"],
    "25": ["officina meccanica", "carpenteria", "fabbro"],
    "41": ["impresa edile", "costruzioni", "edilizia"],
    "31": ["mobili", "mobilificio", "arredamenti"],
}
#: Section of each division at hand, and the findable share of a section.
SECTIONS = {"68": "L", "56": "I", "25": "C", "41": "F", "43": "F", "31": "C"}
FACTORS = {"C": 0.55, "F": 0.35, "I": 0.85, "L": 0.7}
DEFAULT_FACTOR = 0.5
#: Sectors of several divisions, whose universes are summed.
SECTORS = [("41", "41"), ("41", "43"), ("43", "41"), ("43", "43")]

PROVINCES = "BL TV VR VI VE PD RO MI BS TO GE TN UD BO MN BG VA CO PR MO RM NA PA BA FI".split()
_CATEGORIES = {"AUTOMOBILE": "Officina meccanica", "BUILDING": "Impresa edile", "FURNITURE": "Mobilificio Arredamenti", "HOUSEHOLD": "Agenzie immobiliari"}


def _case(column: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


LEADS_SQL = f"""
SELECT c_custkey AS seq,
  CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE concat('Ditta ', CAST(c_custkey % 113 AS VARCHAR(10)),
    CASE c_custkey % 3 WHEN 0 THEN ' Società S.R.L.' WHEN 1 THEN ' società srl' ELSE ' S.p.A. Società' END) END AS company_name,
  {_case("c_mktsegment", _CATEGORIES, "'Varie'")} AS category,
  n_name AS city,
  CASE WHEN c_custkey % 41 = 0 THEN '' ELSE {_case("c_nationkey", dict(enumerate(PROVINCES)))} END AS province,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('Via Nuova ', CAST(c_custkey % 29 AS VARCHAR(10)), ' Centro') END AS address,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 5 = 0
    THEN concat('+39 3', CAST(300000000 + (c_custkey * 37) % 700 AS VARCHAR(12))) ELSE concat('0', CAST(42200000 + (c_custkey * 37) % 700 AS VARCHAR(12))) END AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 8 = 0 THEN concat('https://www.facebook.com/ditta', CAST(c_custkey AS VARCHAR(12)))
    ELSE concat('https://www.ditta', CAST(c_custkey % 211 AS VARCHAR(10)), '.it/home?x=1') END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN concat('info@ditta', CAST(c_custkey % 211 AS VARCHAR(10)), '.it')
    WHEN c_custkey % 4 = 1 THEN concat('ditta', CAST(c_custkey AS VARCHAR(12)), '@pec.it') ELSE NULL END AS email,
  CASE c_custkey % 6 WHEN 0 THEN 'deliverable' WHEN 1 THEN 'pec' WHEN 2 THEN 'catch_all' WHEN 3 THEN 'invalid' ELSE NULL END AS email_status,
  CASE WHEN c_custkey % 2 = 0 THEN concat(CASE WHEN c_custkey % 10 = 0 THEN 'IT' ELSE '' END, lpad(CAST((c_custkey * 7919) % 1000003 AS VARCHAR(12)), 11, '0')) ELSE NULL END AS vat_code,
  CASE c_custkey % 5 WHEN 0 THEN '1,5 mln' WHEN 1 THEN '200.000' WHEN 2 THEN '€ 1.500.000' WHEN 3 THEN '' ELSE NULL END AS revenue,
  CASE c_custkey % 4 WHEN 0 THEN 'da 10 a 19' WHEN 1 THEN 'oltre 50' ELSE NULL END AS employees,
  CASE c_custkey % 4 WHEN 0 THEN '4,5' WHEN 1 THEN '3.8' WHEN 2 THEN 'N/A' ELSE NULL END AS rating,
  CASE c_custkey % 3 WHEN 0 THEN '(1.234 recensioni)' WHEN 1 THEN '25' ELSE NULL END AS reviews_count,
  CASE c_custkey % 3 WHEN 0 THEN 'directory' WHEN 1 THEN 'maps' ELSE 'file' END AS source,
  CASE WHEN c_custkey % 9 = 0 THEN concat('https://ditta', CAST(c_custkey AS VARCHAR(12)), '.it') ELSE NULL END AS official_website,
  CASE WHEN c_custkey % 8 = 0 THEN lpad(CAST(c_custkey AS VARCHAR(12)), 11, '0') ELSE NULL END AS vat_code_final,
  CASE WHEN c_custkey % 15 = 0 THEN 'srl' ELSE NULL END AS legal_form,
  CASE WHEN c_custkey % 17 = 0 THEN 'Mario Rossi' ELSE ' ' END AS decision_maker_name,
  CASE WHEN c_custkey % 6 = 0 THEN 'i' ELSE NULL END AS instagram, CASE WHEN c_custkey % 4 = 0 THEN 'f' ELSE NULL END AS facebook,
  CASE WHEN c_custkey % 3 = 0 THEN 'l' ELSE '' END AS linkedin, CASE WHEN c_custkey % 12 = 0 THEN 't' ELSE NULL END AS tiktok,
  CASE WHEN c_custkey % 10 = 1 THEN 'x@pec.it' ELSE NULL END AS pec,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 130 AS VARCHAR(10)) ELSE NULL END AS portal_listings_count,
  CASE WHEN c_custkey % 20 = 0 THEN 'true' ELSE 'false' END AS portal_is_paid, CASE WHEN c_custkey % 25 = 0 THEN 'true' ELSE NULL END AS portal_fiaip
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
PORTAL_SQL = """
SELECT s_suppkey AS rec, concat('DITTA ', CAST(s_suppkey % 113 AS VARCHAR(10)), ' SOCIETA SRL') AS company_name, n_name AS city,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('0', CAST(42200000 + (s_suppkey * 37) % 700 AS VARCHAR(12))) ELSE NULL END AS phone,
  CAST(s_suppkey % 40 AS INTEGER) AS listings
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
LEDGER_SQL = """
SELECT event_id AS seq, ts, event_type AS provider, event_type <> 'error' AS success, value / 1000 AS cost_eur, user_id AS lead_id,
  CASE WHEN event_type <> 'error' THEN NULL WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'empty' ELSE 'blocked' END AS kind
FROM events
"""
SITES_SQL = """
SELECT c_custkey AS seq,
  CASE c_custkey % 6 WHEN 0 THEN 'Studio Rossi' WHEN 1 THEN 'Mario Rossi' WHEN 2 THEN 'Officina F.lli Bianchi S.R.L.' WHEN 3 THEN 'Ristorante Da Gino Soc. Coop.'
    WHEN 4 THEN 'Società Semplice Città Nuova & Figli' ELSE NULL END AS company_name,
  CASE c_custkey % 9 WHEN 0 THEN 'https://www.studio-rossi.it/chi-siamo/?a=1#b' WHEN 1 THEN ' HTTP://Shop.Rossi.co.uk:8080/negozio/ ' WHEN 2 THEN 'mariorossi.it'
    WHEN 3 THEN 'https://wa.me/39333' WHEN 4 THEN 'https://it-it.facebook.com/ditta' WHEN 5 THEN 'not a url' WHEN 6 THEN NULL WHEN 7 THEN ''
    ELSE concat('http://www.bianchi', CAST(c_custkey % 211 AS VARCHAR(10)), '.com/') END AS url,
  CASE c_custkey % 7 WHEN 0 THEN 'https://www.google.com/maps/place/x' WHEN 1 THEN 'https://maps.google.it/?q=x' WHEN 2 THEN 'https://www.google.com/maps/search/x' WHEN 3 THEN 'https://google.com.evil.io/maps/place/x'
    WHEN 4 THEN 'https://www.google.it/search' WHEN 5 THEN NULL ELSE 'http://google.co.uk/maps' END AS map_url,
  CASE WHEN c_custkey % 10 = 0 THEN 'Niccolò D’Angelo' WHEN c_custkey % 10 = 1 THEN 'Anna Maria Verdi' ELSE '' END AS person
FROM customer
"""
VIEWS = {"sites": SITES_SQL, "leads": LEADS_SQL, "portal": PORTAL_SQL, "ledger": LEDGER_SQL}
TABLES = ["region", "nation", "customer", "supplier", "orders", "events", "pages", "documents", "labels"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over four tasks a core: a small file of many rows is one task otherwise, which then writes and parses all pages.

    The number is given, as adaptive execution would join the tasks again by their bytes, which tell nothing of the work.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; only the base tables that its SQL names are read."""
    sql = VIEWS[name]
    used = [t for t in TABLES if f" {t} " in sql.replace("\n", " ")]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL in front of which the derived views stand."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.strip().startswith(head):
            return f"{head}{parts}, {sql.strip()[len(head):]}"
    return f"WITH {parts} {sql}"


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table as a local relation, whose size the optimizer knows."""
    text = lambda x: "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({names})")


def regions(spark: SparkSession) -> DataFrame:
    return values(spark, [(p, r, m) for r, (m, all_) in REGIONS.items() for p in all_.split()], "province, region, macro_area")


def universe(spark: SparkSession) -> DataFrame:
    out = values(spark, [(d, p, n, 2023, "sample") for d, p, n in UNIVERSE], "division, province, active_firms, year, provenance")
    return out.withColumn("active_firms", out.active_firms.cast("bigint"))


def sectors(spark: SparkSession) -> DataFrame:
    return values(spark, SECTORS, "division, member")


def crosswalk(spark: SparkSession) -> DataFrame:
    words = [(d, w) for d, ws in CROSSWALK.items() for w in ws]
    return values(spark, [(d, w, k) for k, (d, w) in enumerate(words)], "division, token, ord")
