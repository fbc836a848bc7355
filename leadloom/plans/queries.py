"""Named queries over the given tables, and the SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import contact, numbers, text
from leadloom.operators import cascade, coverage, domains, gates, match, reports, resolve, score
from leadloom.sources import pages, tables
from leadloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = tables.with_views(sql, *views) if views else sql
        return f

    return add


def leads(spark: SparkSession, sf: str) -> DataFrame:
    return tables.view(spark, sf, "leads")


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.with_keys(leads(spark, sf))


# --- SQL pieces -------------------------------------------------------------------------------------------------

KEY_TEXT = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"


def _name(c: str) -> str:
    out = KEY_TEXT.format(c)
    for spaced, form in text.LEGAL_FORMS:
        out = rf"regexp_replace({out}, '\b{spaced}\b', '{form}', 'g')"
    return out


_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _phone(c: str) -> str:
    d = _DIGITS.format(c)
    cut = f"CASE WHEN {d} LIKE '0039%' THEN substr({d}, 5) WHEN length({d}) >= 11 AND {d} LIKE '39%' THEN substr({d}, 3) ELSE {d} END"
    return f"CASE WHEN length({cut}) >= 8 THEN {cut} END"


_HOST = r"regexp_replace(nullif(lower(regexp_extract({0}, '^https?://([^/:?#]+)', 1)), ''), '^www\.', '')"
_HAS = "coalesce(trim({0}) <> '', false)"
_REGIONS = ", ".join(f"('{p}', '{r.replace(chr(39), chr(39) * 2)}', '{m}')" for r, (m, all_) in tables.REGIONS.items() for p in all_.split())
_UNIVERSE = ", ".join(f"('{d}', '{p}', {n})" for d, p, n in tables.UNIVERSE)
_CROSS = ", ".join(f"('{d}', '{w}', {k})" for k, (d, w) in enumerate((d, w) for d, ws in tables.CROSSWALK.items() for w in ws))
_SECTORS = ", ".join(f"('{a}', '{b}')" for a, b in tables.SECTORS)
PLACED = f"""
regions(province, region, macro_area) AS (VALUES {_REGIONS}),
cross_words(division, token, ord) AS (VALUES {_CROSS}),
cats AS (SELECT category, arg_min(division, -length(token) * 1000 + ord) AS division FROM (SELECT DISTINCT category FROM leads) JOIN cross_words ON contains({KEY_TEXT.format('category')}, token) GROUP BY category),
placed AS (SELECT l.* REPLACE (upper(trim(coalesce(l.province, ''))) AS province), r.region, r.macro_area, c.division,
  CASE WHEN r.region IS NULL THEN 'out_of_scope' WHEN c.division IS NULL THEN 'unclassified' ELSE 'in_scope' END AS bucket
  FROM leads l LEFT JOIN regions r ON upper(trim(coalesce(l.province, ''))) = r.province LEFT JOIN cats c ON l.category = c.category)
"""
_PCT = "CASE WHEN {1} > 0 THEN floor(100.0::DOUBLE * {0} / {1} * 10 + 0.5) / 10 ELSE 0.0 END"
_SECTION = "CASE division " + " ".join(f"WHEN '{d}' THEN {tables.FACTORS.get(s, tables.DEFAULT_FACTOR)}::DOUBLE" for d, s in tables.SECTIONS.items()) + " ELSE 0.5::DOUBLE END"


def _metrics(source: str, least: int) -> str:
    return f"""
SELECT *, CASE WHEN need_for_target IS NULL THEN NULL ELSE floor((need_for_target * CASE WHEN sample_ok THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END + CASE WHEN sample_ok THEN 0 ELSE need_for_sample END) * 100 + 0.5) / 100 END AS priority FROM (
SELECT *, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, have::DOUBLE / addressable)) * 1000 + 0.5) / 1000 AS coverage, have >= {least} AS sample_ok,
  CASE WHEN addressable IS NOT NULL THEN greatest(0, ceil(0.6::DOUBLE * addressable) - have)::BIGINT END AS need_for_target, greatest(0, {least} - have)::BIGINT AS need_for_sample FROM ({source}))"""


_WITH = {"website": _HAS.format("website"), "phone": _HAS.format("phone"), "email": _HAS.format("email"), "pec": "coalesce(email_status = 'pec', false)", "vat": _HAS.format("vat_code")}
CELLS = f"""{PLACED},
universe(division, province, active_firms) AS (VALUES {_UNIVERSE}), sectors(division, member) AS (VALUES {_SECTORS}),
groups AS (SELECT * FROM sectors UNION SELECT DISTINCT division, division FROM universe WHERE division NOT IN (SELECT division FROM sectors)),
uni AS (SELECT g.division, u.province, sum(u.active_firms)::BIGINT AS firms, 'sample' AS provenance FROM groups g JOIN universe u ON g.member = u.division GROUP BY ALL),
grouped AS (SELECT macro_area, region, division, province, count(*) AS have, {", ".join(f"count_if({c}) AS with_{k}" for k, c in _WITH.items())} FROM placed WHERE bucket = 'in_scope' GROUP BY ALL),
base AS (SELECT g.*, u.firms, u.provenance, CASE WHEN u.firms IS NOT NULL THEN greatest(1, floor(u.firms * {_SECTION.replace("division", "g.division")} + 0.5))::BIGINT END AS addressable,
  {", ".join(f"{_PCT.format(f'with_{k}', 'have')} AS {k}_pct" for k in _WITH)} FROM grouped g LEFT JOIN uni u ON g.division = u.division AND g.province = u.province),
cells AS ({_metrics("SELECT *, floor((website_pct + phone_pct + email_pct + pec_pct + vat_pct) / 5 * 10 + 0.5) / 10 AS enrichment FROM base", coverage.MIN_SAMPLE)})"""
ROLLUP = f"""{CELLS},
rollup_ AS ({_metrics("SELECT macro_area, region, division, sum(have)::BIGINT AS have, sum(addressable)::BIGINT AS addressable, count(*) AS cells, " + ", ".join(f"floor(sum({k}_pct * have) / sum(have) * 10 + 0.5) / 10 AS {k}_pct" for k in _WITH) + " FROM cells GROUP BY ALL", coverage.MIN_SAMPLE_REGION)})"""


# --- coverage ---------------------------------------------------------------------------------------------------


@query("q_coverage_cells", f"WITH {CELLS} SELECT * FROM cells", "leads")
def q_coverage_cells(spark, sf):
    return coverage.cells(leads(spark, sf))


@query("q_region_rollup", f"WITH {ROLLUP} SELECT * FROM rollup_", "leads")
def q_region_rollup(spark, sf):
    return coverage.region_rollup(coverage.cells(leads(spark, sf)))


@query("q_gap_hierarchy", f"WITH {CELLS} SELECT macro_area, region, division, grouping_id(macro_area, region, division)::BIGINT AS level, sum(have)::BIGINT AS have FROM cells GROUP BY ROLLUP (macro_area, region, division)", "leads")
def q_gap_hierarchy(spark, sf):
    return coverage.hierarchy(coverage.cells(leads(spark, sf)))


@query("q_buckets", f"""WITH {PLACED} SELECT bucket, coalesce(CASE WHEN bucket = 'out_of_scope' THEN CASE WHEN province = '' THEN '—' ELSE province END
  WHEN bucket = 'unclassified' THEN CASE WHEN {_HAS.format('category')} THEN trim(category) ELSE 'sconosciuto' END END, 'all') AS key, count(*) AS n FROM placed GROUP BY ALL""", "leads")  # fmt: skip
def q_buckets(spark, sf):
    return coverage.buckets(leads(spark, sf))


@query("q_backlog", f"""WITH {ROLLUP},
places AS (SELECT region, division, string_agg(province, ',' ORDER BY r) AS provinces FROM (SELECT *, row_number() OVER (PARTITION BY region, division ORDER BY coalesce(priority, -1) DESC, province) AS r FROM cells) WHERE r <= 4 GROUP BY ALL),
acts AS (SELECT r.*, p.provinces, CASE WHEN coalesce(need_for_target > 0, false) OR NOT sample_ok THEN 'scrape' WHEN floor((website_pct + phone_pct + email_pct + pec_pct + vat_pct) / 5 * 10 + 0.5) / 10 < 50 THEN 'enrich' END AS action,
  concat_ws(',', CASE WHEN website_pct < 50 THEN 'website' END, CASE WHEN phone_pct < 50 THEN 'phone' END, CASE WHEN email_pct < 50 THEN 'email' END, CASE WHEN pec_pct < 50 THEN 'pec' END, CASE WHEN vat_pct < 50 THEN 'vat' END) AS weak_fields
  FROM rollup_ r JOIN places p ON r.region = p.region AND r.division = p.division)
SELECT row_number() OVER (ORDER BY CASE WHEN action = 'scrape' THEN 0 ELSE 1 END, CASE WHEN action = 'scrape' THEN coalesce(priority, -1) ELSE have END DESC, region, division) AS rank, action, region, division, have, priority, provinces, weak_fields,
  substr(regexp_replace(regexp_replace(strip_accents(lower(concat_ws('_', division, region))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug
FROM acts WHERE action IS NOT NULL QUALIFY rank <= 50""", "leads")  # fmt: skip
def q_backlog(spark, sf):
    return coverage.backlog(coverage.cells(leads(spark, sf)))


# --- dashboard --------------------------------------------------------------------------------------------------

_FIELDS = ["company_name", "website", "phone", "email", "vat_code", "revenue", "employees", "rating"]


@query("q_metrics", " UNION ALL ".join(f"SELECT '{f}' AS field, count_if({_HAS.format(f)}) AS filled, count(*) AS total, {_PCT.format(f'count_if({_HAS.format(f)})', 'count(*)')} AS pct FROM leads" for f in _FIELDS), "leads")
def q_metrics(spark, sf):
    return reports.fill_rates(leads(spark, sf), _FIELDS)


@query("q_export_columns", " UNION ALL ".join(f"SELECT '{f}' AS field FROM leads HAVING {_PCT.format(f'count_if({_HAS.format(f)})', 'count(*)')} > 50" for f in _FIELDS), "leads")
def q_export_columns(spark, sf):
    return reports.fill_rates(leads(spark, sf), _FIELDS).filter("pct > 50").select("field")


@query("q_sources", "SELECT coalesce(source, '<unset>') AS value, count(*) AS n FROM leads GROUP BY ALL", "leads")
def q_sources(spark, sf):
    return reports.tally(leads(spark, sf), "source")


@query("q_coverage_province", f"SELECT CASE WHEN {_HAS.format('province')} THEN trim(province) ELSE '(none)' END AS province, count(*) AS n, count_if({_HAS.format('website')}) AS with_site FROM leads GROUP BY 1", "leads")
def q_coverage_province(spark, sf):
    return reports.by_province(leads(spark, sf))


@query("q_markets", f"""WITH each AS (SELECT category, province, count(*) AS n FROM leads WHERE {_HAS.format('province')} GROUP BY ALL),
top AS (SELECT category, first(province ORDER BY n DESC, province) AS top_province, count(*) AS provinces FROM each GROUP BY category)
SELECT l.category, count(*) AS n, any_value(top_province) AS top_province, any_value(provinces) AS provinces FROM leads l LEFT JOIN top USING (category) GROUP BY l.category""", "leads")  # fmt: skip
def q_markets(spark, sf):
    return reports.markets(leads(spark, sf))


@query("q_companies_page", f"SELECT seq, company_name, city FROM leads WHERE {_HAS.format('website')} ORDER BY seq LIMIT 50 OFFSET 20", "leads")
def q_companies_page(spark, sf):
    return reports.page(leads(spark, sf), 50, 20, True).select("seq", "company_name", "city")


# --- keys and entities ------------------------------------------------------------------------------------------

_PLACE = KEY_TEXT.format("coalesce(city, '')")
_STREET = f"array_to_string(list_slice(list_filter(string_split({KEY_TEXT.format('address')}, ' '), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+')), 1, 2), ' ')"
KEYED = f"""keyed AS (SELECT *, {_phone("nullif(phone, '')")} AS k_phone,
  CASE WHEN length({_name('company_name')}) >= 3 AND length({_PLACE}) >= 2 THEN concat_ws('|', {_name('company_name')}, {_PLACE}) END AS k_name_city,
  CASE WHEN length({_name('company_name')}) >= 3 AND {_STREET} <> '' THEN concat_ws('|addr:', {_name('company_name')}, {_STREET}) END AS k_name_addr,
  {_HOST.format("nullif(website, '')")} AS k_host FROM leads)"""
_ALIASES = " UNION ALL ".join(f"SELECT seq, '{k}' AS key_type, k_{k} AS alias FROM keyed WHERE k_{k} IS NOT NULL" for k in ("phone", "name_city", "name_addr", "host"))


@query("q_dedup_keys", f"WITH {KEYED} SELECT seq, k_phone, k_name_city, k_name_addr, k_host, coalesce('phone:' || k_phone, 'name_city:' || k_name_city, 'name_addr:' || k_name_addr, 'host:' || k_host) AS dedup_key FROM keyed", "leads")
def q_dedup_keys(spark, sf):
    return resolve.canonical_key(keyed(spark, sf)).select("seq", *resolve.KEYS, "dedup_key")


@query("q_alias_counts", f"WITH {KEYED}, a AS ({_ALIASES}) SELECT key_type, count(*) AS n, count(DISTINCT alias) AS distinct_keys FROM a GROUP BY ALL", "leads")
def q_alias_counts(spark, sf):
    return resolve.aliases(keyed(spark, sf)).groupBy("key_type").agg(F.count("*").alias("n"), F.count_distinct("alias").alias("distinct_keys"))


@query("q_dedupe_components", f"""WITH RECURSIVE {KEYED}, a AS ({_ALIASES}), f AS (SELECT key_type, alias, min(seq) AS first FROM a GROUP BY ALL),
e AS (SELECT DISTINCT seq AS x, first AS y FROM a JOIN f USING (key_type, alias) WHERE seq <> first), both_ AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT seq AS x, seq AS root FROM leads UNION SELECT b.y, r.root FROM r JOIN both_ b ON b.x = r.x WHERE r.root < b.y)
SELECT x AS seq, min(root) AS entity FROM r GROUP BY x""", "leads")  # fmt: skip
def q_dedupe_components(spark, sf):
    return resolve.components(keyed(spark, sf))


@query("q_dedupe_merged")
def q_dedupe_merged(spark, sf):
    rows = keyed(spark, sf)
    return resolve.merge_components(rows, resolve.components(rows), ["company_name", "city", "phone", "website", "email", "vat_code"])


@query("q_dedupe_exact")
def q_dedupe_exact(spark, sf):
    return resolve.dedupe_ordered(keyed(spark, sf))


_SORTED = f"list_sort(list_filter(string_split({_name('company_name')}, ' '), lambda t: t <> ''))"
_DOMAIN = r"CASE WHEN k_host LIKE '%.%' THEN regexp_extract(k_host, '([^.]+\.[^.]+)$', 1) END"


@query("q_review_pairs", f"""WITH {KEYED}, k AS (SELECT *, CASE WHEN len({_SORTED}) >= 2 AND length({_PLACE}) >= 2 THEN concat_ws('|', array_to_string({_SORTED}, ' '), {_PLACE}) END AS k_sorted, {_DOMAIN} AS k_domain FROM keyed),
w AS (SELECT 'token_sort_name_city' AS rule, k_sorted AS key, first(seq) OVER x AS existing, first(k_name_city) OVER x AS f, seq AS incoming, k_name_city AS own FROM k WHERE k_sorted IS NOT NULL WINDOW x AS (PARTITION BY k_sorted ORDER BY seq)),
h AS (SELECT 'shared_registrable_host' AS rule, k_domain AS key, first(seq) OVER x AS existing, first(k_name_city) OVER x AS f, seq AS incoming, k_name_city AS own FROM k WHERE k_domain IS NOT NULL WINDOW x AS (PARTITION BY k_domain ORDER BY seq))
SELECT rule, key, existing, incoming FROM (SELECT * FROM w UNION ALL SELECT * FROM h) WHERE existing <> incoming AND f IS DISTINCT FROM own""", "leads")  # fmt: skip
def q_review_pairs(spark, sf):
    return resolve.review_pairs(keyed(spark, sf))


_UP = "SELECT {0} AS key, {1} FROM keyed WHERE {2} AND {0} IS NOT NULL GROUP BY ALL"
_FIRST = ", ".join(f"first(nullif({c}, '') ORDER BY seq) FILTER (WHERE {c} <> '') AS {c}" for c in ("company_name", "phone", "email"))


@query("q_upsert", f"""WITH {KEYED}, s AS (SELECT k_host AS key, {_FIRST} FROM keyed WHERE seq % 2 = 0 AND k_host IS NOT NULL GROUP BY k_host), i AS (SELECT k_host AS key, {_FIRST} FROM keyed WHERE seq % 2 = 1 AND k_host IS NOT NULL GROUP BY k_host)
SELECT coalesce(s.key, i.key) AS k_host, {", ".join(f"coalesce(nullif(s.{c}, ''), i.{c}) AS {c}" for c in ("company_name", "phone", "email"))}, CASE WHEN s.key IS NULL THEN 'inserted' ELSE 'kept' END AS state FROM s FULL JOIN i ON s.key = i.key""", "leads")  # fmt: skip
def q_upsert(spark, sf):
    rows, columns = keyed(spark, sf), ["company_name", "phone", "email"]
    store = resolve.upsert(rows.limit(0).select("k_host", *columns), rows.filter("seq % 2 = 0"), "k_host", columns).drop("state")
    return resolve.upsert(store, rows.filter("seq % 2 = 1"), "k_host", columns)


@query("q_novel", f"WITH {KEYED}, a AS ({_ALIASES}) SELECT seq FROM keyed WHERE seq % 3 = 0 AND seq NOT IN (SELECT n.seq FROM a n JOIN a k ON n.key_type = k.key_type AND n.alias = k.alias AND k.seq % 3 <> 0 WHERE n.seq % 3 = 0)", "leads")
def q_novel(spark, sf):
    rows = keyed(spark, sf)
    return resolve.novel(rows.filter("seq % 3 = 0"), rows.filter("seq % 3 <> 0")).select("seq")


# --- joins ------------------------------------------------------------------------------------------------------

_LISTED = "listed AS (SELECT DISTINCT regexp_replace(phone, '[^0-9]', '', 'g') AS key FROM portal WHERE phone IS NOT NULL)"
_SUPPRESSED = f"hit AS (SELECT DISTINCT seq FROM leads JOIN listed ON key IN ({_phone('phone').replace('>= 8', '>= 6')}, nullif(regexp_replace(regexp_replace(trim(coalesce(vat_code, '')), '^(?i:it)', ''), '[^0-9]', '', 'g'), '')))"


def _listed(spark, sf):
    return tables.view(spark, sf, "portal").filter("phone is not null").select(contact.digits(F.col("phone")).alias("key"))


@query("q_suppression_kept", f"WITH {_LISTED}, {_SUPPRESSED} SELECT seq FROM leads WHERE seq NOT IN (SELECT seq FROM hit)", "leads", "portal")
def q_suppression_kept(spark, sf):
    return match.suppress(leads(spark, sf), _listed(spark, sf))[0].select("seq")


@query("q_suppression_dropped", f"WITH {_LISTED}, {_SUPPRESSED} SELECT seq FROM leads WHERE seq IN (SELECT seq FROM hit)", "leads", "portal")
def q_suppression_dropped(spark, sf):
    return match.suppress(leads(spark, sf), _listed(spark, sf))[1].select("seq")


_TOKENS = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda t: length(t) > 2 AND t NOT IN ('srl', 'srls', 'spa', 'snc', 'sas', 'sapa', 'scarl', 'scrl', 'soc', 'coop'))))"
_SHARED = "len(list_intersect(r.words, o.words))"
_LIKE = f"CASE {_SHARED} WHEN 0 THEN false WHEN 1 THEN len(r.words) = 1 AND len(o.words) = 1 ELSE {_SHARED} = len(r.words) OR {_SHARED} = len(o.words) OR {_SHARED}::DOUBLE / (len(r.words) + len(o.words) - {_SHARED}) >= 0.5 END"
_KEYS = f"{_phone('phone')} AS phone, nullif({KEY_TEXT.format('city')}, '') AS city, {_name('company_name')} AS name, {_TOKENS.format(_name('company_name'))} AS words"
PORTAL_MATCH = f"""own AS (SELECT seq, {_KEYS} FROM leads), rec AS (SELECT rec, coalesce(company_name <> '', false) AS named, {_KEYS} FROM portal),
p AS (SELECT rec, count(*) AS n, min(seq) AS seq, bool_and(NOT named OR coalesce({_LIKE}, false)) AS same, count_if({_LIKE}) AS likes, min(seq) FILTER (WHERE {_LIKE}) AS first FROM rec r JOIN own o ON r.phone = o.phone GROUP BY rec),
nc AS (SELECT rec, count(*) AS n, min(seq) AS seq FROM rec r JOIN own o ON r.name = o.name AND r.city = o.city WHERE length(r.name) >= 3 AND length(r.city) >= 2 GROUP BY rec),
fz AS (SELECT rec, count(*) AS n, min(seq) AS seq FROM rec r JOIN own o ON r.city = o.city WHERE {_LIKE} GROUP BY rec),
ways AS (SELECT r.rec, p.seq AS p_seq, p.first AS p_first, nc.seq AS nc_seq, fz.seq AS fz_seq, CASE WHEN p.n = 1 AND p.same THEN 'phone' WHEN p.n = 1 THEN 'mismatch' WHEN p.likes = 1 THEN 'phone_name' WHEN p.n > 1 THEN 'ambiguous'
  WHEN nc.n = 1 THEN 'name_city' WHEN fz.n = 1 THEN 'fuzzy' WHEN fz.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS how FROM rec r LEFT JOIN p ON r.rec = p.rec LEFT JOIN nc ON r.rec = nc.rec LEFT JOIN fz ON r.rec = fz.rec),
matches AS (SELECT rec, CASE how WHEN 'phone' THEN p_seq WHEN 'phone_name' THEN p_first WHEN 'name_city' THEN nc_seq WHEN 'fuzzy' THEN fz_seq END AS seq, how FROM ways)"""


@query("q_portal_join", f"WITH {PORTAL_MATCH} SELECT * FROM matches", "leads", "portal")
def q_portal_join(spark, sf):
    return match.match_portal(leads(spark, sf), tables.view(spark, sf, "portal"))


@query("q_portal_attach", f"""WITH {PORTAL_MATCH}, f AS (SELECT m.seq, first(listings ORDER BY o.rec) FILTER (WHERE listings IS NOT NULL) AS listings, count(*) AS portal_records FROM matches m JOIN portal o ON m.rec = o.rec WHERE m.seq IS NOT NULL GROUP BY m.seq)
SELECT seq, nullif(l.phone, '') AS phone, listings, portal_records FROM leads l JOIN f USING (seq)""", "leads", "portal")  # fmt: skip
def q_portal_attach(spark, sf):
    own, rec = leads(spark, sf), tables.view(spark, sf, "portal")
    return match.attach_portal(own, rec, match.match_portal(own, rec))


@query("q_portal_sidecar", f"WITH {PORTAL_MATCH} SELECT DISTINCT o.company_name, o.phone FROM portal o JOIN matches m ON o.rec = m.rec WHERE m.seq IS NULL AND o.phone IS NOT NULL AND o.company_name IS NOT NULL", "leads", "portal")
def q_portal_sidecar(spark, sf):
    rec = tables.view(spark, sf, "portal")
    lost = match.match_portal(leads(spark, sf), rec).filter("seq is null").select("rec")
    return rec.join(lost, "rec", "left_semi").filter("phone is not null and company_name is not null").select("company_name", "phone").distinct()


@query("q_outbound", f"""WITH k AS (SELECT *, concat_ws('|', {_phone('phone')}, {KEY_TEXT.format('city')}) AS k FROM leads WHERE {_phone('phone')} IS NOT NULL)
SELECT k, min(seq) AS seq, count(*) AS merged, {", ".join(f"first({c} ORDER BY seq) FILTER (WHERE {c} <> '') AS {c}" for c in ("company_name", "city", "phone", "email", "website"))}, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories FROM k GROUP BY k""", "leads")  # fmt: skip
def q_outbound(spark, sf):
    return match.outbound(leads(spark, sf))


_SNAPS = "a AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 2 = 1)"


def _snaps(spark, sf):
    o = tables.table(spark, sf, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("v"))
    b = o.filter("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("v"))
    return a, b


@query("q_compare", f"WITH {_SNAPS}, x AS (SELECT coalesce(v, '<unset>') AS value, count(*) AS n FROM a GROUP BY 1), y AS (SELECT coalesce(v, '<unset>') AS value, count(*) AS n FROM b GROUP BY 1) SELECT coalesce(x.value, y.value) AS value, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y ON x.value = y.value")
def q_compare(spark, sf):
    return match.compare(*_snaps(spark, sf), "k", "v")


@query("q_gains", f"WITH {_SNAPS}, x AS (SELECT k, arg_max_null(v, seq) AS v FROM a GROUP BY k), y AS (SELECT k, arg_max_null(v, seq) AS v FROM b GROUP BY k) SELECT y.k, y.v FROM y LEFT JOIN x ON x.k = y.k WHERE coalesce(y.v, '') <> '' AND coalesce(x.v, '') = ''")
def q_gains(spark, sf):
    return match.gains(*_snaps(spark, sf), "k", "v")


# --- scores -----------------------------------------------------------------------------------------------------

_NUM = r"rtrim(regexp_extract({0}, '(-?([0-9][0-9.,]*|[.,][0-9]+))', 1), '.,')"


def _number(c: str) -> str:
    t = _NUM.format(c)
    return rf"TRY_CAST(CASE WHEN regexp_full_match({t}, '-?[0-9]{{1,3}}(\.[0-9]{{3}})+(,[0-9]+)?') THEN replace(replace({t}, '.', ''), ',', '.') WHEN regexp_full_match({t}, '-?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?') THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END AS DOUBLE)"


_EMAIL_F = "CASE email_status WHEN 'deliverable' THEN 1.0::DOUBLE WHEN 'pec' THEN 0.9::DOUBLE WHEN 'catch_all' THEN 0.55::DOUBLE WHEN 'invalid' THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END"
_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0}))"
_IF = "CASE WHEN {0} THEN {1}::DOUBLE ELSE 0.0::DOUBLE END"
_ONE = lambda *names: _IF.format(" OR ".join(_HAS.format(c) for c in names), "1.0")
SCORES = f"""nums AS (SELECT *, {_number('rating')} AS r, coalesce({_number('reviews_count')}, 0.0::DOUBLE) AS v, coalesce(portal_listings_count::DOUBLE, 0.0::DOUBLE) AS found FROM leads),
scores AS (SELECT seq, company_name, floor({_CLAMP.format(f'''0.3::DOUBLE * {_IF.format(_HAS.format('email'), '(' + _EMAIL_F + ')')} + 0.15::DOUBLE * (CASE WHEN {_HAS.format('official_website')} THEN 1.0::DOUBLE WHEN {_HAS.format('website')} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)
 + 0.15::DOUBLE * 0.25::DOUBLE * ({_ONE('vat_code_final')} + {_ONE('revenue')} + {_ONE('employees', 'legal_form')} + {_ONE('decision_maker_name')}) + 0.1::DOUBLE * {_ONE('phone')}
 + 0.1::DOUBLE * CASE WHEN r BETWEEN 0 AND 5 THEN 0.3::DOUBLE + 0.7::DOUBLE * {_CLAMP.format('(r - 3) / 2')} * least(1.0::DOUBLE, log10(1 + v) / 2) ELSE 0.0::DOUBLE END
 + 0.1::DOUBLE * least(3.0::DOUBLE, {_ONE('instagram')} + {_ONE('facebook')} + {_ONE('linkedin')} + {_ONE('tiktok')}) / 3 + 0.05::DOUBLE * {_ONE('pec')}
 + 0.05::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, log10(1 + found) / 2) + 0.25::DOUBLE * {_IF.format("coalesce(portal_is_paid = 'true', false)", "1.0")} + 0.25::DOUBLE * {_IF.format("coalesce(portal_fiaip = 'true', false)", "1.0")})''')} * 1000 + 0.5) / 1000 AS score FROM nums)"""


@query("q_lead_score", f"WITH {SCORES} SELECT seq, score FROM scores", "leads")
def q_lead_score(spark, sf):
    return score.scored(leads(spark, sf)).select("seq", "score")


@query("q_rank_top", f"WITH {SCORES} SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, seq, score FROM scores QUALIFY rank <= 25", "leads")
def q_rank_top(spark, sf):
    return score.ranked(score.scored(leads(spark, sf)).select("seq", "score"), 25)


@query("q_score_quantiles", f"WITH {SCORES}, o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scores) SELECT share, score FROM o, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) s(share) WHERE i = least(floor(share * n), n - 1)", "leads")
def q_score_quantiles(spark, sf):
    return score.quantiles(score.scored(leads(spark, sf)), [0.1, 0.5, 0.9])


@query("q_score_histogram", f"WITH {SCORES} SELECT least(9, floor(score * 10))::BIGINT AS decile, count(*) AS n FROM scores GROUP BY 1", "leads")
def q_score_histogram(spark, sf):
    return score.histogram(score.scored(leads(spark, sf)))


# --- scalar functions -------------------------------------------------------------------------------------------


def _luhn(d: str) -> str:
    terms = []
    for i in range(11):
        digit = f"CAST(substr({d}, {i + 1}, 1) AS INTEGER)"
        terms.append(digit if i % 2 == 0 else f"(2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END)")
    return f"CASE WHEN regexp_full_match({d}, '[0-9]{{11}}') THEN ({' + '.join(terms)}) % 10 = 0 ELSE false END"


_VAT = "regexp_replace(regexp_replace(trim(coalesce(vat_code, '')), '^(?i:it)', ''), '[^0-9]', '', 'g')"


@query("q_vat_check", f"WITH d AS (SELECT seq, {_VAT} AS vat FROM leads) SELECT seq, vat, {_luhn('vat')} AS valid FROM d", "leads")
def q_vat_check(spark, sf):
    return leads(spark, sf).select("seq", contact.vat_digits(F.col("vat_code")).alias("vat"), contact.vat_valid(F.col("vat_code")).alias("valid"))


@query("q_phone_e164", f"""WITH d AS (SELECT seq, {_DIGITS.format('phone')} AS d FROM leads), n AS (SELECT seq, CASE WHEN d LIKE '0039%' THEN substr(d, 5) WHEN d LIKE '39%' AND length(d) >= 8 AND substr(d, 3, 1) IN ('0', '3') AND length(d) - 2 BETWEEN 6 AND 11 THEN substr(d, 3) ELSE d END AS n FROM d),
k AS (SELECT seq, n, CASE WHEN length(n) BETWEEN 6 AND 11 THEN CASE WHEN n LIKE '0%' THEN 'landline' WHEN n LIKE '3%' THEN CASE WHEN length(n) BETWEEN 9 AND 10 THEN 'mobile' END WHEN regexp_matches(n, '^(800|199|892|899|144|166)') THEN 'service' END END AS kind FROM n)
SELECT seq, kind, CASE WHEN kind IS NOT NULL THEN concat('+39', n) END AS e164 FROM k""", "leads")  # fmt: skip
def q_phone_e164(spark, sf):
    return leads(spark, sf).select("seq", contact.phone_kind(F.col("phone")).alias("kind"), contact.phone_e164(F.col("phone")).alias("e164"))


@query("q_normalize", rf"""SELECT seq, {KEY_TEXT.format('company_name')} AS plain, {_name('company_name')} AS name_key, {_HOST.format('website')} AS host, regexp_replace(regexp_extract(website, '^https?://(?:www\.)?([^?#]*)', 1), '/+$', '') AS url_key,
 regexp_extract({_HOST.format('website')}, '([^.]+\.[^.]+)$', 1) AS domain, coalesce({_HOST.format('website')} = 'facebook.com', false) AS directory FROM leads WHERE website IS NOT NULL""", "leads")  # fmt: skip
def q_normalize(spark, sf):
    site, name = F.col("website"), F.col("company_name")
    rows = leads(spark, sf).filter("website is not null")
    return rows.select("seq", text.key_text(name).alias("plain"), text.company_key_text(name).alias("name_key"), contact.host(site).alias("host"), contact.canonical_url(site).alias("url_key"), contact.registrable_domain(site).alias("domain"), contact.is_directory_host(site).alias("directory"))


_Q = "({0} + {1} + {2} + {3} + {4} + {5})"


@query("q_quality", f"""WITH q AS (SELECT seq, company_name, website, {_VAT} AS vat, {_IF.format(_HAS.format('company_name') + ' AND ' + _HAS.format('city'), '0.5')} + {_IF.format(r"coalesce(regexp_full_match(email, '[^@\s]+@[^@\s]+\.[^@\s]+'), false)", '0.2')} + {_IF.format(_HAS.format('vat_code'), '0.2')}
 + {_IF.format(_HAS.format('website'), '0.15')} + {_IF.format(_HAS.format('phone') + ' OR ' + _HAS.format('address'), '0.1')} + {_IF.format(_HAS.format('province'), '0.05')} AS t FROM leads),
u AS (SELECT *, CASE WHEN {_HAS.format('company_name')} AND {_HAS.format('website')} AND {_luhn('vat')} THEN greatest(t, 0.85::DOUBLE) ELSE t END AS u FROM q)
SELECT seq, floor(CASE WHEN u = 0 THEN {_IF.format(_HAS.format('company_name'), '0.1')} ELSE least(u, 1.0::DOUBLE) END * 1000 + 0.5) / 1000 AS quality FROM u""", "leads")  # fmt: skip
def q_quality(spark, sf):
    return leads(spark, sf).select("seq", score.quality().alias("quality"))


@query("q_pec", r"SELECT seq, coalesce(regexp_matches(lower(email), '@(?:.*\.)?(?:pec|legalmail|arubapec|postacert|pecmail|cert)\b'), false) AS pec, CASE WHEN email IS NULL THEN NULL WHEN email LIKE '%@pec.it' THEN 'pec' WHEN email LIKE 'info@%' THEN 'generic' ELSE 'personal' END AS kind FROM leads", "leads")
def q_pec(spark, sf):
    return leads(spark, sf).select("seq", contact.is_pec(F.col("email")).alias("pec"), contact.email_type(F.col("email")).alias("kind"))


@query("q_money", "SELECT seq, (CASE revenue WHEN '1,5 mln' THEN 1500000 WHEN '200.000' THEN 200000 WHEN '€ 1.500.000' THEN 1500000 END)::BIGINT AS revenue, CASE employees WHEN 'da 10 a 19' THEN '10-19' WHEN 'oltre 50' THEN '50+' END AS employees FROM leads", "leads")
def q_money(spark, sf):
    return leads(spark, sf).select("seq", numbers.parse_revenue(F.col("revenue")).alias("revenue"), numbers.employee_range(F.col("employees")).alias("employees"))


@query("q_mojibake", "SELECT doc_id, coalesce(regexp_matches(text, '[ÃÂ][\u0080-¿]|â€|�'), false) AS broken FROM documents")
def q_mojibake(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", text.has_mojibake(F.col("text")).alias("broken"))


@query("q_email_extract", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM documents WHERE contains(text, '@')")
def q_email_extract(spark, sf):
    rows = tables.table(spark, sf, "documents").filter(F.col("text").contains("@"))
    return rows.select("doc_id", F.array_join(F.array_sort(contact.emails(F.col("text"))), ",").alias("emails"))


# --- gates and cascades -----------------------------------------------------------------------------------------

#: Fixed values, as the rule states them: words of each business model.
_MODEL = r"""CASE
 WHEN regexp_matches(lower(coalesce(category, '')) || ' ', 'manifatt|industr|meccanic|metalmecc|produzione|produttor|component|impiant|stamp|lavorazione|utensil|macchinari|arredo|serrament|automazione|fonderia|plastica|gomma') THEN 'B2B_manufacturing'
 WHEN regexp_matches(lower(coalesce(category, '')) || ' ', 'dentist|odontoiatr|medic|clinic|poliambulator|fisioterap|studio (?:legale|tecnico|dentistico|medico)|avvocat|commercialist|architett|ingegner|notai|veterinar|psicolog|centro (?:medico|estetico|specializzato)') THEN 'professional_local'
 WHEN regexp_matches(lower(coalesce(category, '')) || ' ', 'ristorant|pizzeri|trattoria|osteria|hotel|albergo|\bb&b\b|agriturismo|bar\b|catering|gelateria|pasticceria|caff[eè]|resort|ricettiv') THEN 'hospitality_retail'
 WHEN regexp_matches(lower(coalesce(category, '')) || ' ', 'e-?commerce|negozio|\bshop\b|store|abbigliament|calzatur|gioieller|cosmesi|profumeria|alimentar|enotec|cantina|food|moda|design (?:prodotto)?') THEN 'B2C_product'
 ELSE 'unknown' END"""


@query("q_gates", f"""SELECT seq, {_MODEL} AS model, CASE WHEN regexp_matches(lower(category), 'rivendit|dropship|intermediazion|grossist') THEN 'pure_reseller' WHEN NOT ({_HAS.format('company_name')} OR {_HAS.format('website')} OR {_HAS.format('vat_code')}) THEN 'no_identity' END AS disqualifier,
 CASE WHEN contains({KEY_TEXT.format('category')}, 'agenzie') OR contains({KEY_TEXT.format('category')}, 'immobiliari') THEN 'confirmed' ELSE 'mismatch' END AS category_match FROM leads""", "leads")  # fmt: skip
def q_gates(spark, sf):
    rows = leads(spark, sf)
    why = gates.disqualifier(F.lit(False), F.col("category"), F.col("company_name"), F.col("website"), F.col("vat_code"))
    return rows.select("seq", gates.business_model(F.col("category")).alias("model"), why.alias("disqualifier"), gates.category_match(F.lit("agenzie immobiliari"), F.col("category")).alias("category_match"))


@query("q_ladder", """WITH o AS (SELECT user_id AS lead, event_id AS ord, event_type AS stage, value > 90 AS found, CASE WHEN value < 10 THEN 'DISCOVERY_EXHAUSTED' WHEN value < 30 THEN 'DIRECTORY_SITE' END AS reason FROM events)
SELECT lead, CASE WHEN bool_or(found) THEN 'FOUND_WEBSITE_ONLY' ELSE 'NOT_FOUND' END AS status, first(stage ORDER BY ord) FILTER (WHERE found) AS stage,
 CASE WHEN bool_or(found) THEN 'FOUND_WEBSITE_ONLY' ELSE coalesce(first(reason ORDER BY ord) FILTER (WHERE reason = 'DIRECTORY_SITE'), last(reason ORDER BY ord) FILTER (WHERE reason IS NOT NULL), 'DISCOVERY_EXHAUSTED') END AS reason FROM o GROUP BY lead""")  # fmt: skip
def q_ladder(spark, sf):
    e, v = tables.table(spark, sf, "events"), F.col("value")
    return cascade.ladder_status(e.select(F.col("user_id").alias("lead"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), (v > 90).alias("found"), F.when(v < 10, "DISCOVERY_EXHAUSTED").when(v < 30, "DIRECTORY_SITE").alias("reason")))


@query("q_cascade")
def q_cascade(spark, sf):
    e, v = tables.table(spark, sf, "events"), F.col("value")
    steps = e.select(F.col("user_id").alias("lead"), F.lit("email").alias("field"), F.col("event_id").alias("ord"), (F.col("event_id") % 5 != 0).alias("enabled"), (F.col("event_id") % 3).cast("int").alias("tier"), F.when(F.col("event_id") % 3 == 1, 0.02).otherwise(0.0).alias("cost"), F.when(v > 10, F.col("event_type")).alias("value"), (v / 100).alias("confidence"))
    return cascade.run_cascade(steps)


# --- ledger -----------------------------------------------------------------------------------------------------


def ledger(spark, sf):
    return tables.view(spark, sf, "ledger")


@query("q_ledger_by_provider", f"SELECT provider, count(*) AS calls, floor(CAST(sum(CAST(cost_eur AS DECIMAL(18, 6))) AS DOUBLE) * 10000 + 0.5) / 10000 AS cost_eur, {_PCT.format('count_if(success)', 'count(*)')} AS success_pct, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("timeout", "empty", "blocked")) + " FROM ledger GROUP BY provider", "ledger")
def q_ledger_by_provider(spark, sf):
    return reports.ledger_by_provider(ledger(spark, sf))


@query("q_dead_providers", "WITH k AS (SELECT provider, kind, count(*) AS n, count_if(success) AS ok FROM ledger GROUP BY ALL) SELECT provider, sum(n)::BIGINT AS calls, first(kind ORDER BY n DESC, kind) AS main_kind FROM k GROUP BY provider HAVING sum(n) >= 10 AND sum(ok) = 0", "ledger")
def q_dead_providers(spark, sf):
    return reports.dead_providers(ledger(spark, sf))


@query("q_cost_per_lead", "SELECT lead_id, count(*) AS calls, floor(CAST(sum(CAST(cost_eur AS DECIMAL(18, 6))) AS DOUBLE) * 10000 + 0.5) / 10000 AS cost_eur FROM ledger GROUP BY lead_id", "ledger")
def q_cost_per_lead(spark, sf):
    return reports.cost_per_lead(ledger(spark, sf))


@query("q_running_budget", "WITH s AS (SELECT seq, lead_id, floor(CAST(sum(CAST(cost_eur AS DECIMAL(18, 6))) OVER (PARTITION BY lead_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 10000 + 0.5) / 10000 AS spent FROM ledger) SELECT *, spent <= 0.5::DOUBLE AS within FROM s", "ledger")
def q_running_budget(spark, sf):
    return reports.running_budget(ledger(spark, sf), 0.5)


def _runs(spark, sf):
    e = tables.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd HH").alias("run")).agg(F.count_if(F.col("value") > 60).alias("yield"))


_RUNS = "runs AS (SELECT event_type AS category, strftime(ts, '%Y-%m-%d %H') AS run, count_if(value > 60) AS yield FROM events GROUP BY ALL)"


@query("q_yield_anomaly", f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY run DESC) AS r FROM runs), h AS (SELECT category, avg(yield) AS mean FROM r WHERE r > 1 AND yield > 0 GROUP BY category)
SELECT category, run, yield, floor(mean * 1000 + 0.5) / 1000 AS mean, coalesce(yield < 0.3::DOUBLE * mean, false) AS suspect FROM r LEFT JOIN h USING (category) WHERE r = 1""")  # fmt: skip
def q_yield_anomaly(spark, sf):
    return reports.yield_anomalies(_runs(spark, sf))


@query("q_stalls", f"WITH {_RUNS}, i AS (SELECT *, sum(CASE WHEN yield > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY run ROWS UNBOUNDED PRECEDING) AS island FROM runs) SELECT category, min(run) AS from_run, count(*) AS length FROM i WHERE yield = 0 GROUP BY category, island HAVING count(*) >= 1")
def q_stalls(spark, sf):
    return reports.stalls(_runs(spark, sf), 1)


# --- evaluation and judgment ------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT quality AS expected, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id))"


def _pairs(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("predicted"))
    return tables.table(spark, sf, "labels").join(docs, "doc_id").select(F.col("quality").alias("expected"), "predicted")


@query("q_confusion", f"WITH {_PAIRS} SELECT expected, predicted, count(*) AS n FROM pairs GROUP BY ALL")
def q_confusion(spark, sf):
    return reports.confusion(_pairs(spark, sf))


@query("q_eval", f"""WITH {_PAIRS}, c AS (SELECT count(*) AS n, count_if(expected = predicted)::DOUBLE AS ok, count_if(expected = 1 AND predicted = 1)::DOUBLE AS tp, count_if(expected = 0 AND predicted = 1)::DOUBLE AS fp, count_if(expected = 1 AND predicted = 0)::DOUBLE AS fn FROM pairs)
SELECT n, floor(ok / n * 10000 + 0.5) / 10000 AS accuracy, floor(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END * 10000 + 0.5) / 10000 AS precision, floor(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END * 10000 + 0.5) / 10000 AS recall,
 floor(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END * 10000 + 0.5) / 10000 AS f1 FROM c""")  # fmt: skip
def q_eval(spark, sf):
    return reports.evaluation(_pairs(spark, sf))


@query("q_category_profile", """WITH s AS (SELECT event_type AS category, user_id AS company, value > 10 AS present, value FROM events), o AS (SELECT category, list_sort(list(value)) AS v FROM s WHERE value IS NOT NULL GROUP BY category),
c AS (SELECT category, count(DISTINCT company) AS companies, count(DISTINCT company) FILTER (WHERE present) AS w FROM s GROUP BY category)
SELECT category, companies, floor(w::DOUBLE / companies * 1000 + 0.5) / 1000 AS presence, floor((v[((len(v) - 1) // 2) + 1] + v[(len(v) // 2) + 1]) / 2 * 1000 + 0.5) / 1000 AS p50, v[CAST(floor(0.9::DOUBLE * (len(v) - 1) + 0.5) AS BIGINT) + 1] AS p90, companies < 8 AS provisional FROM c JOIN o USING (category)""")  # fmt: skip
def q_category_profile(spark, sf):
    e = tables.table(spark, sf, "events")
    return reports.category_profile(e.select(F.col("event_type").alias("category"), F.col("user_id").alias("company"), (F.col("value") > 10).alias("present"), "value"))


_STATES = ["strong", "moderate", "weak", "excellence", "mediocrity", "absence"]
SIGNALS = """signals AS (SELECT user_id AS company, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS axis, event_id % 10 AS dimension,
 CASE WHEN event_id % 2 = 0 THEN CASE WHEN value > 40 THEN 'strong' WHEN value > 15 THEN 'moderate' WHEN value > 5 THEN 'weak' ELSE 'unknown' END ELSE CASE WHEN value > 60 THEN 'excellence' WHEN value > 30 THEN 'mediocrity' WHEN value > 5 THEN 'absence' ELSE 'unknown' END END AS state,
 CASE WHEN event_id % 3 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM events)"""


def _signals(spark, sf):
    e = tables.table(spark, sf, "events")
    v = F.col("value")
    a = F.when(v > 40, "strong").when(v > 15, "moderate").when(v > 5, "weak").otherwise("unknown")
    b = F.when(v > 60, "excellence").when(v > 30, "mediocrity").when(v > 5, "absence").otherwise("unknown")
    even = F.col("event_id") % 2 == 0
    return e.select(F.col("user_id").alias("company"), F.when(even, "A").otherwise("B").alias("axis"), (F.col("event_id") % 10).alias("dimension"), F.when(even, a).otherwise(b).alias("state"), F.when(F.col("event_id") % 3 == 0, 0.6).otherwise(1.0).alias("weight"))


_LEVEL = "CASE WHEN {0} >= 0.66 THEN '+' WHEN {0} >= 0.40 THEN '?' WHEN {0} IS NOT NULL THEN '-' ELSE 'unknown' END"
JUDGED = f"""{SIGNALS}, v AS (SELECT *, CASE state WHEN 'strong' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.6::DOUBLE WHEN 'weak' THEN 0.15::DOUBLE WHEN 'excellence' THEN 1.0::DOUBLE WHEN 'mediocrity' THEN 0.45::DOUBLE WHEN 'absence' THEN 0.05::DOUBLE END AS v FROM signals),
g AS (SELECT company, floor(sum(v * weight) FILTER (WHERE axis = 'A') / sum(weight) FILTER (WHERE axis = 'A' AND v IS NOT NULL) * 1000 + 0.5) / 1000 AS a, floor(sum(v * weight) FILTER (WHERE axis = 'B') / sum(weight) FILTER (WHERE axis = 'B' AND v IS NOT NULL) * 1000 + 0.5) / 1000 AS b,
 count_if(axis = 'A' AND v IS NOT NULL)::DOUBLE / greatest(1, count_if(axis = 'A')) AS ka, count_if(axis = 'B' AND v IS NOT NULL)::DOUBLE / greatest(1, count_if(axis = 'B')) AS kb FROM v GROUP BY company),
judged AS (SELECT company, a, b, concat({_LEVEL.format('a')}, '/', {_LEVEL.format('b')}) AS quadrant, CASE WHEN a IS NULL OR b IS NULL THEN 'borderline' WHEN a < 0.40 AND b >= 0.66 THEN 'no' WHEN a >= 0.60 AND a - b >= 0.30::DOUBLE THEN 'yes' WHEN a >= 0.5 AND a - b >= 0.30::DOUBLE - 0.10::DOUBLE THEN 'borderline' ELSE 'no' END AS target,
 floor({_CLAMP.format('0.3::DOUBLE + 0.7::DOUBLE * (ka + kb) / 2')} * 1000 + 0.5) / 1000 AS confidence FROM g)"""


@query("q_judge_axes", f"WITH {JUDGED} SELECT * FROM judged")
def q_judge_axes(spark, sf):
    return reports.judge(_signals(spark, sf))


@query("q_quadrants", f"WITH {JUDGED} SELECT quadrant, target, count(*) AS n FROM judged GROUP BY ALL")
def q_quadrants(spark, sf):
    return reports.judge(_signals(spark, sf)).groupBy("quadrant", "target").agg(F.count("*").alias("n"))


# --- pages and domains ------------------------------------------------------------------------------------------


@query("q_page_links", """SELECT page_id, (i - 1)::INTEGER AS place, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def q_page_links(spark, sf):
    return pages.links(tables.table(spark, sf, "pages"))


@query("q_page_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def q_page_title(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("q_page_flags", rf"""WITH t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS shown,
  regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host, concat(host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')) AS key, length(shown) < {pages.TINY} AS tiny,
  regexp_matches(lower(concat(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ', shown)), '{"|".join(pages.PARKED)}') AS parked,
  len(list_filter([{", ".join(f"'{h}'" for h in contact.DIRECTORY_HOSTS)}], lambda d: host = d OR ends_with(host, '.' || d))) > 0 AS directory FROM t""")
def q_page_flags(spark, sf):
    return pages.page_flags(tables.table(spark, sf, "pages"))


@query("q_page_contacts")
def q_page_contacts(spark, sf):
    out = pages.contacts(tables.table(spark, sf, "pages"))
    return out.select("page_id", *[F.array_join(c, ",").alias(c) for c in ("emails", "pec", "vat_codes", "socials")])


@query("q_page_cards")
def q_page_cards(spark, sf):
    return pages.cards(tables.table(spark, sf, "pages"))


@query("q_serp_dedupe")
def q_serp_dedupe(spark, sf):
    p = tables.table(spark, sf, "pages")
    results = p.select((F.col("page_id") % 20).alias("query"), "url", F.concat(F.lit("p"), F.col("page_id") % 3).alias("provider"), (F.col("page_id") % 2).alias("batch"), F.col("page_id").alias("rank"))
    return pages.deduplicate_results(results)


@query("q_query_variants", """WITH v AS (SELECT seq, 1::BIGINT AS priority, concat('"', company_name, '" ', city) AS query FROM leads WHERE company_name IS NOT NULL UNION ALL SELECT seq, 2, concat_ws(' ', company_name, city, 'sito ufficiale') FROM leads WHERE company_name IS NOT NULL
 UNION ALL SELECT seq, 3, company_name || ' ' || vat_code FROM leads WHERE company_name IS NOT NULL UNION ALL SELECT seq, 4, '"' || nullif(phone, '') || '"' FROM leads WHERE company_name IS NOT NULL UNION ALL SELECT seq, 5, concat_ws(' ', company_name, category) FROM leads WHERE company_name IS NOT NULL)
SELECT seq, min(priority) AS priority, substr(query, 1, 200) AS query FROM v WHERE query IS NOT NULL GROUP BY seq, substr(query, 1, 200)""", "leads")  # fmt: skip
def q_query_variants(spark, sf):
    return domains.query_variants(leads(spark, sf))


@query("q_domain_candidates")
def q_domain_candidates(spark, sf):
    return domains.domain_candidates(tables.dealt(leads(spark, sf), "seq"))


@query("q_candidate_rank")
def q_candidate_rank(spark, sf):
    rows = tables.dealt(leads(spark, sf), "seq")
    return domains.rank_candidates(domains.domain_candidates(rows), rows)


# --- streaming --------------------------------------------------------------------------------------------------


def _stream(spark, sf):
    from leadloom.storage import materialize

    # A stream reads folders; the table is copied into one so that the source is the same wherever the table lies.
    rows = materialize(tables.table(spark, sf, "events").drop("props"), "event-files")
    return live.event_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema, None)


@query("s_window_ledger", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS provider, count(*) AS calls, count_if(event_type = 'error') AS errors FROM events GROUP BY ALL")
def s_window_ledger(spark, sf):
    out = live.run_once(live.windowed_ledger(_stream(spark, sf)), "windows", "complete")
    last = out.agg(F.max("batch")).first()[0]  # in complete mode the last batch is the whole result
    return out.filter(F.col("batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "provider", "calls", "errors")


@query("s_unique_events", "SELECT count(DISTINCT event_id) AS n FROM events")
def s_unique_events(spark, sf):
    return live.run_once(live.unique_events(_stream(spark, sf)), "unique", "append").agg(F.count("*").alias("n"))


@query("s_live_ingest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def s_live_ingest(spark, sf):
    return live.live_upsert(_stream(spark, sf), "user_id", "event_id").select("user_id", "event_id")


@query("s_breaker")
def s_breaker(spark, sf):
    out = live.run_once(live.breaker(_stream(spark, sf)), "breaker", "update")
    return out.groupBy("user_id").agg(F.sum("calls").alias("calls"), F.sum("rejected").alias("rejected"))
