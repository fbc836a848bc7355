"""Queries of websites, names, mailboxes, views and judgment, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.functions.contact import DIRECTORY_HOSTS
from leadloom.operators import judgment, people, reports, views, website
from leadloom.plans.queries import _HAS, _PCT, _REGIONS, leads, query
from leadloom.sources import tables


def sites(spark, sf):
    return tables.dealt(tables.view(spark, sf, "sites"), "seq")


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- websites ---------------------------------------------------------------------------------------------------

_SITE = f"""u AS (SELECT *, CASE WHEN regexp_matches(lower(trim(url)), '^[a-z]+://') THEN trim(url) ELSE concat('https://', ltrim(trim(url), '/')) END AS full_url FROM sites),
m AS (SELECT *, regexp_extract(full_url, '(?i)^(https?)://([^/:?#]+)(:[0-9]+)?([^?#]*)', ['s', 'h', 'p', 'q']) AS x FROM u),
parts AS (SELECT *, lower(x.s) AS s, lower(x.h) AS h, x.p AS p, rtrim(x.q, '/') AS q, regexp_replace(lower(x.h), '^www[.]', '') AS bare FROM m),
named AS (SELECT *, CASE WHEN trim(url) <> '' AND regexp_matches(h, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z]{{2,24}}$') THEN concat(s, '://', h, p, q) END AS normal FROM parts),
known AS (SELECT *, CASE WHEN normal IS NULL THEN 'INVALID' WHEN bare IN ('wa.me', 'whatsapp.com', 'api.whatsapp.com', 'chat.whatsapp.com', 't.me', 'telegram.me', 'linktr.ee', 'bit.ly', 'tinyurl.com') THEN 'MESSAGING_OR_REDIRECT'
  WHEN len(list_filter([{_in(DIRECTORY_HOSTS)}], lambda d: bare = d OR ends_with(bare, '.' || d))) > 0 THEN 'DIRECTORY_OR_SOCIAL' ELSE 'VALID' END AS class,
  CASE WHEN bare LIKE '%.co.uk' THEN regexp_extract(bare, '[^.]+[.]co[.]uk$') ELSE regexp_extract(bare, '[^.]+[.][^.]+$') END AS dom FROM named)"""
_TRY = """concat(s, '://', h, p, q), concat(s, '://', h, p), CASE WHEN s = 'http' THEN concat('https://', h, p, q) END, CASE WHEN s = 'http' THEN concat('https://', h, p) END,
  CASE WHEN bare <> h THEN concat(s, '://', bare, p, q) END, CASE WHEN bare <> h THEN concat(s, '://', bare, p) END, CASE WHEN bare <> h AND s = 'http' THEN concat('https://', bare, p, q) END, CASE WHEN bare <> h AND s = 'http' THEN concat('https://', bare, p) END,
  CASE WHEN bare = h THEN concat(s, '://www.', h, p) END, CASE WHEN bare = h AND s = 'http' THEN concat('https://www.', h, p) END,
  CASE WHEN dom <> bare THEN concat(s, '://', dom, p) END, CASE WHEN dom <> bare AND s = 'http' THEN concat('https://', dom, p) END, CASE WHEN dom <> bare THEN concat(s, '://www.', dom, p) END, CASE WHEN dom <> bare AND s = 'http' THEN concat('https://www.', dom, p) END"""


@query("q_website_class", f"WITH {_SITE} SELECT seq, class, normal FROM known", "sites")
def q_website_class(spark, sf):
    return sites(spark, sf).select("seq", website.website_class(F.col("url")).alias("class"), website.normal_url(F.col("url")).alias("normal"))


@query("q_website_candidates", f"""WITH {_SITE}, all_ AS (SELECT seq, list_filter([{_TRY}], lambda c: c IS NOT NULL) AS c FROM known WHERE class = 'VALID')
SELECT seq, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' ') AS candidates FROM all_""", "sites")  # fmt: skip
def q_website_candidates(spark, sf):
    # A filter would be moved below the dealing out of rows and make the addresses of all rows in the few tasks that read.
    line = text.bind(website.website_candidates(F.col("url")), lambda c: F.when(F.size(c) > 0, F.array(F.array_join(c, " "))))
    return sites(spark, sf).select("seq", F.explode(line).alias("candidates"))


@query("q_domain_has_name", f"""WITH {_SITE}, w AS (SELECT seq, regexp_replace(regexp_replace(bare, '[.][^.]*$', ''), '[^a-z0-9]', '', 'g') AS core, contains(bare, '.') AS dotted,
  list_filter(string_split(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 4 AND t NOT IN ({_in(website.GENERIC_WORDS)})) AS words FROM known)
SELECT seq, coalesce(dotted AND len(list_filter(words, lambda t: contains(core, t))) > 0, false) AS owned FROM w""", "sites")  # fmt: skip
def q_domain_has_name(spark, sf):
    return sites(spark, sf).select("seq", website.domain_has_name(F.col("url"), F.col("company_name")).alias("owned"))


@query("q_map_urls", """WITH g AS (SELECT seq, regexp_extract(map_url, '^https?://([^/?#]+)([^?#]*)', ['h', 'p']) AS x FROM sites),
k AS (SELECT seq, x.h AS h, x.p AS p, regexp_matches(x.h, '^(www[.]|maps[.])?google[.]([a-z]{2,3}|com[.][a-z]{2}|co[.][a-z]{2})$') AS own FROM g)
SELECT seq, coalesce(own AND (h LIKE 'maps.%' OR p = '/maps' OR p LIKE '/maps/%'), false) AS is_map, coalesce(own AND h NOT LIKE 'maps.%' AND p LIKE '/maps/place/%', false) AS is_place FROM k""", "sites")  # fmt: skip
def q_map_urls(spark, sf):
    return sites(spark, sf).select("seq", website.is_map_url(F.col("map_url")).alias("is_map"), website.is_map_place(F.col("map_url")).alias("is_place"))


# --- names and mailboxes ----------------------------------------------------------------------------------------

_PARTS = f"""n AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(company_name)), '[^a-z0-9&.\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM sites),
f AS (SELECT *, list_filter([{_in(people.LEGAL_FORMS)}], lambda f: contains(concat(' ', clean, ' '), concat(' ', f, ' ')))[1] AS form FROM n WHERE company_name IS NOT NULL),
r AS (SELECT *, CASE WHEN form IS NULL THEN clean ELSE trim(regexp_replace(concat(substr(concat(' ', clean, ' '), 1, instr(concat(' ', clean, ' '), concat(' ', form, ' '))), substr(concat(' ', clean, ' '), instr(concat(' ', clean, ' '), concat(' ', form, ' ')) + length(form) + 1)), '\\s+', ' ', 'g')) END AS normal FROM f),
t AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(normal, '[.&-]', ' ', 'g'), ' +'), lambda x: x <> '') AS words FROM r),
b AS (SELECT *, list_filter(words, lambda x: x NOT IN ({_in(people.DESCRIPTORS)})) AS own FROM t),
named_ AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE words END AS brand, CASE WHEN len(own) > 0 THEN list_filter(words, lambda x: x IN ({_in(people.DESCRIPTORS)})) ELSE [] END AS described FROM b)"""


@query("q_name_parts", f"WITH {_PARTS} SELECT seq, normal, form, array_to_string(described, ' ') AS described, array_to_string(brand, ' ') AS core FROM named_", "sites")
def q_name_parts(spark, sf):
    s = sites(spark, sf).filter("company_name is not null").select("seq", people.name_parts(F.col("company_name")).alias("p"))
    return s.select("seq", F.col("p.normalized").alias("normal"), F.col("p.legal_form").alias("form"), F.array_join("p.descriptors", " ").alias("described"), F.col("p.core").alias("core"))


@query("q_email_candidates", f"""WITH {_PARTS}, who AS (SELECT s.seq, CASE WHEN s.person <> '' THEN s.person WHEN len(p.described) = 0 AND len(p.brand) = 2 THEN array_to_string(p.brand, ' ') END AS who FROM sites s LEFT JOIN named_ p ON s.seq = p.seq),
w AS (SELECT seq, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(strip_accents(lower(who)), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS ws FROM who),
boxes AS (SELECT seq, unnest([{{'l': 'info', 'k': 'role', 'p': 0.55}}, {{'l': 'contatti', 'k': 'role', 'p': 0.45}}, {{'l': 'amministrazione', 'k': 'role', 'p': 0.3}}, {{'l': 'commerciale', 'k': 'role', 'p': 0.25}}, {{'l': 'segreteria', 'k': 'role', 'p': 0.2}},
  {{'l': CASE WHEN len(ws) > 1 THEN concat(ws[1], '.', ws[-1]) END, 'k': 'person.dot', 'p': 0.35}}, {{'l': CASE WHEN len(ws) > 1 THEN concat(ws[1][1], '.', ws[-1]) END, 'k': 'person.initial', 'p': 0.3}},
  {{'l': CASE WHEN len(ws) > 1 THEN concat(ws[1], ws[-1]) END, 'k': 'person.concat', 'p': 0.2}}, {{'l': CASE WHEN len(ws) > 1 THEN ws[-1] END, 'k': 'person.surname', 'p': 0.15}}]) AS x, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1) AS o FROM w)
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY x.p DESC, o)::INTEGER AS place, concat(x.l, '@rossi.it') AS email, x.k AS pattern, x.p::DOUBLE AS prior FROM boxes WHERE x.l IS NOT NULL""", "sites")  # fmt: skip
def q_email_candidates(spark, sf):
    s = sites(spark, sf).select("seq", people.email_candidates(F.lit("rossi.it"), F.col("company_name"), F.col("person")).alias("c"))
    return s.select("seq", F.posexplode("c").alias("k", "x")).select("seq", (F.col("k") + 1).alias("place"), "x.email", "x.pattern", "x.prior")


@query("q_best_email", """SELECT seq, CASE WHEN seq % 3 = 0 THEN concat('Info@d', seq % 50, '.it') WHEN seq % 5 = 0 THEN concat('z', seq, '@d.it') WHEN seq % 2 = 0 THEN concat('b', seq, '@d.it') ELSE concat('a', seq, '@d.it') END AS email FROM sites""", "sites")
def q_best_email(spark, sf):
    one = lambda v, t, c: F.struct(v.alias("value"), t.alias("type"), c.alias("confidence"))
    name = lambda c: F.concat(F.lit(c), F.col("seq"), F.lit("@d.it"))
    even, third = F.col("seq") % 2 == 0, F.col("seq") % 3 == 0
    last = F.when(third, F.concat(F.lit("Info@d"), F.col("seq") % 50, F.lit(".it"))).otherwise(name("z"))
    kind = F.when(~third & (F.col("seq") % 5 == 0), "generic").otherwise("personal")
    found = F.array(one(name("a"), F.lit("personal"), F.lit(70.0)), one(name("b"), F.lit("personal"), F.when(even, 90.0).otherwise(70.0)), one(last, kind, F.lit(None).cast("double")))
    return sites(spark, sf).select("seq", people.best_email(found).alias("email"))


_CODE = "CASE seq % {0} WHEN 0 THEN 250 WHEN 1 THEN 450 WHEN 2 THEN 550 ELSE NULL END"
_MAIL = f"SELECT seq, (seq % 11)::INTEGER AS mx, seq % 13 <> 0 AS probe, seq % 17 <> 0 AS reached, ({_CODE.format(3)})::INTEGER AS hi, ({_CODE.format(5)})::INTEGER AS sender, ({_CODE.format(4)})::INTEGER AS anyone, ({_CODE.format(7)})::INTEGER AS c1, ({_CODE.format(6)})::INTEGER AS c2, 550 AS c3, 250 AS c4 FROM sites"


@query("q_mail_verdict", f"""WITH a AS ({_MAIL}) SELECT seq, v[1] AS class, CASE WHEN v[1] = 'deliverable' THEN CASE WHEN c1 = 250 THEN 1::BIGINT ELSE 2::BIGINT END END AS place, v[2] AS note FROM (SELECT *,
 CASE WHEN mx = 0 THEN ['undeliverable', 'no_mx'] WHEN NOT probe THEN ['mx_only', 'probe_disabled'] WHEN NOT reached THEN ['unknown', 'smtp_unreachable'] WHEN hi IS DISTINCT FROM 250 THEN ['unknown', 'helo_' || hi] WHEN sender IS DISTINCT FROM 250 THEN ['unknown', 'mailfrom_' || sender]
 WHEN anyone = 250 THEN ['catch_all', 'accepts_any'] WHEN anyone = 450 THEN ['unknown', 'greylist'] WHEN c1 = 250 OR c2 = 250 THEN ['deliverable', 'rcpt_250'] WHEN c1 = 450 OR c2 = 450 THEN ['unknown', 'greylist'] ELSE ['undeliverable', 'rejected'] END AS v FROM a)""", "sites")  # fmt: skip
def q_mail_verdict(spark, sf):
    code = lambda m: F.expr(_CODE.format(m))
    s = F.col("seq")
    v = people.mail_verdict(s % 11, s % 13 != 0, s % 17 != 0, code(3), code(5), code(4), F.array(code(7), code(6), F.lit(550), F.lit(250)))
    return sites(spark, sf).select("seq", v.alias("v")).select("seq", "v.class", "v.place", "v.note")


_VAT = "lpad(cast((seq * 7919) % 1000003 AS VARCHAR(12)), CASE WHEN seq % 19 = 0 THEN 10 ELSE 11 END, '0')"
_LUHN = "list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN v[i]::INTEGER ELSE (CASE WHEN v[i]::INTEGER > 4 THEN 2 * v[i]::INTEGER - 9 ELSE 2 * v[i]::INTEGER END) END)) % 10 = 0"


@query("q_vat_answer", f"""WITH a AS (SELECT seq, {_VAT} AS v, CASE seq % 7 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 200 END AS st, seq % 7 = 0 AS ok, CASE WHEN seq % 7 = 5 THEN 'MS_UNAVAILABLE' END AS er FROM sites),
c AS (SELECT *, CASE WHEN length(v) <> 11 THEN 0 WHEN NOT ({_LUHN}) THEN 1 WHEN st IS NULL THEN 2 WHEN er IS NOT NULL THEN 3 WHEN st = 200 AND ok THEN 4 WHEN st = 200 THEN 5 WHEN st = 404 THEN 6 ELSE 7 END AS k FROM a)
SELECT seq, k IN (2, 3, 4, 7) AS is_valid, k IN (4, 5, 6) AS checked, CASE WHEN k < 2 THEN 'checksum' WHEN k IN (4, 5, 6) THEN 'vies' ELSE 'provisional' END AS source,
 CASE k WHEN 0 THEN 'it_vat_format_invalid' WHEN 1 THEN 'it_vat_checksum_failed' WHEN 2 THEN 'vies_unreachable' WHEN 3 THEN 'vies_ms_unavailable' WHEN 6 THEN 'vies_http_404' WHEN 7 THEN 'vies_unavailable' END AS note FROM c""", "sites")  # fmt: skip
def q_vat_answer(spark, sf):
    status = F.expr("CASE seq % 7 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 200 END")
    a = people.vat_answer(F.expr(_VAT), status, F.col("seq") % 7 == 0, F.when(F.col("seq") % 7 == 5, "MS_UNAVAILABLE"))
    return sites(spark, sf).select("seq", a.alias("a")).select("seq", "a.*")


# --- views ------------------------------------------------------------------------------------------------------

_QUAD = "CASE seq % 6 WHEN 0 THEN 'A+B-' WHEN 1 THEN 'A+B+' WHEN 2 THEN 'A?B?' WHEN 3 THEN 'A-B-' END"
_TARGET = "CASE seq % 14 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'borderline' END"
_FIVE = "(" + " + ".join(f"(coalesce({c}, '') <> '')::INTEGER" for c in ("official_website", "phone", "pec", "vat_code_final", "revenue", "employees")) + ")"
_VIEW = f"""j AS (SELECT *, {_QUAD} AS quadrant, {_TARGET} AS target, {_FIVE} / 7.0::DOUBLE AS share, regexp_replace(revenue, '[^0-9]', '', 'g') AS rd, regexp_extract_all(employees, '[0-9]+') AS en FROM leads),
shown AS (SELECT seq, coalesce(company_name, 'n/d') AS name, coalesce(city, province, 'n/d') AS town, coalesce(category, 'n/d') AS sector, CASE WHEN rd <> '' THEN floor(rd::DOUBLE / 1e6 * 10 + 0.5) / 10 ELSE 0.0::DOUBLE END AS revenue_m,
 CASE WHEN len(en) > 0 THEN floor(list_sum(list_transform(en, lambda x: x::DOUBLE)) / len(en) + 0.5)::BIGINT ELSE 0 END AS staff,
 CASE WHEN target = 'yes' THEN 'Target' WHEN share >= 0.7 THEN 'Qualificata' WHEN share >= 0.4 OR coalesce(official_website, '') <> '' THEN 'Arricchita' WHEN share > 0.15 THEN 'Grezza' ELSE 'Base' END AS maturity, floor(share * 100 + 0.5)::BIGINT AS complete_pct,
 CASE quadrant WHEN 'A+B-' THEN 'Tier C' WHEN 'A+B+' THEN 'Tier A' WHEN 'A?B?' THEN 'Tier C' WHEN 'A-B-' THEN 'Tier D' ELSE 'Non giudicata' END AS tier, coalesce(target = 'no', false) AS excluded FROM j)"""
_SAVED = {"tutte": "true", "grezze": "maturity IN ('Base', 'Grezza')", "arricchite": "maturity = 'Arricchita'", "giudicate": "tier <> 'Non giudicata'", "target": "maturity = 'Target'", "escluse": "excluded"}


def _judged(spark, sf):
    return leads(spark, sf).withColumns({"quadrant": F.expr(_QUAD), "target": F.expr(_TARGET)})


@query("q_company_view", f"WITH {_VIEW} SELECT * FROM shown", "leads")
def q_company_view(spark, sf):
    return views.company_view(_judged(spark, sf))


@query("q_saved_views", f"WITH {_VIEW} " + " UNION ALL ".join(f"SELECT '{k}' AS saved, count_if({c})::BIGINT AS n FROM shown" for k, c in _SAVED.items()), "leads")
def q_saved_views(spark, sf):
    return views.view_counts(views.company_view(_judged(spark, sf)))


@query("q_view_search", f"WITH {_VIEW} SELECT * FROM shown WHERE maturity = 'Arricchita' AND contains(lower(concat_ws(' ', name, town, sector, tier)), 'edile')", "leads")
def q_view_search(spark, sf):
    return views.search_view(views.company_view(_judged(spark, sf)), "arricchite", " Edile ")


@query("q_palette", "SELECT seq, company_name, city FROM leads WHERE contains(regexp_replace(lower(strip_accents(concat_ws(' ', coalesce(company_name, ''), coalesce(city, ''), coalesce(vat_code_final, '')))), '[^a-z0-9]+', ' ', 'g'), 'ditta 12') ORDER BY seq LIMIT 8", "leads")
def q_palette(spark, sf):
    return views.palette(leads(spark, sf), "Ditta 12").select("seq", "company_name", "city")


@query("q_region_view", f"""WITH regions(province, region, macro_area) AS (VALUES {_REGIONS}), g AS (SELECT region, count(*) AS n, count_if({_HAS.format('website')}) AS with_site, count(DISTINCT l.province) AS provinces, count(DISTINCT coalesce(category, '')) AS markets FROM leads l JOIN regions r ON upper(trim(l.province)) = r.province GROUP BY region)
SELECT region, n, with_site::BIGINT AS with_site, floor(100.0::DOUBLE * with_site / n + 0.5)::BIGINT AS coverage, provinces, markets FROM g""", "leads")  # fmt: skip
def q_region_view(spark, sf):
    return views.region_view(leads(spark, sf))


@query("q_town_view", """WITH c AS (SELECT coalesce(city, '') AS city, coalesce(category, '') AS category, count(*) AS c, count_if(coalesce(official_website, '') <> '') AS s, min(seq) AS f FROM leads WHERE upper(coalesce(province, '')) = 'PD' GROUP BY ALL)
SELECT city, sum(c)::BIGINT AS n, sum(s)::BIGINT AS with_site, first(category ORDER BY c DESC, f) AS top_category FROM c GROUP BY city""", "leads")  # fmt: skip
def q_town_view(spark, sf):
    return views.town_view(leads(spark, sf), "pd")


_KPI = ["official_website", "phone", "email", "pec", "vat_code", "revenue", "employees"]


@query("q_indicators", f"""WITH {_VIEW}, r AS ({" UNION ALL ".join(f"SELECT {_PCT.format(f'count_if({_HAS.format(f)})', 'count(*)')} AS pct FROM leads" for f in _KPI)})
SELECT (SELECT floor(avg(pct) + 0.5)::BIGINT FROM r) AS completeness, (SELECT floor(1000.0::DOUBLE * count_if(target = 'yes') / count(target) + 0.5) / 10 FROM j) AS target_rate, (SELECT floor(1000.0::DOUBLE * count_if(quadrant LIKE '%?%') / count(quadrant) + 0.5) / 10 FROM j) AS unknown_rate""", "leads")  # fmt: skip
def q_indicators(spark, sf):
    return views.indicators(reports.fill_rates(leads(spark, sf), _KPI), _judged(spark, sf).select("target", "quadrant"))


_MODES = ["copertura", "profondita", "fatturato", "target", "settori", "recenza", "opportunita"]


@query("q_map_modes", f"""WITH p AS (SELECT seq, (seq % 101)::INTEGER AS c, CASE WHEN seq % 9 = 0 THEN 0 ELSE seq * 10 END AS n, CASE WHEN seq % 4 = 0 THEN NULL ELSE seq % 100 END AS r FROM sites)
SELECT seq, c::DOUBLE AS copertura, floor(c * 0.72::DOUBLE + 0.5) AS profondita, floor(c * 0.6::DOUBLE + 0.5) AS fatturato, floor(c * 0.46::DOUBLE + 0.5) AS target, CASE WHEN c > 0 THEN least(100.0::DOUBLE, floor(c * 0.9::DOUBLE + 10 + 0.5)) ELSE 0.0::DOUBLE END AS settori,
 coalesce(r, 0)::DOUBLE AS recenza, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, floor((100 - c) * 0.55::DOUBLE + n::DOUBLE / 1400 + 0.5)) END AS opportunita FROM p""", "sites")  # fmt: skip
def q_map_modes(spark, sf):
    s = F.col("seq")
    c, n, r = s % 101, F.when(s % 9 == 0, 0).otherwise(s * 10), F.when(s % 4 == 0, None).otherwise(s % 100)
    return sites(spark, sf).select("seq", *[views.map_intensity(c, n, r, m).alias(m) for m in _MODES])


@query("q_quality_gate", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN (company_name IS NULL OR city IS NULL) AND coalesce(trim(website), '') = '' AND coalesce(trim(vat_code), '') = '' AND NOT regexp_matches(coalesce(email, ''), '.+@.+[.].+') THEN 'SKIPPED' WHEN company_name IS NULL THEN CASE WHEN q < 0.3 - 1e-9 THEN 'SKIPPED' ELSE 'PENDING' END ELSE 'PENDING' END AS status FROM (SELECT *, (CASE WHEN regexp_matches(coalesce(email, ''), '.+@.+[.].+') THEN 20 ELSE 0 END + CASE WHEN coalesce(trim(vat_code), '') <> '' THEN 20 ELSE 0 END + CASE WHEN coalesce(trim(website), '') <> '' THEN 15 ELSE 0 END + CASE WHEN coalesce(trim(phone), '') <> '' OR coalesce(trim(address), '') <> '' THEN 10 ELSE 0 END + CASE WHEN coalesce(trim(province), '') <> '' THEN 5 ELSE 0 END) / 100.0 AS q FROM leads)) GROUP BY status", "leads")
def q_quality_gate(spark, sf):
    return views.quality_gate(leads(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("q_consolidation", f"""WITH g AS (SELECT coalesce(source, 'OTHER') AS origin, *, row_number() OVER (PARTITION BY coalesce(company_name, ''), city ORDER BY seq) AS r FROM leads),
a AS (SELECT origin, count(*) AS gross, count_if(r = 1) AS kept, count_if(r = 1 AND {_HAS.format('phone')}) AS phone, count_if(r = 1 AND {_HAS.format('email')}) AS email, count_if(r = 1 AND {_HAS.format('website')}) AS website FROM g GROUP BY origin
 UNION ALL SELECT '(all)', count(*), count_if(r = 1), count_if(r = 1 AND {_HAS.format('phone')}), count_if(r = 1 AND {_HAS.format('email')}), count_if(r = 1 AND {_HAS.format('website')}) FROM g)
SELECT origin, gross, kept::BIGINT AS kept, phone::BIGINT AS phone, email::BIGINT AS email, website::BIGINT AS website, floor((1 - kept::DOUBLE / gross) * 1000 + 0.5) / 1000 AS dedup_ratio FROM a""", "leads")  # fmt: skip
def q_consolidation(spark, sf):
    gross = leads(spark, sf)
    first = gross.groupBy(F.coalesce("company_name", F.lit("")).alias("k"), "city").agg(F.min_by(F.struct(*gross.columns), "seq").alias("r")).select("r.*")
    return views.consolidation(gross, first, ["phone", "email", "website"])


@query("q_gate_outcome", """WITH r AS (SELECT seq % 8 = 0 AS d, CASE WHEN seq % 5 = 0 THEN NULL ELSE seq % 3 <> 0 END AS a, CASE seq % 4 WHEN 0 THEN 'TP' WHEN 1 THEN 'FP' WHEN 2 THEN 'TP' END AS t FROM sites), k AS (SELECT d, t, NOT d AND coalesce(a, false) AS ok FROM r),
c AS (SELECT count_if(ok) AS allowed, count_if(NOT ok) AS rejected, count_if(d) AS directory, count_if(ok AND t = 'TP') AS tp_kept, count_if(NOT ok AND t = 'TP') AS tp_lost, count_if(ok AND t = 'FP') AS fp_kept, count_if(NOT ok AND t = 'FP') AS fp_caught FROM k)
SELECT allowed::BIGINT AS allowed, rejected::BIGINT AS rejected, directory::BIGINT AS directory, tp_kept::BIGINT AS tp_kept, tp_lost::BIGINT AS tp_lost, fp_kept::BIGINT AS fp_kept, fp_caught::BIGINT AS fp_caught, floor(tp_kept::DOUBLE / allowed * 1000 + 0.5) / 1000 AS precision, floor(tp_kept::DOUBLE / (tp_kept + tp_lost) * 1000 + 0.5) / 1000 AS recall FROM c""", "sites")  # fmt: skip
def q_gate_outcome(spark, sf):
    s = F.col("seq")
    truth = F.when(s % 4 == 1, "FP").when(s % 4 != 3, "TP")
    return views.gate_outcome(sites(spark, sf).select((s % 8 == 0).alias("directory"), F.when(s % 5 != 0, s % 3 != 0).alias("allow"), truth.alias("truth")))


@query("q_latest_year", "SELECT c AS company, max(y) AS year, max(v) FILTER (WHERE y = m) AS revenue FROM (SELECT *, max(y) OVER (PARTITION BY c) AS m FROM (SELECT user_id AS c, (2015 + event_id % 9)::BIGINT AS y, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) WHERE v IS NOT NULL) GROUP BY c")
def q_latest_year(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("user_id").alias("company"), (2015 + F.col("event_id") % 9).alias("year"), F.when(F.col("event_type") != "error", F.col("value")).alias("revenue"))
    return views.latest(e, "company", "year", "revenue")


@query("q_last_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def q_last_runs(spark, sf):
    return views.last_runs(tables.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")


@query("q_portal_once", "SELECT * FROM portal WHERE phone IS NULL OR rec IN (SELECT min(rec) FROM portal WHERE phone IS NOT NULL GROUP BY phone)", "portal")
def q_portal_once(spark, sf):
    return views.once_per_record(tables.view(spark, sf, "portal"), F.col("phone"))


@query("q_email_verdicts", f"WITH a AS (SELECT DISTINCT lower(trim(email)) AS mail FROM leads WHERE {_HAS.format('email')}) SELECT seq, CASE WHEN length(mail) % 2 = 0 THEN 'ok' WHEN length(mail) % 2 = 1 THEN 'bad' END AS verdict FROM leads LEFT JOIN a ON lower(trim(email)) = mail", "leads")
def q_email_verdicts(spark, sf):
    known = views.distinct_addresses(leads(spark, sf)).withColumn("verdict", F.when(F.length("email") % 2 == 0, "ok").otherwise("bad"))
    return views.join_verdicts(leads(spark, sf), known).select("seq", "verdict")


@query("q_provider_plan", "SELECT field, provider, place::INTEGER AS place FROM (SELECT field, provider, row_number() OVER (PARTITION BY field ORDER BY tier, ord) AS place FROM (SELECT category AS field, seq AS provider, seq % 3 AS tier, seq AS ord FROM leads)) WHERE place <= 4", "leads")
def q_provider_plan(spark, sf):
    s = leads(spark, sf)
    return views.provider_plan(s.select(F.col("category").alias("field"), F.col("seq").alias("provider"), (F.col("seq") % 3).alias("tier"), F.col("seq").alias("ord")), 4)


# --- judgment ---------------------------------------------------------------------------------------------------

_NET = """CASE WHEN seq % 2 = 0 AND coalesce(trim({0}), '') <> '' THEN ['confirmed_present', 'owned_confirmed', '0.85', 'website_link'] WHEN seq % 3 = 0 AND {1} THEN ['confirmed_present', 'candidate_unverified', '0.6', 'social_search']
 WHEN seq % 3 = 0 AND {2} THEN ['confirmed_absent', 'na', '0.5', 'social_search'] ELSE ['unknown_not_found', 'na', '0', CASE WHEN seq % 3 = 0 THEN 'social_search' ELSE 'none' END] END"""
_CHANNEL_SQL = {
    "website": "CASE WHEN seq % 2 = 0 THEN ['confirmed_present', 'owned_confirmed', '0.9', 'website_fetch'] WHEN coalesce(website, '') <> '' THEN ['unknown_not_found', 'candidate_unverified', '0.2', 'input'] ELSE ['unknown_not_found', 'na', '0', 'none'] END",
    "instagram": _NET.format("instagram", "false", "false"), "facebook": _NET.format("facebook", "false", "false"), "linkedin_company": _NET.format("linkedin", "seq % 4 = 1", "false"), "linkedin_founder": "['unknown_not_found', 'na', '0', 'none']",
    "tiktok": _NET.format("tiktok", "false", "seq % 7 = 0"), "youtube": _NET.format("NULL", "seq % 5 = 0", "seq % 7 = 0"),
    "gbp": "CASE WHEN seq % 8 < 6 AND seq % 4 = 0 THEN ['confirmed_present', 'owned_confirmed', '0.8', 'places_api'] ELSE ['unknown_not_found', 'na', '0', CASE WHEN seq % 8 < 6 THEN 'places_api' ELSE 'none' END] END",
    "ad_library": "CASE WHEN seq % 5 < 3 AND seq % 3 = 0 THEN ['confirmed_present', 'na', '0.8', 'ad_library'] WHEN seq % 5 < 3 AND seq % 3 = 1 THEN ['confirmed_absent', 'na', '0.7', 'ad_library'] ELSE ['unknown_not_found', 'na', '0', CASE WHEN seq % 5 < 3 THEN 'ad_library' ELSE 'none' END] END",
    "ecommerce": "CASE WHEN seq % 10 = 0 THEN ['confirmed_present', 'owned_confirmed', '0.6', 'website_markers'] ELSE ['unknown_not_found', 'na', '0', CASE WHEN seq % 2 = 0 THEN 'website_markers' ELSE 'none' END] END",
    "marketplace": "['unknown_not_found', 'na', '0', 'none']",
}
_FOOT = "foot AS (SELECT seq, channel, x[1] AS state, x[2] AS ownership, x[3]::DOUBLE AS confidence, x[4] AS method FROM (" + " UNION ALL ".join(f"SELECT seq, '{c}' AS channel, {sql} AS x FROM leads" for c, sql in _CHANNEL_SQL.items()) + "))"
_SURF = f"""{_FOOT}, surf AS (SELECT seq, CASE channel WHEN 'website' THEN '3.1' WHEN 'gbp' THEN '3.3' WHEN 'instagram' THEN '3.5' WHEN 'facebook' THEN '3.5' WHEN 'tiktok' THEN '3.6' WHEN 'youtube' THEN '3.7' WHEN 'linkedin_company' THEN '3.8' WHEN 'linkedin_founder' THEN '3.8' WHEN 'marketplace' THEN '3.9' WHEN 'ecommerce' THEN '3.10' ELSE '3.11' END AS key,
 CASE min(CASE state WHEN 'confirmed_present' THEN 0 WHEN 'confirmed_absent' THEN 1 ELSE 2 END) WHEN 0 THEN 'confirmed_present' WHEN 1 THEN 'confirmed_absent' ELSE 'unknown_not_found' END AS state FROM foot GROUP BY ALL),
got AS (SELECT seq, 'B' AS axis, key, state FROM surf WHERE state = 'confirmed_present' UNION ALL SELECT seq, 'A', '2.1', 'confirmed_present' FROM leads WHERE seq % 2 = 0),
keys AS (SELECT 'A' AS axis, '2.' || i AS key FROM range(1, 8) t(i) UNION ALL SELECT 'B', '3.' || i FROM range(1, 16) t(i)),
sig AS (SELECT * FROM got UNION ALL SELECT l.seq, k.axis, k.key, CASE WHEN k.axis = 'B' AND s.state = 'confirmed_absent' THEN 'confirmed_absent' ELSE 'unknown_not_found' END FROM leads l CROSS JOIN keys k LEFT JOIN surf s ON s.seq = l.seq AND s.key = k.key WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.seq = l.seq AND g.axis = k.axis AND g.key = k.key))"""


def _footprint(spark, sf):
    s = F.col("seq")
    pick = lambda **c: F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v)])
    return judgment.footprint(
        leads(spark, sf).select(
            "seq", F.col("website").alias("site"), (s % 2 == 0).alias("site_ok"), pick(**{n: F.col(n) for n in ("instagram", "facebook", "linkedin", "tiktok")}).alias("linked"),
            pick(linkedin=F.when(s % 4 == 1, "x"), youtube=F.when(s % 5 == 0, "y")).alias("searched"), (s % 3 == 0).alias("search_ok"), F.when(s % 7 == 0, F.array(F.lit("tiktok"), F.lit("youtube"))).alias("missing"),
            F.when(s % 4 == 0, judgment.PRESENT).alias("places"), (s % 8 < 6).alias("places_ok"), F.when(s % 3 == 0, judgment.PRESENT).when(s % 3 == 1, judgment.ABSENT).alias("ads"), (s % 5 < 3).alias("ads_ok"), (s % 10 == 0).alias("shop"),
        )
    )


def _all_signals(spark, sf):
    surfaces = judgment.surface_states(_footprint(spark, sf))
    b = surfaces.filter(F.col("state") == judgment.PRESENT).select("seq", F.lit("B").alias("axis"), "key", "state")
    a = leads(spark, sf).filter("seq % 2 = 0").select("seq", F.lit("A").alias("axis"), F.lit("2.1").alias("key"), F.lit(judgment.PRESENT).alias("state"))
    return judgment.all_signals(leads(spark, sf), b.unionByName(a), surfaces)


@query("q_footprint", f"WITH {_FOOT} SELECT * FROM foot", "leads")
def q_footprint(spark, sf):
    return _footprint(spark, sf)


@query("q_signals", f"WITH {_SURF} SELECT axis, key, state, count(*) AS n FROM sig GROUP BY ALL", "leads")
def q_signals(spark, sf):
    return _all_signals(spark, sf).groupBy("axis", "key", "state").agg(F.count("*").alias("n"))


@query("q_critic", f"""WITH {_SURF}, cov AS (SELECT seq, count_if(axis = 'A' AND state <> 'unknown_not_found')::DOUBLE / 7 AS ca, count_if(axis = 'B' AND state <> 'unknown_not_found')::DOUBLE / 15 AS cb,
 bool_or(axis = 'A' AND key = '2.1' AND state <> 'unknown_not_found') AS ka, bool_or(axis = 'B' AND key = '3.1' AND state <> 'unknown_not_found') AS kb FROM sig GROUP BY seq),
f AS (SELECT seq, (seq % 11 = 0)::INTEGER AS breach, (NOT ka)::INTEGER + (seq % 3 = 0 AND NOT kb)::INTEGER AS invented, (seq % 6 = 0)::INTEGER AS uncited, (ca < 0.34 OR cb < 0.34)::INTEGER AS thin, (seq % 13 = 0)::INTEGER AS lost FROM cov)
SELECT seq, (breach + invented + lost + uncited + thin)::BIGINT AS flags, breach + invented + lost = 0 AS consistent, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(0.9::DOUBLE, 1 - (0.4::DOUBLE * (breach + invented + lost) + 0.1::DOUBLE * (uncited + thin))))) * 1000 + 0.5) / 1000 AS validation FROM f""", "leads")  # fmt: skip
def q_critic(spark, sf):
    s = F.col("seq")
    base = leads(spark, sf).select("seq")
    verdicts = base.select("seq", F.when(s % 13 != 0, 0.5).alias("a"), F.lit(0.4).alias("b"), F.lit(0.9).alias("confidence"))
    one = lambda axis, key, graded, cited: F.struct(F.lit(axis).alias("axis"), F.lit(key).alias("key"), graded.alias("graded"), cited.alias("citations"))
    a = one("A", "2.1", F.lit(True), F.array(F.when(s % 11 == 0, "signal_b:1").otherwise("signal_a:1")))
    b = one("B", "3.1", s % 3 == 0, F.when(s % 6 != 0, F.array(F.lit("signal_b:2"))))
    return judgment.critic(verdicts, base.select("seq", F.inline(F.array(a, b))), _all_signals(spark, sf))
