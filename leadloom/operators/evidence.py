"""Gates for paid search and what it finds: signals of a lead, pages of aggregators, corroborated third-party hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import digits
from leadloom.functions.text import filled, has, key_text
from leadloom.sources.pages import visible_text
from leadloom.sources.suffixes import with_domains

#: Words of the estate sector in a page.
SECTOR = (
    r"(?i)immobiliar(?:e|i|a)|agenzia\s+immobiliar|compravendit(?:a|e)|locazion(?:e|i)|appartament(?:o|i)|real\s+estate|mediatore\s+immobiliar|vendita\s+immob|affitt(?:o|i|are|asi)"
    r"|intermediazion(?:e|i)\s+immob|consulen(?:za|ze)\s+immob|property\s+management|rentals?|casa\s+(?:in\s+(?:vendita|affitto)|nuova)|cerca\s+casa|vendere\s+casa"
)
LEAST_HTML, MANY_CODES, LEAST_DENSITY = 200, 4, 3
#: Legal forms, small words and trade words that a name's stem is stripped of.
STEM_NOISE = r"(?i)\b(?:s\.?r\.?l\.?s?|s\.?p\.?a\.?|s\.?n\.?c\.?|s\.?a\.?s\.?|scarl|s\.?c\.?r\.?l\.?|srls?|spa|snc|sas|di|e|il|la|le|i|un|una|da|per|con|su|agenzia|immobiliare|studio|gruppo|impresa|costruzioni|edilizia)\b"
#: Single stems that many unrelated sites share (a subset; a parameter).
COMMON_STEMS = ["bloom", "ufficio", "area", "progetto", "iniziative", "appia", "torri", "mia", "comelico", "europa", "master"]
#: Parts of a company's name that don't tell it apart, and words that only say what it does.
NAME_FORMS = ["srl", "srls", "spa", "snc", "sas", "sapa", "ss", "sc", "scarl", "scrl", "soc", "coop"]
CONNECTIVES = ["del", "dei", "della", "delle", "dello", "degli", "per", "con", "and", "the"]
TRADE_WORDS = [
    "immobiliare", "immobiliari", "agenzia", "studio", "servizi", "service", "services", "gruppo", "group", "italia", "italiana", "italy", "international", "internazionale", "costruzioni", "generali",
    "edilizia", "edile", "impianti", "impresa", "industria", "industrie", "industriale", "meccanica", "officine", "officina", "sistemi", "tecnologie", "tecnica", "commerciale", "trasporti", "logistica",
    "produzione", "consulting", "consulenza", "casa", "home", "real", "estate", "nord", "sud", "centro", "nuova", "nuovo",
]
PROFILES = ["instagram", "facebook", "linkedin", "tiktok", "youtube"]


def page_evidence(pages: DataFrame, sector: str = SECTOR) -> DataFrame:
    """(page_id, allow, reason, codes, density): whether a page found for money may be one firm's own.

    In order: too short rejects; four different 11-digit numbers reject, as lists of firms show; fewer than three words of
    the sector in the visible text reject. Counts are those up to the deciding rule; later ones are null.
    """
    short = F.coalesce(F.length("html") < LEAST_HTML, F.lit(True))
    codes = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r"\b([0-9]{11})\b"), F.lit(1))))
    density = F.regexp_count(F.lower(visible_text(F.col("html"))), F.lit(sector))
    seen = pages.select("page_id", short.alias("short"), F.when(~short, codes).alias("codes"), F.when(~short & (codes < MANY_CODES), density).alias("density"))
    reason = F.when(F.col("short"), "tiny_or_empty_html").when(F.col("codes") >= MANY_CODES, "aggregator_many_vats").when(F.col("density") < LEAST_DENSITY, "sector_density_too_low")
    return seen.select("page_id", reason.isNull().alias("allow"), F.coalesce(reason, F.lit("allowed")).alias("reason"), "codes", "density")


def search_gate(leads: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """(seq, allow, reason, signals): whether a lead may be searched for with money.

    Signals are a tax code, a phone, a mail domain, a listing and a street with its place. A name that is one common stem is
    refused whatever there is; then a lead without signals; then a name of nothing but noise.
    """
    name = F.lower(F.coalesce("company_name", F.lit("")))
    words = F.filter(F.split(F.regexp_replace(name, STEM_NOISE, " "), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    stem = F.when(F.size(words) == 1, words[0])
    domain = filled(F.trim(F.lower(F.regexp_replace(F.regexp_extract("email", r"^.+@([^@]+)$", 1), "^(?i)www[.]", ""))))
    street = F.trim(F.split_part(F.coalesce("address", F.lit("")), F.lit(","), F.lit(1)))
    signals = F.filter(F.array(
        F.when(F.length(digits(F.col("vat_code"))) == 11, "vat"), F.when(F.length(digits(F.col("phone"))) >= 8, "phone"), F.when(domain.isNotNull(), "email_domain"),
        F.when(has(F.col("pg_url")), "pg_url"), F.when((F.length(street) >= 6) & (has(F.col("city")) | has(F.col("province"))), "address_with_locality"),
    ), lambda s: s.isNotNull())
    rows = leads.select("seq", stem.alias("stem"), signals.alias("s"), (F.size(words) == 0).alias("empty"))
    reason = F.when(F.col("stem").isin(stems or COMMON_STEMS), F.concat(F.lit("deny:common_bare_stem:"), "stem")).when(F.size("s") == 0, "deny:no_signal_beyond_name").when(F.col("empty"), "deny:name_is_stopwords_only")
    return rows.select("seq", reason.isNull().alias("allow"), F.coalesce(reason, F.concat(F.lit("allow:signals="), F.array_join("s", ","))).alias("reason"), F.array_join("s", ",").alias("signals"))


def _plain_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), r"^www\.", ""), "/+$", "")


def corroborated_hits(hits: DataFrame, leads: DataFrame, rules: DataFrame) -> DataFrame:
    """hits (hit_id, lead_id, url, title, snippet) with corroborated: whether a hit tells of the lead and isn't the lead's own.

    Own are the lead's domains and profiles. All words of its name must stand in the hit, one of them of four letters
    and no trade word; and something else must tie them: city, province in brackets, tax code, or an own domain named.
    Leads: seq, company_name, website, official_website, city, business_city, province, vat_code and the profiles.
    """
    wanted = [c for c in ("business_city", "vat_code_final", *PROFILES) if c not in leads.columns]
    full = leads.select("*", *[F.lit(None).cast("string").alias(c) for c in wanted])
    for k, c in enumerate(("official_website", "website")):
        full = with_domains(full, c, rules, f"d{k}_")
    own = F.array_distinct(F.filter(F.array("d0_registrable", "d1_registrable"), lambda d: d.isNotNull()))
    tokens = F.filter(F.split(key_text(F.col("company_name")), " "), lambda t: (F.length(t) > 2) & ~t.isin(NAME_FORMS + CONNECTIVES))
    side = full.select(
        F.col("seq").alias("lead_id"), own.alias("own"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"), F.transform(F.filter(F.array(*PROFILES), has), _plain_url).alias("profiles"),
        F.filter(F.transform(F.array("city", "business_city"), key_text), lambda c: F.length(c) > 2).alias("cities"), F.trim("province").alias("province"), digits(F.coalesce("vat_code_final", "vat_code")).alias("vat"),
    )
    met = with_domains(hits, "url", rules, "hit_").join(side, "lead_id", "left")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    plain, low, url = F.concat(F.lit(" "), key_text(text), F.lit(" ")), F.lower(text), _plain_url(F.col("url"))
    third = F.col("hit_registrable").isNotNull() & ~F.array_contains("own", F.col("hit_registrable")) & ~F.exists("profiles", lambda p: (url == p) | F.startswith(url, F.concat(p, F.lit("/"))))
    words = F.split(key_text(text), " ")
    named = (F.size("tokens") > 0) & F.exists("tokens", lambda t: (F.length(t) >= 4) & ~t.isin(TRADE_WORDS)) & F.forall("tokens", lambda t: F.array_contains(words, t))
    in_city = F.exists("cities", lambda c: F.contains(plain, F.concat(F.lit(" "), c, F.lit(" "))))
    bracket = F.col("province").rlike("^[A-Za-z]{2}$") & F.contains(F.regexp_replace(low, r"\(\s*([a-z]{2})\s*\)", "($1)"), F.concat(F.lit("("), F.lower("province"), F.lit(")")))
    coded = (F.length("vat") == 11) & F.array_contains(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{11})(?![0-9])"), F.lit(1)), F.col("vat"))
    said = F.exists("own", lambda d: F.exists(F.split(low, r"[^a-z0-9.-]+"), lambda w: F.regexp_replace(F.rtrim(w, F.lit(".")), r"^www\.", "") == d))
    no = lambda c: F.coalesce(c, F.lit(False))
    return met.select(*hits.columns, (no(third) & no(named) & (no(in_city) | no(bracket) | no(coded) | no(said))).alias("corroborated"))
