"""Contact facts of a company's own pages, and filling them into leads that lack them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import is_pec, vat_codes
from leadloom.functions.text import bind, decode_hex_email, filled, has
from leadloom.sources.markup import company_facts, elements
from leadloom.sources.suffixes import with_domains
from leadloom.storage import materialize

_MAIL = r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
_PHONE = r"(?:\+39\s?)?(?:0[0-9]{1,4}|3[0-9]{2})[\s\-./]?[0-9][0-9\s\-./]{4,12}[0-9]"
#: Hosts of profiles by network, and paths that are no profile.
NETWORKS = {
    "instagram": (r"(?:^|\.)instagram\.com$", r"(?i)/(?:p|reel|explore|accounts|share)\b"), "facebook": (r"(?:^|\.)facebook\.com$", r"(?i)/(?:sharer|share|plugins|dialog|tr\b|events|photo)"),
    "linkedin": (r"(?:^|\.)linkedin\.com$", r"(?i)/(?:shareArticle|sharing|share-offsite|feed|posts)"), "tiktok": (r"(?:^|\.)tiktok\.com$", r"(?i)/(?:video|tag|search|discover|foryou|live)\b"),
    "youtube": (r"(?:^|\.)(?:youtube\.com|youtu\.be)$", r"(?i)/(?:watch|embed|results|shorts|playlist|feed)\b"),
}


def profile(url: Column) -> Column:
    """Struct (network, url) of a profile address, url without www, query and closing slash; both null for any other."""
    whole = r"^(?i)https?://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]+)?(/[^?#]*)?(\?[^#]*)?"

    def parts(u: Column) -> Column:
        path = F.regexp_extract(u, whole, 2)
        return F.struct(F.lower(F.regexp_extract(u, whole, 1)).alias("host"), path.alias("path"), F.concat(F.when(path == "", "/").otherwise(path), F.regexp_extract(u, whole, 3)).alias("full"))

    def judged(p: Column) -> Column:
        network = F.lit(None).cast("string")
        for name, (hosts, bad) in reversed(NETWORKS.items()):
            network = F.when(p["host"].rlike(hosts) & (F.length(p["full"]) > 1) & ~p["full"].rlike(bad), name).otherwise(network)
        return F.struct(network.alias("network"), F.regexp_replace(F.concat(F.lit("https://"), F.regexp_replace(p["host"], r"^www\.", ""), p["path"]), "/$", "").alias("url"))

    return bind(bind(url, parts), lambda p: bind(judged(p), lambda j: F.struct(j["network"].alias("network"), F.when(j["network"].isNotNull(), j["url"]).alias("url"))))


def phone_digits(text: Column) -> Column:
    """Eight to eleven digits without the country code; null for anything else."""
    d = F.regexp_replace(text, "[^0-9]", "")
    cut = F.when(d.startswith("0039"), F.substring(d, 5, 40)).when((F.length(d) >= 11) & d.startswith("39"), F.substring(d, 3, 40)).otherwise(d)
    return F.when(F.length(cut).between(8, 11), cut)


def revealed(text: Column) -> Column:
    """Bracketed [at] and (dot) in lower case as signs; upper case stays, as (AT) is a province."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*[\[({]\s*(?:at|chiocciola)\s*[\])}]\s*", "@"), r"\s*[\[({]\s*(?:dot|punto)\s*[\])}]\s*", ".")


def body_facts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, email, pec, profiles, vat_codes, phones, site_name, founder, founding_year, rating, reviews) of pages (page_id, html, official_website).

    Mail addresses come in order from mailto links, hidden codes, the text, the text with bracketed signs, linked data; the
    first certified one is the pec, the first other one under the site's registrable domain the email (any, if the site is
    unknown). Profiles, names and the rest are what linked data declares first, then what the page shows; vat_codes are
    checked codes, phones digits, each once in order. Pages of fewer than 50 characters give nothing but empty lists.
    """
    whole = pages.select("page_id", "html", "official_website").filter(F.length("html") >= 50)
    seen = elements(whole, ["a", "meta", "body", "[data-cfemail]", "#text"], up=False)
    attr = lambda n: F.col("attrs")[n]
    texts = seen.filter(F.col("tag").isin("body", "#text")).groupBy("page_id").agg(F.coalesce(F.max(F.when(F.col("tag") == "body", F.col("text"))), F.max("text")).alias("text"))
    facts = company_facts(whole)
    row = lambda source, place, kind, value: F.struct(F.lit(source).alias("source"), F.col(place).cast("bigint").alias("place"), F.lit(kind).alias("kind"), value.alias("value"))
    href = F.trim(attr("href"))
    tag = F.col("tag")
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    seen_ = seen.withColumn("p", profile(full))
    from_tags = F.array(
        row(0, "place", "mail", F.when((tag == "a") & href.rlike("^(?i)mailto:"), F.lower(F.trim(F.split_part(F.regexp_replace(href, "^(?i)mailto:", ""), F.lit("?"), F.lit(1)))))),
        row(1, "place", "mail", F.lower(F.trim(decode_hex_email(attr("data-cfemail"))))), row(2, "place", "mail", F.when((tag == "a") & F.lower(href).contains("/cdn-cgi/l/email-protection#"), F.lower(F.trim(decode_hex_email(F.split_part(href, F.lit("#"), F.lit(2))))))),
        row(0, "place", "phone", F.when((tag == "a") & href.rlike("^(?i)tel:"), phone_digits(href))), row(2, "place", "site", F.when((tag == "meta") & (F.lower(attr("property")) == "og:site_name"), filled(F.trim(attr("content"))))),
        F.struct(F.lit(1).alias("source"), F.col("place").cast("bigint").alias("place"), F.when(tag == "a", F.col("p.network")).alias("kind"), F.col("p.url").alias("value")),
    )
    many = lambda source, kind, values: F.transform(values, lambda v, k: F.struct(F.lit(source).alias("source"), k.cast("bigint").alias("place"), F.lit(kind).alias("kind"), v.alias("value")))
    text, open_ = F.col("text"), revealed(F.col("text"))
    found = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    from_text = F.concat(
        many(3, "mail", F.transform(found(text, _MAIL), F.lower)), many(4, "mail", F.transform(F.when(open_ != text, found(open_, _MAIL)).otherwise(F.array().cast("array<string>")), F.lower)),
        many(1, "phone", F.transform(found(text, _PHONE), phone_digits)), many(1, "vat", vat_codes(text)),
    )
    key, value = F.col("key"), F.col("value")
    facts = facts.withColumn("p", profile(value))
    own_network, own_address = F.col("p.network"), F.col("p.url")
    at = (F.col("node") * 1000 + F.least(F.col("place"), F.lit(999))).cast("bigint")
    kind = F.when(key.isin("legalName", "name"), "site").when(key == "email", "mail").when(key == "telephone", "phone").when(key.isin("vatID", "taxID"), "vat").when(key == "sameAs", own_network).when(key == "foundingDate", "year").otherwise(key)
    said = F.when(key == "email", F.lower(F.regexp_replace(value, "^(?i)mailto:", ""))).when(key == "telephone", phone_digits(value)).when(key.isin("vatID", "taxID"), F.get(vat_codes(value), F.lit(0))).when(key == "sameAs", own_address)
    said = said.when(key == "foundingDate", filled(F.regexp_extract(value, r"\b((?:19|20)[0-9]{2})\b", 1))).when(key.isin("legalName", "name", "founder", "rating", "reviews"), value)
    from_facts = facts.select("page_id", F.when(key == "email", 5).when(key == "telephone", 2).otherwise(0).alias("source"), at.alias("place"), kind.alias("kind"), said.alias("value"))
    rows = seen_.select("page_id", F.inline(from_tags)).unionByName(texts.select("page_id", F.inline(from_text))).unionByName(from_facts).filter("kind is not null and value is not null")
    rows = materialize(rows, "page-facts")  # pages are scanned once, and the plans stay small
    mails = rows.filter((F.col("kind") == "mail") & F.col("value").contains("@"))
    owner = with_domains(whole.select("page_id", "official_website"), "official_website", rules, "own_").select("page_id", "own_registrable")
    judged = with_domains(mails.withColumn("domain", F.regexp_extract("value", "@([^@]*)$", 1)), "domain", rules, "mail_").join(owner, "page_id")
    order = F.struct("source", "place")
    good = ~is_pec(F.col("value")) & (F.col("own_registrable").isNull() | F.coalesce(F.col("mail_registrable") == F.col("own_registrable"), F.lit(False)))
    chosen = judged.groupBy("page_id").agg(F.min_by(F.when(good, F.col("value")), F.when(good, order)).alias("email"), F.min_by(F.when(is_pec(F.col("value")), F.col("value")), F.when(is_pec(F.col("value")), order)).alias("pec"))
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, order)).alias(k)
    every = lambda k: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("source", "place", "value")))), lambda r: r["value"])).alias(k)
    rest = rows.filter("kind <> 'mail'").groupBy("page_id").agg(*[first(k) for k in (*NETWORKS, "site", "founder", "year", "rating", "reviews")], every("phone"), every("vat"))
    none = F.array().cast("array<string>")
    out = pages.select("page_id").join(chosen, "page_id", "left").join(rest, "page_id", "left")
    return out.select(
        "page_id", "email", "pec", *NETWORKS, F.coalesce("vat", none).alias("vat_codes"), F.coalesce("phone", none).alias("phones"), F.col("site").alias("site_name"), "founder", F.col("year").alias("founding_year"), "rating", "reviews",
    )


#: Columns of a lead and the facts that fill them.
_FILLS = {
    "email_inferred": "email", "pec": "pec", "instagram": "instagram", "facebook": "facebook", "linkedin": "linkedin", "tiktok": "tiktok", "youtube": "youtube", "rating": "rating", "reviews_count": "reviews",
    "founding_year": "founding_year", "decision_maker_name": "founder", "vat_code_final": "vat", "phone": "phone",
}


def apply_facts(leads: DataFrame, facts: DataFrame, key: str = "seq") -> DataFrame:
    """leads with empty columns filled from facts (key, body_facts' columns), and filled: the names of the columns, in a fixed order.

    What a lead has is never changed. email_type becomes business where a business address was filled and the type was
    empty or pec, and pec where only a certified address was.
    """
    lacking = [c for c in (*_FILLS, "email_type") if c not in leads.columns]
    known = leads.select("*", *[F.lit(None).cast("string").alias(c) for c in lacking])
    given = facts.select(F.col(key), F.struct(*[c for c in facts.columns if c not in ("vat_codes", "phones", key, "page_id")], F.get("vat_codes", F.lit(0)).alias("vat"), F.get("phones", F.lit(0)).alias("phone")).alias("_facts"))
    joined = known.join(given, key, "left")
    empty = lambda c: ~has(F.col(c).cast("string"))
    fills = {c: empty(c) & F.col(f"_facts.{f}").isNotNull() for c, f in _FILLS.items()}
    business = fills["email_inferred"] & (empty("email_type") | (F.col("email_type") == "pec"))
    only_pec = fills["pec"] & empty("email_inferred") & ~fills["email_inferred"] & empty("email_type")
    out = joined.select(
        *[c for c in known.columns if c not in _FILLS and c != "email_type"], *[F.when(fills[c], F.col(f"_facts.{f}")).otherwise(F.col(c)).alias(c) for c, f in _FILLS.items()],
        F.when(business, "business").when(only_pec, "pec").otherwise(F.col("email_type")).alias("email_type"), F.filter(F.array(*[F.when(f, c) for c, f in fills.items()]), lambda c: c.isNotNull()).alias("filled"),
    )
    return out.select(*known.columns, "filled")
