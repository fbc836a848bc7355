"""Phones, tax codes, e-mail addresses, web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import bind, filled

#: Suffixes under which names are registered (a subset; the full list is a parameter).
SUFFIXES = ["co.uk", "com.br", "com.au", "gov.it", "edu.it", "altervista.org", "blogspot.com", "wixsite.com"]
#: Hosts of directories and social networks that are no company's own site (a subset; a parameter).
DIRECTORY_HOSTS = ["facebook.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "twitter.com", "google.com", "paginegialle.it", "tripadvisor.it", "immobiliare.it", "subito.it", "virgilio.it"]
#: Networks and their hosts.
SOCIAL = {"facebook": "facebook.com", "instagram": "instagram.com", "linkedin": "linkedin.com", "youtube": "youtube.com", "tiktok": "tiktok.com"}
GENERIC_MAILBOXES = ["info", "contatti", "amministrazione", "commerciale", "segreteria"]
PEC = r"@(?:.*\.)?(?:pec|legalmail|arubapec|postacert|pecmail|cert)\b"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_key(phone: Column) -> Column:
    """Digits without the country code; null below eight."""
    d = digits(phone)
    cut = F.when(d.startswith("0039"), F.substring(d, 5, 40)).when((F.length(d) >= 11) & d.startswith("39"), F.substring(d, 3, 40)).otherwise(d)
    return F.when(F.length(cut) >= 8, cut)


def _national(phone: Column) -> Column:
    d = digits(phone)
    rest = F.substring(d, 3, 40)
    coded = d.startswith("39") & (F.length(d) >= 8) & rest.rlike("^[03]") & F.length(rest).between(6, 11)
    return F.when(d.startswith("0039"), F.substring(d, 5, 40)).when(coded, rest).otherwise(d)


def phone_kind(phone: Column) -> Column:
    """landline, mobile or service; null for what is no national number."""
    n = _national(phone)
    kind = F.when(n.startswith("0"), "landline").when(n.startswith("3"), F.when(F.length(n).between(9, 10), F.lit("mobile"))).when(n.rlike("^(800|199|892|899|144|166)"), "service")
    return F.when(F.length(n).between(6, 11), kind)


def phone_e164(phone: Column) -> Column:
    return F.when(phone_kind(phone).isNotNull(), F.concat(F.lit("+39"), _national(phone)))


def suppression_phone(phone: Column) -> Column:
    """Digits without the country code; null below six."""
    d = digits(phone)
    cut = F.when(d.startswith("0039"), F.substring(d, 5, 40)).when((F.length(d) >= 11) & d.startswith("39"), F.substring(d, 3, 40)).otherwise(d)
    return F.when(F.length(cut) >= 6, cut)


def vat_digits(code: Column) -> Column:
    return digits(F.regexp_replace(F.trim(F.coalesce(code, F.lit(""))), "^(?i)it", ""))


def vat_valid(code: Column) -> Column:
    """Eleven digits whose check digit holds."""
    d = vat_digits(code)
    return d.rlike("^[0-9]{11}$") & F.call_function("luhn_check", d)


def vat_codes(text: Column) -> Column:
    """Checked codes of a text in the order of their first place, once each."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9A-Za-z_])(?:(?i)IT\s?)?([0-9]{11})(?=$|[^0-9A-Za-z_])"), F.lit(1))
    return F.array_distinct(F.filter(found, vat_valid))


def is_pec(email: Column) -> Column:
    return F.coalesce(F.lower(email).rlike(PEC), F.lit(False))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0)), F.lower))


def email_type(email: Column) -> Column:
    box = F.lower(F.split_part(email, F.lit("@"), F.lit(1)))
    return F.when(is_pec(email), "pec").when(box.isin(GENERIC_MAILBOXES), "generic").when(email.isNotNull(), "personal")


def with_scheme(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host without www; null where there is none."""
    found = F.lower(F.regexp_extract(with_scheme(F.trim(url)), r"^(?i)https?://(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.regexp_replace(filled(found), r"^www\.", "")


def registrable_domain(url: Column, suffixes: list[str] | None = None) -> Column:
    """The name under its suffix: three labels for a listed two-label suffix, else two."""

    def named(h: Column, labels: Column) -> Column:
        tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
        domain = bind(tail(2), lambda two: F.when(two.isin(suffixes or SUFFIXES), F.when(F.size(labels) > 2, tail(3))).otherwise(two))
        return F.when((F.size(labels) > 1) & ~h.rlike(r"^[0-9.]+$"), domain)

    return bind(host(url), lambda h: bind(F.split(h, r"\."), lambda labels: named(h, labels)))


def subdomain(url: Column) -> Column:
    h, d = host(url), registrable_domain(url)
    return F.when(h == d, "").otherwise(F.regexp_replace(F.substring(h, F.lit(1), F.length(h) - F.length(d)), r"\.$", ""))


def canonical_url(url: Column) -> Column:
    """host and path, without scheme, user, query, fragment, www and closing slashes."""
    path = F.regexp_replace(F.regexp_extract(with_scheme(F.trim(url)), r"^(?i)https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(host(url), path)


def is_directory_host(url: Column, hosts: list[str] | None = None) -> Column:
    own = F.array(*map(F.lit, hosts or DIRECTORY_HOSTS))
    ends = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.coalesce(bind(F.split(host(url), r"\."), lambda labels: F.arrays_overlap(ends(labels), own)), F.lit(False))


def social_network(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, own in SOCIAL.items():
        out = F.when((registrable_domain(url) == own) & ~F.lower(url).rlike(r"/(sharer|share|intent|plugins)\b"), name).otherwise(out)
    return out


def is_public_ipv4(address: Column) -> Column:
    """Whether a dotted address is none of the private, local or reserved blocks."""
    octet = lambda k: F.try_element_at(F.split(address, r"\."), F.lit(k)).try_cast("int")
    a, b = octet(1), octet(2)
    shut = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    return F.coalesce(address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~shut, F.lit(False))
