"""What a lead's web address is worth: classes, addresses to try, names in domains, map addresses, contact links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.contact import is_directory_host, registrable_domain
from leadloom.functions.text import bind, filled, has

#: Words of a name that identify nobody.
GENERIC_WORDS = [
    "immobiliare", "immobiliari", "agenzia", "agenzie", "studio", "studi", "servizi", "casa", "case", "gruppo", "group", "real", "estate",
    "house", "home", "citta", "city", "srl", "srls", "spa", "snc", "sas", "sapa", "scarl", "soc", "coop",
]
#: Hosts of messengers and of address shorteners.
MESSAGING_HOSTS = ["wa.me", "whatsapp.com", "api.whatsapp.com", "chat.whatsapp.com", "t.me", "telegram.me", "linktr.ee", "bit.ly", "tinyurl.com"]
#: What an address or text of a contact page holds.
CONTACT_WORDS = r"contatt|chi[-\s]?siamo|chisiamo|azienda|dove[-\s]?siamo|contact|about|impressum|note[-\s]?legali"

_PARTS = r"^(?i)(https?)://(?:[^/@?#]*@)?([^/:?#]+)(:[0-9]+)?([^?#]*)"
_HOST = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$"


def _schemed(url: Column) -> Column:
    cut = F.trim(url)
    return F.when(cut.rlike("^(?i)[a-z]+://"), cut).otherwise(F.concat(F.lit("https://"), F.regexp_replace(cut, "^/+", "")))


def _parts(url: Column) -> Column:
    """scheme, host, port with its colon unless it is the scheme's own, and path without closing slashes.

    A struct whose fields are matched once each, however often they are named.
    """
    part = lambda k: F.regexp_extract(url, _PARTS, k)

    def plain(p: Column) -> Column:
        own = F.when(p["scheme"] == "https", ":443").otherwise(":80")
        port = F.when(p["port"] == own, "").otherwise(p["port"])
        return F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), port.alias("port"), F.regexp_replace(p["path"], "/+$", "").alias("path"))

    return bind(F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("port"), part(4).alias("path")), plain)


def normal_url(url: Column) -> Column:
    """Scheme, host, port and path of a web address; null where there is no usable host."""
    whole = lambda p: F.when(p["host"].rlike(_HOST), F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], p["path"]))
    return F.when(has(url), bind(_schemed(url), lambda u: bind(_parts(u), whole)))


def website_class(url: Column) -> Column:
    """VALID, INVALID (null and empty too), DIRECTORY_OR_SOCIAL or MESSAGING_OR_REDIRECT."""

    return bind(normal_url(url), _class_of)


def _class_of(normal: Column) -> Column:
    """The class of a normal address."""
    messaging = lambda bare: bare.isin(MESSAGING_HOSTS)
    bare = F.regexp_replace(F.lower(F.regexp_extract(normal, _PARTS, 2)), r"^www\.", "")
    return F.when(normal.isNull(), "INVALID").when(bind(bare, messaging), "MESSAGING_OR_REDIRECT").when(is_directory_host(normal), "DIRECTORY_OR_SOCIAL").otherwise("VALID")


def website_candidates(url: Column) -> Column:
    """Addresses to try for a valid one, in order: as given, the host alone, with and without www, the registrable domain;
    an http address is tried under https too. Empty for the other classes."""
    none = F.array().cast("array<string>")
    www = lambda h: F.concat(F.lit("www."), h)

    def parts(p: Column) -> Column:
        both = F.when(p["scheme"] == "http", F.array(F.lit("http://"), F.lit("https://"))).otherwise(F.array(F.lit("https://")))
        named = lambda bare: F.struct(both.alias("schemes"), p["host"].alias("host"), bare.alias("bare"), registrable_domain(bare).alias("domain"), p["port"].alias("port"), p["path"].alias("path"))
        return bind(F.regexp_replace(p["host"], r"^www\.", ""), named)

    def tried(p: Column) -> Column:
        host, bare, domain, port = p["host"], p["bare"], p["domain"], p["port"]
        deep = lambda h: F.flatten(F.transform(p["schemes"], lambda s: F.array(F.concat(s, h, port, p["path"]), F.concat(s, h, port))))
        flat = lambda h: F.transform(p["schemes"], lambda s: F.concat(s, h, port))
        other = F.when(bare != host, deep(bare)).otherwise(flat(www(bare)))
        above = F.when(domain.isNotNull() & (domain != bare), F.concat(flat(domain), flat(www(domain)))).otherwise(none)
        return F.array_distinct(F.concat(deep(host), other, above))

    valid = lambda normal: F.when(_class_of(normal) == "VALID", bind(bind(_parts(normal), parts), tried)).otherwise(none)
    return bind(normal_url(url), valid)


def domain_has_name(url: Column, name: Column) -> Column:
    """Whether a word of the name of 4 or more letters that isn't generic stands in the host before its last label."""
    host = F.regexp_replace(filled(F.lower(F.regexp_extract(_schemed(url), _PARTS, 2))), r"^www\.", "")
    before = lambda labels: F.when(F.size(labels) >= 2, F.regexp_replace(F.array_join(F.slice(labels, 1, F.size(labels) - 1), ""), "[^a-z0-9]", ""))
    core = bind(F.filter(F.split(host, r"\."), lambda x: x != ""), before)
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda t: (F.length(t) >= 4) & ~t.isin(GENERIC_WORDS))
    return F.coalesce(bind(core, lambda c: F.exists(words, lambda t: F.contains(c, t))), F.lit(False))


_GOOGLE = r"^(?:www\.|maps\.)?google\.(?:[a-z]{2,3}|com\.[a-z]{2}|co\.[a-z]{2})$"


def _map_parts(url: Column) -> tuple[Column, Column, Column]:
    part = lambda k: F.regexp_extract(F.trim(url), _PARTS, k)
    host = F.lower(part(2))
    return host.rlike(_GOOGLE), host.startswith("maps."), part(4)


def is_map_url(url: Column) -> Column:
    """Any page of the map service: its own host, or its path on the search host."""
    known, own, path = _map_parts(url)
    return F.coalesce(known & (own | (path == "/maps") | path.startswith("/maps/")), F.lit(False))


def is_map_place(url: Column) -> Column:
    """One place, not a search."""
    known, own, path = _map_parts(url)
    return F.coalesce(known & ~own & path.startswith("/maps/place/"), F.lit(False))


def map_search_url(category: Column, place: Column) -> Column:
    """Address of a map search; null where either is empty."""
    words = F.replace(F.url_encode(F.concat_ws(" ", F.trim(category), F.trim(place))), F.lit("+"), F.lit("%20"))
    return F.when(has(category) & has(place), F.concat(F.lit("https://www.google.com/maps/search/"), words, F.lit("/?hl=it")))


def contact_links(html: Column, site: Column, most: int = 3) -> Column:
    """The first addresses of contact and about pages on the site's own domain, as the feature caps them; empty for nulls.

    A link without scheme and host is taken from the root of the site, as home pages are what is scanned.
    """
    base = F.regexp_replace(F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), registrable_domain(site))), "/+$", "")
    root = F.regexp_extract(base, r"^(?i)(https?://[^/?#]+)", 1)
    found = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\s[^>]*href\s*=\s*["'][^"'>]*["'][^>]*>.*?</a>)"""), F.lit(1))
    link = lambda a: F.trim(F.regexp_extract(a, r"""(?is)href\s*=\s*["']([^"'>]*)["']""", 1))
    shown = lambda a: F.regexp_replace(a, "(?s)<[^>]*>", "")
    wanted = F.filter(found, lambda a: (link(a) != "") & ~link(a).rlike("^(?i)(#|mailto:|tel:|javascript:)") & (link(a).rlike(f"(?i){CONTACT_WORDS}") | shown(a).rlike(f"(?i){CONTACT_WORDS}")))
    whole = F.transform(wanted, lambda a: F.when(link(a).rlike("^(?i)https?://"), link(a)).when(link(a).startswith("//"), F.concat(F.lit("https:"), link(a))).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(link(a), r"^(\.?/)+", ""))))
    clean = F.array_distinct(F.transform(whole, lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/$", "")))
    kept = F.filter(clean, lambda u: (registrable_domain(u) == registrable_domain(site)) & (u != base))
    return F.coalesce(F.slice(kept, 1, most), F.array().cast("array<string>"))
