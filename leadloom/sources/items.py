"""Records out of JSON of many shapes: portal agencies, register entries, map places, mail checks, registry payloads.

A payload is one variant. A field is the first non-empty of an ordered list of paths; the lists are data, so a new
shape is a new list. Text that is no JSON is kept with a reason. All of it is columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import is_directory_host
from leadloom.functions.text import filled
from leadloom.operators.website import is_map_url

#: The names under which three kinds of portal items give each field, in order.
PORTALS = {
    "immobiliare": {
        "name": "name agencyName agency_name title ragioneSociale", "phone": "phone phoneNumber telefono", "late_phone": "phoneNumbers", "email": "email emails mail",
        "website": "website site url_sito websiteUrl", "city": "city citta comune", "province": "province provincia", "address": "address indirizzo fullAddress",
        "listings": "realEstateAds listingsCount totalAds numAnnunci adsCount properties", "paid": "isPaid is_paid premium isPremium", "association": "", "portal_url": "agencyUrl portalUrl url link", "social": "socials socialLinks",
    },
    "immobiliare_ads": {
        "name": "name agencyName agency_name title", "phone": "phone phoneNumber telefono phones", "late_phone": "", "email": "",
        "website": "", "city": "city citta comune location", "province": "province provincia", "address": "address indirizzo",
        "listings": "listingsCount totalAds numAnnunci adsCount activeListings properties", "paid": "isPaid is_paid premium isPremium", "association": "fiaip isFiaip FIAIP", "portal_url": "agencyUrl portalUrl url link", "social": "",
    },
    "wikicasa": {
        "name": "company_name name agencyName agency_name title", "phone": "", "late_phone": "", "email": "email emails",
        "website": "website site websiteUrl web", "city": "city_name city citta comune", "province": "province provincia", "address": "address indirizzo",
        "listings": "active_real_estates visible_real_estates listingsCount", "paid": "premium isPaid", "association": "", "portal_url": "agencyUrl portalUrl url link from_url", "social": "",
    },
}
#: Which fields make an item of each kind a record.
_NEEDS = {"immobiliare": ("name", "phone", "email"), "immobiliare_ads": ("name", "phone"), "wikicasa": ("name", "website")}


def fields(payload: Column) -> Column:
    """The members of a JSON object as a map of variants; null for text that is no JSON or no object."""
    return F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")


def scalar(v: Column) -> Column:
    """Trimmed text of a string, or a number as text; null for anything else and for white space."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(kind == "STRING", filled(F.trim(text))).when(kind.rlike(_NUMBER), number)


_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _first_of(m: Column, keys: Column, read) -> Column:
    """The first value that read finds among the members with these names."""
    return F.get(F.filter(F.transform(keys, lambda k: read(F.try_element_at(m, k))), lambda x: x.isNotNull()), F.lit(0))


def _keys(names: str | Column) -> Column:
    return F.split(F.lit(names), " ") if isinstance(names, str) else names


def text_at(m: Column, names: str | Column) -> Column:
    """The first scalar among the members; a list stands for its first element."""
    return _first_of(m, _keys(names), lambda v: F.coalesce(scalar(v), scalar(F.try_variant_get(v, "$[0]", "variant"))))


def number_at(m: Column, names: str | Column) -> Column:
    """The first number, or text of digits only, among the members."""

    def read(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.trim(F.try_variant_get(v, "$", "string"))
        return F.when(kind.rlike(_NUMBER) | ((kind == "STRING") & text.rlike("^[0-9]+$")), text.try_cast("double"))

    return _first_of(m, _keys(names), read)


def flag_at(m: Column, names: str | Column) -> Column:
    """The first yes or no among the members: a boolean or one of its words."""

    def read(v: Column) -> Column:
        text = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
        word = F.when(text.isin("true", "yes", "si", "sì", "1"), True).when(text.isin("false", "no", "0"), False)
        return F.when(F.schema_of_variant(v).isin("BOOLEAN", "STRING"), word)

    return _first_of(m, _keys(names), read)


def social_at(m: Column, network: str, names: str | Column) -> Column:
    """The first address of the network in the members, which may be lists, without its query."""

    def read(v: Column) -> Column:
        every = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(scalar(v)))
        return F.get(F.filter(every, lambda u: u.rlike(rf"(?i){network}\.com")), F.lit(0))

    return F.split_part(F.trim(_first_of(m, _keys(names), read)), F.lit("?"), F.lit(1))


def own_site(text: Column) -> Column:
    """An address with a scheme, null for a directory's, a portal's or a map's."""
    url = F.when(text.rlike("^(?i)https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(~is_directory_host(url) & ~F.coalesce(is_map_url(url), F.lit(False)), url)


def _mail(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"^[^\s@]+@[^\s@]+\.[a-z]{2,}$"), low)


def _real_phone(m: Column) -> Column:
    """The first number of a list of phone objects that is not the portal's own (isVirtual)."""
    phones = F.try_variant_get(F.try_element_at(m, F.lit("phones")), "$", "array<variant>")
    real = F.filter(phones, lambda p: ~F.coalesce(F.try_variant_get(p, "$.isVirtual", "boolean"), F.lit(False)))
    read = F.transform(real, lambda p: F.coalesce(scalar(F.try_variant_get(p, "$.formattedValues", "variant")), scalar(F.try_variant_get(p, "$.value", "variant"))))
    return F.get(F.filter(read, lambda t: t.isNotNull()), F.lit(0))


def _located(m: Column, path: str) -> Column:
    return scalar(F.try_variant_get(F.try_element_at(m, F.lit("location")), path, "variant"))


def portal_records(items: DataFrame) -> DataFrame:
    """items (item_id, portal, payload text) as records; reason says why one is none: bad_json, unknown_portal or no_identity.

    Columns: item_id, portal, reason, name, phone, email, website, city, province, address, instagram, facebook, linkedin,
    listings, paid, association, portal_url. A phone that is the portal's own number is passed over.
    """
    m, portal = F.col("m"), F.col("portal")

    def names(field: str) -> Column:
        """The names of a field in the row's kind of item."""
        out = F.array().cast("array<string>")
        for kind, given in PORTALS.items():
            if given[field]:
                out = F.when(portal == kind, F.split(F.lit(given[field]), " ")).otherwise(out)
        return out

    first = portal == "immobiliare"
    text = lambda field: text_at(m, names(field))
    social = lambda n: F.when(first, social_at(m, n, F.concat(F.array(F.lit(n)), names("social"))))
    out = items.select("item_id", "portal", fields(F.col("payload")).alias("m")).select(
        "item_id", "portal", m.isNull().alias("bad"), text("name").alias("name"), F.coalesce(text("phone"), F.when(first, F.coalesce(_real_phone(m), text("late_phone")))).alias("phone"),
        _mail(text("email")).alias("email"), own_site(text("website")).alias("website"), F.coalesce(text("city"), F.when(first, _located(m, "$.city.name"))).alias("city"),
        F.coalesce(text("province"), F.when(first, _located(m, "$.province.id"))).alias("province"), text("address").alias("address"), *[social(n).alias(n) for n in ("instagram", "facebook", "linkedin")],
        number_at(m, names("listings")).cast("bigint").alias("listings"), flag_at(m, names("paid")).alias("paid"), flag_at(m, names("association")).alias("association"), text("portal_url").alias("portal_url"),
    )
    known = F.lit(False)
    for kind, needs in _NEEDS.items():
        known = known | ((portal == kind) & F.coalesce(*needs).isNotNull())
    reason = F.when(F.col("bad"), "bad_json").when(~F.coalesce(portal.isin(*PORTALS), F.lit(False)), "unknown_portal").when(~known, "no_identity")
    return out.withColumn("reason", reason).drop("bad")


def register_records(items: DataFrame) -> DataFrame:
    """(item_id, name, vat, legal_form, sector, capital, revenue, revenue_year, profit, profit_year, employees, pec, rea, address, person, role) of business-register payloads of both kinds.

    The person is a named office, else the first of the list of officers.
    """
    m = F.col("m")
    text = lambda names: text_at(m, names)
    named = text("amministratore titolare legaleRappresentante rappresentante")
    office = F.when(text("amministratore").isNotNull(), "amministratore").when(text("titolare").isNotNull(), "titolare").otherwise("legale rappresentante")
    officer = F.try_variant_get(F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in ("esponenti", "exponents", "cariche")]), "$[0]", "map<string,variant>")
    columns = {
        "name": text("denominazione ragioneSociale name companyName"), "vat": filled(F.regexp_replace(text("partitaIva piva vatNumber vat"), "[^0-9]", "")), "legal_form": text("formaGiuridica legalForm"),
        "sector": F.coalesce(text("ateco"), filled(F.concat_ws(" — ", text("atecoCode"), text("atecoDescription")))), "capital": text("capitaleSociale shareCapital"), "revenue": text("fatturato ricavi revenue turnover"),
        "revenue_year": text("fatturatoAnno annoBilancio anno year"), "profit": text("utile"), "profit_year": text("utileAnno"), "employees": text("dipendenti employees"), "pec": text("pec"), "rea": text("rea"), "address": text("indirizzo address sede"),
        "person": F.coalesce(named, text_at(F.col("o"), "nome nominativo name")), "role": F.when(named.isNotNull(), F.coalesce(text("caricaAmministratore"), office)).otherwise(text_at(F.col("o"), "carica ruolo role")),
    }
    return items.select("item_id", fields(F.col("payload")).alias("m")).withColumn("o", officer).select("item_id", *[c.alias(n) for n, c in columns.items()])


def place_records(items: DataFrame) -> DataFrame:
    """(item_id, name, website, phone, rating, reviews, instagram, facebook, category, address) of map places; a map address is no website."""
    m = F.col("m")
    names = {"name": "title name", "website": "website", "phone": "phone phoneUnformatted", "rating": "totalScore rating", "reviews": "reviewsCount reviewsCountText", "category": "categoryName category", "address": "address street"}
    texts = {n: text_at(m, k) for n, k in names.items()}
    texts["website"] = F.when(~F.coalesce(is_map_url(texts["website"]), F.lit(False)), texts["website"])
    socials = {n: social_at(m, n, f"{n}s") for n in ("instagram", "facebook")}
    return items.select("item_id", fields(F.col("payload")).alias("m")).select("item_id", *[c.alias(n) for n, c in (texts | socials).items()])


def mail_checks(items: DataFrame) -> DataFrame:
    """(item_id, email, status) of mail-check payloads: deliverable, invalid, catch_all, else unknown."""
    m = F.col("m")
    word = F.coalesce(F.lower(text_at(m, "status result verdict state deliverability")), F.lit(""))
    sign = F.exists(F.array(*map(F.lit, ("catchAll", "catch_all", "isCatchAll"))), lambda k: F.coalesce((F.schema_of_variant(F.try_element_at(m, k)) == "BOOLEAN") & F.try_variant_get(F.try_element_at(m, k), "$", "boolean"), F.lit(False)))
    status = (
        F.when(sign | word.contains("catch"), "catch_all")
        .when(word.rlike("^(deliverable|valid|ok|safe|passed|exists?|good)$"), "deliverable")
        .when(word.rlike("^(undeliverable|invalid|bad|bounced?|rejected|not?[_ ]?exists?|disabled)$"), "invalid")
        .when(word.rlike("^accept[_ ]all$"), "catch_all")
        .otherwise("unknown")
    )
    return items.select("item_id", fields(F.col("payload")).alias("m")).select("item_id", F.lower(text_at(m, "email address emailAddress")).alias("email"), status.alias("status"))


# --- domain registry --------------------------------------------------------------------------------------------

#: Legal forms that are cut out of a name before it is compared with a registrant.
_FORMS = r"(?i)s\.?r\.?l\.?(s)?|s\.?p\.?a\.?|s\.?n\.?c\.?|s\.?a\.?s\.?|scarl|srls|unipersonale|in liquidazione"


def name_share(name: Column, target: Column) -> Column:
    """Share of a name's words of three and more letters that stand in the target; 0 without any."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), _FORMS, ""), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) >= 3)
    low = F.lower(target)
    return F.coalesce(F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.contains(low, t))) / F.size(words)), F.lit(0.0))


def registry_evidence(payloads: DataFrame) -> DataFrame:
    """(lead_id, confidence, evidence, mismatch, mismatch_reason) of registry payloads beside a lead (lead_id, payload, company_name, vat_code, city, province).

    The lead's tax code anywhere in the payload gives 0.9 and ends the matter. Else the first registrant name (fn or org of
    the entities' cards) of which the lead's words are at least 0.6 gives 0.4, 0.4 gives 0.2; else 0.8 of them anywhere 0.2.
    A registrant address (adr) elsewhere is a mismatch: another country, then another two-letter region, then another place.
    """
    v = F.col("v")
    rows = payloads.select("lead_id", "company_name", F.regexp_replace(F.coalesce("vat_code", F.lit("")), "[^0-9]", "").alias("vat"), F.lower(F.coalesce("city", F.lit(""))).alias("city"), F.upper(F.coalesce("province", F.lit(""))).alias("province"), F.try_parse_json("payload").alias("v"))
    entities = F.try_variant_get(v, "$.entities", "array<variant>")
    cards = F.flatten(F.filter(F.transform(entities, lambda e: F.try_variant_get(e, "$.vcardArray[1]", "array<variant>")), lambda c: c.isNotNull()))
    key = lambda e: F.try_variant_get(e, "$[0]", "string")
    names = F.transform(F.filter(cards, lambda e: key(e).isin("fn", "org")), lambda e: F.lower(F.coalesce(F.try_variant_get(e, "$[3]", "string"), F.lit(""))))
    places = F.filter(F.transform(F.filter(cards, lambda e: key(e) == "adr"), lambda e: F.try_variant_get(e, "$[3]", "array<string>")), lambda a: F.size(a) >= 7)
    part = lambda a, k: F.trim(F.coalesce(F.get(a, F.lit(k)), F.lit("")))

    def elsewhere(a: Column) -> Column:
        place, region, country = F.lower(part(a, 3)), F.upper(part(a, 4)), F.upper(part(a, 6))
        city, province = F.col("city"), F.col("province")
        return (
            F.when((country != "") & ~country.isin("IT", "ITA", "ITALY"), F.concat(F.lit("registrant_country="), country))
            .when((F.length(region) == 2) & (province != "") & (region != province), F.concat(F.lit("registrant_region="), region, F.lit(" lead="), province))
            .when((F.length(place) >= 3) & (F.length(city) >= 3) & ~F.contains(place, city) & ~F.contains(city, place), F.concat(F.lit('registrant_locality="'), place, F.lit('" lead="'), city, F.lit('"')))
        )

    whole = F.lower(F.try_variant_get(v, "$", "string"))
    read = rows.select("lead_id", "company_name", "vat", "city", "province", whole.alias("whole"), names.alias("names"), places.alias("places"))
    read = read.withColumns({
        "shares": F.filter(F.transform("names", lambda n: name_share(F.col("company_name"), n)), lambda s: s >= 0.4),
        "reason": F.get(F.filter(F.transform("places", elsewhere), lambda r: r.isNotNull()), F.lit(0)),
    })
    coded = (F.length("vat") == 11) & F.coalesce(F.contains("whole", "vat"), F.lit(False))
    first, anywhere = F.get("shares", F.lit(0)), name_share(F.col("company_name"), F.col("whole"))
    named = first.isNotNull()
    return read.select(
        "lead_id",
        F.when(coded, 0.9).when(first >= 0.6, 0.4).when(named, 0.2).when(anywhere >= 0.8, 0.2).otherwise(0.0).alias("confidence"),
        F.when(coded, "piva_in_payload").when(named, "name_in_vcard").when(anywhere >= 0.8, "name_in_payload").otherwise("none").alias("evidence"),
        (~coded & F.col("reason").isNotNull()).alias("mismatch"), F.when(~coded, F.col("reason")).alias("mismatch_reason"),
    )
