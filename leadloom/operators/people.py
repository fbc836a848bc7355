"""Parts of firm names, likely mailboxes, and what mail and tax-code services answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.contact import vat_digits, vat_valid
from leadloom.functions.text import bind, has, strip_diacritics

#: Legal forms in the order in which they are looked for.
LEGAL_FORMS = [
    "srl", "s.r.l.", "srls", "s.r.l.s.", "spa", "s.p.a.", "snc", "s.n.c.", "sas", "s.a.s.", "sapa", "s.a.p.a.", "ss", "s.s.",
    "societa a responsabilita limitata", "societa per azioni", "societa in nome collettivo", "societa in accomandita semplice", "societa semplice",
    "coop", "cooperativa", "soc. coop.", "societa cooperativa", "scarl", "s.c.a.r.l.", "scrl", "s.c.r.l.", "onlus", "a.p.s.", "aps", "ets",
]
#: Words for what a firm does.
DESCRIPTORS = [
    "ditta", "impresa", "studio", "officina", "autofficina", "carrozzeria", "autosoccorso", "gommista", "elettrauto", "meccatronica", "impianti",
    "elettrici", "termoidraulica", "costruzioni", "edile", "edilizia", "immobiliare", "autotrasporti", "logistica", "servizi", "pulizie",
    "ristorante", "pizzeria", "bar", "hotel", "albergo", "agriturismo", "farmacia", "parafarmacia", "ottica", "odontoiatrica", "dentistico",
    "poliambulatorio", "clinica", "veterinaria", "supermercato", "minimarket", "macelleria", "panificio", "pasticceria", "gelateria", "abbigliamento",
    "calzature", "pelletteria", "lavanderia", "estetica", "parrucchiere", "barbiere", "acconciature", "fiorista", "vivaio", "agricola",
    "agraria", "farm", "fondazione", "associazione", "gruppo", "group", "sistemi", "systems", "tecnologie", "technologies", "soluzioni",
    "solutions", "consulting", "consulenze", "partners", "fratelli", "f.lli", "sorelle", "figli", "eredi", "di", "e", "&", "and",
]
#: Shared mailboxes and how likely a firm has them.
ROLES = [("info", 0.55), ("contatti", 0.45), ("amministrazione", 0.3), ("commerciale", 0.25), ("segreteria", 0.2)]
#: Answers by which the tax-code service says that it checked nothing.
UNCHECKED = ["SERVICE_UNAVAILABLE", "MS_UNAVAILABLE", "TIMEOUT", "GLOBAL_MAX_CONCURRENT_REQ", "GLOBAL_MAX_CONCURRENT_REQ_TIME", "MS_MAX_CONCURRENT_REQ", "MS_MAX_CONCURRENT_REQ_TIME", "IP_BLOCKED"]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_parts(name: Column) -> Column:
    """(normalized, legal_form, descriptors, brand, core): the first listed legal form goes from the name once; words that say
    what a firm does are descriptors unless nothing else is left."""
    none = F.array().cast("array<string>")

    def without_form(padded: Column) -> Column:
        form = F.try_element_at(F.filter(_texts(LEGAL_FORMS), lambda f: F.contains(padded, F.concat(F.lit(" "), f, F.lit(" ")))), F.lit(1))

        def rest(f: Column) -> Column:
            at = F.position(F.concat(F.lit(" "), f, F.lit(" ")), padded)
            cut = F.concat(F.substring(padded, F.lit(1), at), F.substring(padded, at + F.length(f) + 1, F.length(padded)))
            return F.struct(_squeeze(F.coalesce(cut, padded)).alias("normalized"), f.alias("legal_form"))

        return bind(form, rest)

    def sorted_out(r: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(r["normalized"], r"[.\-&]", " "), " +"), lambda t: t != "")
        known = lambda t: t.isin(DESCRIPTORS)
        split = bind(words, lambda w: F.struct(w.alias("words"), F.filter(w, known).alias("known"), F.filter(w, lambda t: ~known(t)).alias("own")))
        out = lambda s: F.struct(F.when(F.size(s["own"]) > 0, s["known"]).otherwise(none).alias("descriptors"), F.when(F.size(s["own"]) > 0, s["own"]).otherwise(s["words"]).alias("brand"))
        done = lambda d: F.struct(r["normalized"].alias("normalized"), r["legal_form"].alias("legal_form"), d["descriptors"].alias("descriptors"), d["brand"].alias("brand"), F.array_join(d["brand"], " ").alias("core"))
        return bind(bind(split, out), done)

    padded = F.concat(F.lit(" "), _squeeze(F.regexp_replace(strip_diacritics(F.lower(name)), r"[^a-z0-9&.\s-]", " ")), F.lit(" "))
    return bind(bind(padded, without_form), sorted_out)


def _mailbox(local: Column, pattern: str, prior: float, place: int) -> Column:
    return F.struct(F.lit(-prior).alias("below"), F.lit(place).alias("place"), local.alias("local"), F.lit(pattern).alias("pattern"))


def email_candidates(domain: Column, name: Column, person: Column) -> Column:
    """Likely (email, pattern, prior) of a domain, the likeliest first: shared mailboxes, then those of a person, who is
    the given one or a firm name of just two words that is no description. Empty without a domain."""
    self_named = lambda p: F.when((F.size(p["descriptors"]) == 0) & (F.size(p["brand"]) == 2), p["core"])
    who = F.when(has(person), person).otherwise(bind(name_parts(name), self_named))
    plain = F.regexp_replace(F.regexp_replace(strip_diacritics(F.lower(who)), "['’`]", ""), r"[^a-z0-9\s]", " ")

    def boxes(names: Column) -> Column:
        first, last = F.try_element_at(names, F.lit(1)), F.try_element_at(names, F.lit(-1))
        two = lambda text: F.when(F.size(names) >= 2, text)
        own = [
            _mailbox(two(F.concat_ws(".", first, last)), "person.dot", 0.35, 5),
            _mailbox(two(F.concat_ws(".", F.substring(first, 1, 1), last)), "person.initial", 0.3, 6),
            _mailbox(two(F.concat(first, last)), "person.concat", 0.2, 7),
            _mailbox(two(last), "person.surname", 0.15, 8),
        ]
        return F.filter(F.array(*[_mailbox(F.lit(local), "role", prior, k) for k, (local, prior) in enumerate(ROLES)], *own), lambda b: b["local"].isNotNull())

    first_of = lambda bs: F.filter(bs, lambda b, i: F.array_position(F.transform(bs, lambda x: x["local"]), b["local"]) == i + 1)
    once = bind(bind(F.filter(F.split(_squeeze(plain), " "), lambda t: F.length(t) >= 2), boxes), first_of)
    host = F.regexp_replace(F.lower(F.trim(domain)), r"\.$", "")
    out = F.transform(F.array_sort(once), lambda b: F.struct(F.concat(b["local"], F.lit("@"), host).alias("email"), b["pattern"].alias("pattern"), (-b["below"]).alias("prior")))
    return F.filter(out, lambda _: F.contains(host, F.lit(".")))


def best_email(found: Column) -> Column:
    """Of (value, type, confidence) in order: the first shared mailbox, else the most confident, the first of equals; null of none."""
    shared = F.filter(found, lambda e: F.coalesce(e["type"] == "generic", F.lit(False)) | F.coalesce(F.lower(e["value"]).rlike("^(info|contatti?|contact|hello|sales|commerciale)@"), F.lit(False)))
    rank = F.array_sort(F.transform(found, lambda e, i: F.struct((-F.coalesce(e["confidence"], F.lit(0.0))).alias("below"), i.alias("place"), e["value"].alias("value"))))
    return F.when(F.size(shared) > 0, F.try_element_at(shared, F.lit(1))["value"]).otherwise(F.try_element_at(rank, F.lit(1))["value"])


def mail_verdict(servers: Column, probe: Column, reached: Column, greeting: Column, sender: Column, anyone: Column, answers: Column, most: int = 3) -> Column:
    """(class, place, note) from what a mail server answered: the number of mail exchangers, whether to ask and whether it
    was reached, the codes for greeting, sender and a made-up mailbox, and those for the candidates, of which the first
    `most` count. place is the first accepted candidate, from 1."""
    good, later = lambda c: F.coalesce(c.between(200, 299), F.lit(False)), lambda c: F.coalesce(c.between(400, 499), F.lit(False))
    asked = F.slice(F.coalesce(answers, F.array().cast("array<int>")), 1, most)
    at = F.array_position(F.transform(asked, good), F.lit(True))
    case = [
        (F.coalesce(servers, F.lit(0)) == 0, "undeliverable", F.lit("no_mx")),
        (~probe, "mx_only", F.lit("probe_disabled")),
        (~F.coalesce(reached, F.lit(False)), "unknown", F.lit("smtp_unreachable")),
        (~good(greeting), "unknown", F.concat(F.lit("helo_"), greeting)),
        (~good(sender), "unknown", F.concat(F.lit("mailfrom_"), sender)),
        (good(anyone), "catch_all", F.lit("accepts_any")),
        (later(anyone), "unknown", F.lit("greylist")),
        (at > 0, "deliverable", F.concat(F.lit("rcpt_"), F.try_element_at(asked, at.cast("int")))),
        (F.exists(asked, later), "unknown", F.lit("greylist")),
    ]
    cls, note = F.lit("undeliverable"), F.lit("rejected")
    for when, c, n in reversed(case):
        cls, note = F.when(when, c).otherwise(cls), F.when(when, n).otherwise(note)
    return F.struct(cls.alias("class"), F.when((cls == "deliverable"), at).alias("place"), note.alias("note"))


def inferred_confidence(prior: Column) -> Column:
    """Of an address that a server accepted."""
    return F.least(F.lit(0.92), 0.8 + prior * 0.2)


def vat_answer(code: Column, status: Column, valid: Column, error: Column) -> Column:
    """(is_valid, checked, source, note) of an Italian tax code and the service's answer (HTTP status, its flag, its error):
    a code of wrong form or check digit is never asked for, and one that nobody could check counts provisionally."""
    form, sum_ok = vat_digits(code).rlike("^[0-9]{11}$"), vat_valid(code)
    busy = F.coalesce(error.isin(UNCHECKED), F.lit(False))
    answered = status.between(200, 299) & ~busy
    refused = status.between(400, 499) & (status != 429)
    case = [
        (~form, False, False, "checksum", F.lit("it_vat_format_invalid")),
        (~sum_ok, False, False, "checksum", F.lit("it_vat_checksum_failed")),
        (status.isNull(), True, False, "provisional", F.lit("vies_unreachable")),
        (answered & F.coalesce(valid, F.lit(False)), True, True, "vies", F.lit(None).cast("string")),
        (answered, False, True, "vies", F.lit(None).cast("string")),
        (status.between(200, 299), True, False, "provisional", F.concat(F.lit("vies_"), F.lower(error))),
        (refused, False, True, "vies", F.concat(F.lit("vies_http_"), status)),
    ]
    out = F.struct(F.lit(True).alias("is_valid"), F.lit(False).alias("checked"), F.lit("provisional").alias("source"), F.lit("vies_unavailable").alias("note"))
    for when, ok, checked, source, note in reversed(case):
        out = F.when(when, F.struct(F.lit(ok).alias("is_valid"), F.lit(checked).alias("checked"), F.lit(source).alias("source"), note.alias("note"))).otherwise(out)
    return out
