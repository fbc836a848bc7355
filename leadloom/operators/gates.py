"""Row predicates and classes: entity guard, category match, off-target names, business model, triage, evidence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import digits, host, phone_key, vat_digits
from leadloom.functions.text import company_key_text, has, key_text, strip_diacritics

#: Legal forms that say nothing about who a firm is.
LEGAL = ["srl", "srls", "spa", "snc", "sas", "sapa", "scarl", "scrl", "soc", "coop"]
#: Patterns of names outside a freight list, hard, soft, and what redeems a soft one.
HARD = r"(?i)(?:^|[\s.,'\"()-])(taxi|n\.?\s?c\.?\s?c\.?(?:[\s.,)]|$)|noleggio\s+con\s+conducente|autoscuol\w*)"
SOFT = r"(?i)(traslochi|trasloco|trasporto\s+person[ei])"
FREIGHT = r"(?i)(autotrasport|trasport[oi]\s+merci|conto\s+terzi|trasporti\s+(?:nazional|internazional)|spedizion|logistic|corrier[ei]|magazzin|deposit[oi]|movimento\s+terra|groupage|intermodal)"
#: Business models in order, by words of the category.
MODELS = [
    ("B2B_manufacturing", "manifatt|industr|meccanic|metalmecc|produzione|produttor|component|impiant|stamp|lavorazione|utensil|macchinari|arredo|serrament|automazione|fonderia|plastica|gomma"),
    ("professional_local", "dentist|odontoiatr|medic|clinic|poliambulator|fisioterap|studio (?:legale|tecnico|dentistico|medico)|avvocat|commercialist|architett|ingegner|notai|veterinar|psicolog|centro (?:medico|estetico|specializzato)"),
    ("hospitality_retail", r"ristorant|pizzeri|trattoria|osteria|hotel|albergo|\bb&b\b|agriturismo|bar\b|catering|gelateria|pasticceria|caff[eè]|resort|ricettiv"),
    ("B2C_product", r"e-?commerce|negozio|\bshop\b|store|abbigliament|calzatur|gioieller|cosmesi|profumeria|alimentar|enotec|cantina|food|moda|design (?:prodotto)?"),
]


def name_tokens(name: Column) -> Column:
    words = F.split(company_key_text(name), " ")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(LEGAL)))


def tokens_match(x: Column, y: Column) -> Column:
    """Whether two sets of name tokens name one firm: one shared word only if it is all of both; else containment or half of the union."""
    shared = F.size(F.array_intersect(x, y))
    two = (shared == F.size(x)) | (shared == F.size(y)) | (shared / F.size(F.array_union(x, y)) >= 0.5)
    return F.coalesce(F.when(shared == 1, (F.size(x) == 1) & (F.size(y) == 1)).when(shared > 1, two).otherwise(False), F.lit(False))


def names_match(a: Column, b: Column) -> Column:
    """tokens_match of two firm names."""
    return tokens_match(name_tokens(a), name_tokens(b))


def match_keys(tokens: Column) -> Column:
    """Keys of sorted name tokens; two sets that tokens_match accepts share one: the only token, or a pair of tokens."""
    rest = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    pairs = F.flatten(F.transform(tokens, lambda t, i: F.transform(rest(i), lambda u: F.concat_ws(" ", t, u))))
    return F.when(F.size(tokens) == 1, tokens).otherwise(pairs)


def wrong_entity(fetched: Column, own: Column) -> Column:
    """Whether fetched data must be refused; a missing name refuses."""
    return ~names_match(fetched, own)


def category_match(requested: Column, tag: Column) -> Column:
    """confirmed, unknown or mismatch: whether a longer word of the request stands in the tag."""
    wanted = F.filter(F.split(key_text(requested), " "), lambda t: F.length(t) >= 4)
    shown = key_text(F.coalesce(tag, F.lit("")))
    return F.when(requested.isNull() | (shown == "") | (F.size(wanted) == 0), "unknown").when(F.exists(wanted, lambda t: F.contains(shown, t)), "confirmed").otherwise("mismatch")


def off_target(name: Column) -> Column:
    return F.coalesce(name.rlike(HARD) | (name.rlike(SOFT) & ~name.rlike(FREIGHT)), F.lit(False))


def business_model(category: Column, shown: Column | None = None) -> Column:
    """The first model whose words stand in the category and what the lead was shown under."""
    text = F.lower(F.concat(F.coalesce(category, F.lit("")), F.lit(" "), F.coalesce(shown, F.lit("")) if shown is not None else F.lit("")))
    out = F.lit("unknown")
    for model, words in reversed(MODELS):
        out = F.when(text.rlike(words), model).otherwise(out)
    return out


def disqualifier(closed: Column, category: Column, *identity: Column) -> Column:
    """Why a lead needs no judgment: closed, then a mere reseller, then nothing to identify it; else null."""
    known = F.lit(False)
    for c in identity:
        known = known | has(c)
    return F.when(F.coalesce(closed, F.lit(False)), "permanently_closed").when(F.lower(category).rlike("rivendit|dropship|intermediazion|grossist"), "pure_reseller").when(~known, "no_identity")


def page_gate(text: Column, url: Column, name: Column, city: Column, vat: Column, phone: Column) -> Column:
    """The first evidence that a page belongs to a firm: tiny rejects; tax code, phone, compact name, name and city accept."""
    figures, body = digits(text), strip_diacritics(F.lower(text))
    compact = F.regexp_replace(body, "[^a-z0-9]", "")
    whole = F.array_join(name_tokens(name), "")
    stem = F.regexp_replace(F.split_part(host(url), F.lit("."), F.lit(1)), "-", "")
    tail = F.substring(phone_key(phone), -7, 7)
    hits = F.size(F.filter(name_tokens(name), lambda t: F.contains(body, t)))
    return (
        F.when(F.length(text) < 50, "reject_tiny")
        .when((F.length(vat_digits(vat)) == 11) & F.contains(figures, vat_digits(vat)), "vat")
        .when((F.length(tail) == 7) & F.contains(figures, tail), "phone")
        .when((F.length(whole) >= 14) & (F.length(stem) >= 6) & F.contains(compact, whole) & (F.contains(whole, stem) | F.contains(stem, whole)), "semantic_a")
        .when((hits >= 2) & F.contains(key_text(text), key_text(city)), "anchor")
        .otherwise("reject_no_evidence")
    )


def search_relevant(results: DataFrame) -> DataFrame:
    """(query, relevant): whether any result of a query shows at least half of its words' beginnings."""
    words = F.array_distinct(F.transform(F.filter(F.split(key_text(F.col("query")), " "), lambda w: F.length(w) >= 3), lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2))))
    shown = strip_diacritics(F.lower(F.concat_ws(" ", "title", "snippet", "url")))
    hits = F.size(F.filter(words, lambda w: F.contains(shown, w)))
    return results.groupBy("query").agg(F.bool_or((F.size(words) == 0) | (hits >= F.ceil(F.size(words) / 2))).alias("relevant"))
