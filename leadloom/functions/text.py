"""Text normalization."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters whose canonical decomposition is an ASCII letter and marks, by rule.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].isascii()]
_FROM, _TO = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)

#: Spaced-out legal forms and their canonical token, longest first.
LEGAL_FORMS = [("s r l s", "srls"), ("s a p a", "sapa"), ("s r l", "srl"), ("s p a", "spa"), ("s n c", "snc"), ("s a s", "sas")]


def strip_diacritics(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(text, _FROM, _TO)


def bind(value: Column, use) -> Column:
    """use(value) with the value's expression written once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def has(value: Column) -> Column:
    """Whether a text holds more than white space."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def filled(value: Column) -> Column:
    """Null for an empty text."""
    return F.when(value != "", value)


def key_text(text: Column) -> Column:
    """Lower case, no diacritics, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(strip_diacritics(F.lower(text)), "[^a-z0-9]+", " "))


def company_key_text(name: Column) -> Column:
    """key_text with legal forms joined, so that spellings of a form agree and different forms differ."""
    out = key_text(name)
    for spaced, form in LEGAL_FORMS:
        out = F.regexp_replace(out, rf"\b{spaced}\b", form)
    return F.trim(F.regexp_replace(out, " +", " "))


def slug(text: Column, separator: str = "_", size: int = 40) -> Column:
    joined = F.regexp_replace(strip_diacritics(F.lower(text)), "[^a-z0-9]+", separator)
    return F.substring(F.regexp_replace(joined, f"^{separator}+|{separator}+$", ""), 1, size)


def has_mojibake(text: Column) -> Column:
    """UTF-8 read as Latin-1, or replacement characters."""
    return F.coalesce(text.rlike("[ÃÂ][\u0080-¿]|â€|�"), F.lit(False))


def drop_replacements(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "�+", " "), " +", " "))


def plain_email_signs(text: Column) -> Column:
    """[at] and (dot) in any bracket as @ and a full stop."""
    out = F.regexp_replace(text, r"(?i)\s*[\[({]\s*(?:at|chiocciola)\s*[\])}]\s*", "@")
    return F.regexp_replace(out, r"(?i)\s*[\[({]\s*(?:dot|punto)\s*[\])}]\s*", ".")


def decode_hex_email(code: Column) -> Column:
    """Bytes in hex, each XORed with the first."""
    byte = lambda at: F.conv(F.substring(code, at, F.lit(2)), 16, 10).cast("int")
    first = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.length(code) - 1, F.lit(2))
    letters = F.transform(places, lambda at: F.char(byte(at).bitwiseXOR(first)))
    return F.when(code.rlike("^[0-9a-fA-F]{4,}$") & (F.length(code) % 2 == 0), F.array_join(letters, ""))


def incident_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 24)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the code points' low bytes, as an unsigned 32-bit number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda acc, c: acc.bitwiseXOR(c) * F.lit(16777619).cast("bigint") % F.lit(4294967296).cast("bigint")
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(key_text(text), " "), lambda t: F.length(t) >= least)


def loose_json(text: Column) -> Column:
    """The JSON of a fenced block or of the outermost braces, as a variant; null if neither parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.when(fenced != "", fenced)), F.try_parse_json(F.when(braces != "", braces)))
