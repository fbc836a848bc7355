"""Numbers in Italian and English spelling, and rounding halves up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(value: Column, places: int = 0) -> Column:
    """Halves towards plus infinity."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(part: Column, whole: Column) -> Column:
    """Per cent with one decimal; 0 of nothing."""
    return F.when(whole > 0, round_up(100.0 * part / whole, 1)).otherwise(0.0)


def parse_number(text: Column) -> Column:
    """The first number of a text: grouped thousands in either spelling, else the comma as decimal sign."""
    token = F.regexp_replace(F.regexp_extract(text, r"(-?(?:[0-9][0-9.,]*|[.,][0-9]+))", 1), "[.,]$", "")
    italian, english = r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$", r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
    plain = (
        F.when(token.rlike(italian), F.regexp_replace(F.regexp_replace(token, r"\.", ""), ",", "."))
        .when(token.rlike(english), F.regexp_replace(token, ",", ""))
        .otherwise(F.concat(F.substring_index(token, ",", 1), F.when(token.contains(","), F.concat(F.lit("."), F.substring(token, F.instr(token, ",") + 1, F.length(token)))).otherwise("")))
    )
    return plain.try_cast("double")


def parse_revenue(text: Column) -> Column:
    """Euros of an amount with an optional magnitude word; null where there is no number."""
    clean = F.trim(F.regexp_replace(text, "(?i)€|eur", ""))
    number = F.regexp_replace(F.regexp_extract(clean, r"^([0-9.,\s]+?)\s*[a-zà-ùA-ZÀ-Ù]*\s*$", 1), r"\s", "")
    word = F.lower(F.regexp_extract(clean, r"([a-zà-ùA-ZÀ-Ù]+)\s*$", 1))
    last = F.regexp_extract(number, r"([.,])[0-9]*$", 1)
    fraction = F.length(F.regexp_extract(number, r"[.,]([0-9]*)$", 1))
    both = number.contains(".") & number.contains(",")
    decimal = (last != "") & (both | fraction.between(1, 2))
    whole = F.regexp_replace(F.regexp_replace(number, r"[.,][0-9]*$", ""), "[.,]", "")
    base = F.when(decimal, F.concat(whole, F.lit("."), F.regexp_extract(number, r"[.,]([0-9]*)$", 1))).otherwise(F.regexp_replace(number, "[.,]", ""))
    factor = F.when(word.rlike("^(mld|miliard)"), 1e9).when(word.rlike("^(mln|milion|mio|m)$|^milion"), 1e6).when(word.rlike("^(mila|k)$"), 1e3).otherwise(1.0)
    return F.floor(base.try_cast("double") * factor + 0.5).cast("bigint")


def revenue_year(text: Column) -> Column:
    """The year beside a financial word, else the latest plausible one."""
    keyed = F.regexp_extract(text, r"(?i)(?:fatturato|bilancio|ricavi|esercizio|anno)\s*\(?\s*([0-9]{4})", 1).try_cast("int")
    every = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.when(keyed.between(1990, 2099), keyed), F.array_max(F.filter(every, lambda y: y.between(1990, 2099))))


def employee_range(text: Column) -> Column:
    """'from-to', 'from+' or '0-to' of a worded range."""
    low = F.lower(text)
    pair = F.regexp_extract(low, r"(?:da\s+)?([0-9]+)\s*(?:a|-|–)\s*[0-9]+", 1)
    to = F.regexp_extract(low, r"[0-9]+\s*(?:a|-|–)\s*([0-9]+)", 1)
    over = F.regexp_extract(low, r"(?:oltre|più di)\s+([0-9]+)", 1)
    below = F.regexp_extract(low, r"(?:fino a|meno di)\s+([0-9]+)", 1)
    return F.when(pair != "", F.concat(pair, F.lit("-"), to)).when(over != "", F.concat(over, F.lit("+"))).when(below != "", F.concat(F.lit("0-"), below))
