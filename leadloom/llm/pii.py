"""Personal data: patterns, and information-theoretic sanitisation of what reveals them; DataFrame expressions only.

Protected entities are the values of the base patterns. Terms are the words of a document that holds an entity, outside
its entities. Row counts of entities, terms and both together over the whole corpus give the pointwise mutual
information PMI(entity; term), which never exceeds the entity's information content IC(entity). A term whose PMI is a
share of at least `disclosure` of IC reveals the entity too well: wherever it stands in a document that holds the
entity, it is generalised (to its initial), or removed from a share of `removal` on. A pair must be seen in at least
`support` different texts, since one text, however often copied, says nothing about co-occurrence.

Only texts with an entity of at least `support` texts have candidate terms; a candidate pair takes a row for each such
text that holds it, and pairs are summed before they meet the document counts of terms. An entity that stands in
more than one in `HOT` of all entity places is looked up in a broadcast list (of fewer than HOT entries), so no key is hot.

Defined cases: a null or empty text has no spans; equal texts get equal spans; a null id stays null; an empty
corpus gives an empty result; extra columns are kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import spans
from leadloom.llm.common import materialize, read_table

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
#: Of 13 digits and more: a chain of digits is one match wherever it begins, and shorter ones fail.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}"
WORD = r"(?<=[^\p{L}\p{N}])\p{L}{4,}+(?=[^\p{L}\p{N}])"
KINDS = ["email", "ip", "card", "phone", "term"]
DISCLOSURE, REMOVAL, SUPPORT = 0.67, 0.9, 2
#: An entity of more than one in so many places is hot; parts into which rows of a text are dealt when they are joined.
HOT, SALTS = 1000, 16


def base_spans(text: Column) -> Column:
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    size = lambda s: F.length(digits(s))
    email = spans.find(text, EMAIL, "email", text.contains("@"))
    ip = F.filter(spans.find(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]+\.[0-9]")), lambda s: s["value"].rlike(OCTETS))
    card = spans.find(text, CARD, "card", text.rlike(r"[0-9](?:[ -]?[0-9]){12}"))
    card = F.filter(card, lambda s: size(s).between(13, 19) & F.call_function("luhn_check", digits(s)))
    phone = F.filter(spans.find(text, PHONE, "phone", text.contains("+")), lambda s: size(s).between(9, 15))
    return F.concat(email, ip, card, phone)


def _entities(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))


def _words(text: Column) -> Column:
    """array<SPAN> of the words of a text."""
    found = spans.find(F.concat(F.lit(" "), text, F.lit(" ")), WORD, "term", F.lit(True))  # a word at an edge has a neighbour, too
    return F.transform(found, lambda w: F.struct(F.lit("term").alias("kind"), (w["start"] - 1).alias("start"), (w["end"] - 1).alias("end"), F.lower(w["value"]).alias("value")))


def _scan(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """(_row, k1, k2, salt, found, base, text) of each row; k1 and k2 stand for the text, which is kept where it holds a base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), text.alias("_text"))
    rows = rows.select("_row", "_text", base_spans(F.col("_text")).alias("base"))
    second = F.shiftleft(F.hash("_text").cast("bigint"), 32).bitwiseOR(F.length("_text"))
    return materialize(rows.select(
        "_row", F.xxhash64("_text").alias("k1"), second.alias("k2"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
        (F.size("base") > 0).alias("found"), "base", F.when(F.size("base") > 0, F.col("_text")).alias("text"),
    ), "entities")


def _held(texts: DataFrame, support: int) -> DataFrame:
    """(k1, k2, copies, entity, dfc): the entities of each text that at least `support` texts hold; dfc counts rows."""
    each = texts.select("k1", "k2", "copies", F.explode(_entities(F.col("base"))).alias("entity"))
    counts = each.groupBy("entity").agg(F.sum("copies").alias("dfc"), F.count("*").alias("texts")).filter(F.col("texts") >= support)
    counts = materialize(counts, "entity-counts")
    places = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    hot = F.col("texts") * HOT > F.lit(places)
    some = F.broadcast(counts.filter(hot).select("entity", "dfc"))  # fewer than HOT entities
    cold = each.join(some.select("entity"), "entity", "left_anti").join(counts.filter(~hot).select("entity", "dfc"), "entity")
    return materialize(each.join(some, "entity").unionByName(cold), "held")


def _candidates(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(k1, k2, copies, entity, dfc, term): the terms of each text beside each of its entities."""
    own = texts.join(held.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    words = F.filter(_words(F.col("text")), lambda w: spans.apart(w, F.col("base")))
    terms = own.select("k1", "k2", F.explode(F.array_distinct(F.transform(words, lambda w: w["value"]))).alias("term"))
    return held.join(terms, ["k1", "k2"])


def revealing(docs: DataFrame, texts: DataFrame, held: DataFrame, rows: int, text_col: str, disclosure: float, removal: float, support: int) -> DataFrame:
    """(entity, term, removed): pairs whose share of the entity's information exceeds a threshold."""
    pairs = _candidates(texts, held).groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"), F.first("dfc").alias("dfc"))
    content = F.log2(F.lit(float(max(rows, 1))) / F.col("dfc"))
    share = lambda df: F.when(content > 0, F.log2(F.lit(float(max(rows, 1))) * F.col("both") / (F.col("dfc") * df)) / content).otherwise(0.0)
    # No term stands in fewer rows than the pair, which already rules out most pairs.
    pairs = materialize(pairs.filter((F.col("texts") >= support) & (share(F.col("both")) >= disclosure)).drop("texts"), "pairs")
    text = F.concat(F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(" "))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= support)
    known = pairs.join(counts, "term")
    exact = share(F.greatest("df", "both"))
    return materialize(known.filter(exact >= disclosure).select("entity", "term", (exact >= removal).alias("removed")), "revealing")


def _term_spans(texts: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k1, k2, terms array<SPAN>) of the texts in which a revealing term stands; value is 'removed' or 'generalised'."""
    named = held.join(pairs.select("entity").distinct(), "entity", "left_semi")
    hit = _candidates(texts, named).join(pairs, ["entity", "term"]).groupBy("k1", "k2", "term").agg(F.max("removed").alias("removed"))
    own = texts.join(hit.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    words = own.select("k1", "k2", F.explode(F.filter(_words(F.col("text")), lambda w: spans.apart(w, F.col("base")))).alias("w"))
    each = words.select("k1", "k2", F.col("w.value").alias("term"), "w.start", "w.end").join(hit, ["k1", "k2", "term"])
    span = F.struct(F.lit("term").alias("kind"), "start", "end", F.when(F.col("removed"), "removed").otherwise("generalised").alias("value"))
    return each.groupBy("k1", "k2").agg(F.collect_list(span).alias("terms"))


def find_personal_data(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, disclosure: float = DISCLOSURE, removal: float = REMOVAL, support: int = SUPPORT
) -> DataFrame:
    """Each row of docs (or its columns carry) as struct _row, with base and spans, both array<SPAN>."""
    scanned = _scan(docs, text_col, carry or docs.columns)
    rows = scanned.count()
    texts = scanned.filter("found").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first(F.struct("base", "text")).alias("one"))
    texts = materialize(texts.select("k1", "k2", "copies", "one.*"), "entity-texts")
    held = _held(texts, support)
    terms = _term_spans(texts, held, revealing(docs, texts, held, rows, text_col, disclosure, removal, support))
    terms = materialize(terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "terms")
    own = scanned.filter("found").join(terms, ["k1", "k2", "salt"], "left")
    own = own.select("_row", "base", F.concat("base", F.coalesce("terms", spans.no_spans())).alias("spans"))
    return scanned.filter("not found").select("_row", "base", F.col("base").alias("spans")).unionByName(own)


def sanitise(docs: DataFrame, text_col: str = "text", size_col: str | None = None, **options) -> DataFrame:
    """docs with personal data in the text column replaced; all rows and other columns stay, but size_col gets a changed text's length."""
    found = find_personal_data(docs, text_col, **options)
    text, changed = F.col(f"_row.`{text_col}`").cast("string"), F.size("spans") > 0

    def mask(s: Column) -> Column:
        generalised = F.concat(F.substring(text, s["start"] + 1, F.lit(1)), F.lit("."))
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "removed", "[TERM]").otherwise(generalised)

    clean = found.withColumn("_text", F.when(changed, spans.replaced(text, F.col("spans"), mask)).otherwise(text)).withColumn("_changed", changed)
    own = {text_col: F.col("_text")}
    if size_col in docs.columns:
        own[size_col] = F.when(F.col("_changed"), F.length("_text").cast("bigint")).otherwise(F.col(f"_row.`{size_col}`"))
    return clean.select(*[(own[c] if c in own else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(spans.joined(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), KINDS, True).alias("spans"),
    )
