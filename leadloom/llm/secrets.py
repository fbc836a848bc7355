"""Secrets by patterns and by character Markov models, with DataFrame expressions only.

Two first-order character models are trained: random strings (the values that the base patterns find) and
ordinary identifiers (long tokens outside them that hold no digit, as
unlabelled keys among them would teach the wrong model). A long token whose log-likelihood ratio exceeds `least_llr`
is a secret. The counts cover the whole corpus; the model is a table of 128 x 128 ratios whatever the
corpus, so it travels as a literal. The text is scanned once; what the scan keeps is written to the shared
folder for training and scoring.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; without samples of both
kinds the models agree and add nothing; a document id of null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import spans
from leadloom.llm.common import materialize, read_table

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ASSIGN_GUARD = r"(?i)(?:passwo?r?d|secret|token|api_?key)[\"' :=]"
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"[0-9a-f]{32,}+"
#: Tokens that the models judge.
LONG = r"[A-Za-z0-9+/_=-]{16,}+"
KINDS = ["assign", "access", "hex", "markov"]
#: Log-likelihood ratio (natural) from which a token is a secret; about ten thousand to one.
LEAST_LLR = 9.2
SMOOTHING, SYMBOLS, BACKOFF = 0.5, 64, 4.0


def base_spans(text: Column) -> Column:
    assign = spans.find(text, ASSIGN, "assign", text.rlike(ASSIGN_GUARD), group=1)
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 8)
    access = spans.find(text, ACCESS, "access", text.contains("AKIA"))
    # Runs of 32 and more: a longer run of the class can't begin inside a shorter one.
    return F.concat(assign, access, spans.find(text, HEX, "hex", text.rlike(r"[0-9a-f]{32}")))


def _transitions(strings: DataFrame) -> DataFrame:
    """(random, pair, n): counts of neighbouring characters; pair = 128 * first + second."""
    places = F.sequence(F.lit(1), F.length("value") - 1)
    code = lambda at: F.ascii(F.substring("value", at, F.lit(1)))
    pairs = F.transform(places, lambda i: code(i) * 128 + code(i + 1))
    return strings.filter("length(value) > 1").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def ratios(strings: DataFrame) -> Column:
    """array<double> of 16384 log-likelihood ratios, as a literal, from (random boolean, value) samples."""
    spark = strings.sparkSession
    counts = materialize(_transitions(strings), "transitions")
    first, second = F.floor(F.col("pair") / 128), F.col("pair") % 128

    def sums(by: list, names: tuple[str, str]) -> DataFrame:
        n = [F.coalesce(F.sum(F.when(F.col("random") == r, F.col("n"))), F.lit(0)).alias(c) for r, c in zip((True, False), names, strict=True)]
        return counts.groupBy(*by).agg(*n)

    total = dict(zip("ro", sums([], ("r", "o")).first(), strict=True))
    table = spark.range(128 * 128).withColumnRenamed("id", "pair").withColumn("first", first).withColumn("second", second)
    table = table.join(sums(["pair"], ("r", "o")), "pair", "left").join(sums([first.alias("first")], ("row_r", "row_o")), "first", "left")
    table = table.join(sums([second.alias("second")], ("one_r", "one_o")), "second", "left")

    def chance(kind: str) -> Column:
        """Of a character after another: its count, backed off to the smoothed share of the character."""
        n = lambda c: F.coalesce(F.col(f"{c}_{kind}" if c else kind), F.lit(0))
        share = (n("one") + SMOOTHING) / (total[kind] + SMOOTHING * SYMBOLS)
        return (n("") + BACKOFF * share) / (n("row") + BACKOFF)

    llr = F.log(chance("r")) - F.log(chance("o"))
    both = counts.agg(F.count_distinct("random") == 2).first()[0]
    row = table.agg(F.sort_array(F.collect_list(F.struct("pair", F.round(llr, 6).alias("llr")))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["llr"].cast("string")), ",")).first()
    return F.split(F.lit(row[0] if both else ",".join(["0"] * 16384)), ",").cast("array<double>")


def llr(value: Column, table: Column) -> Column:
    code = lambda at: F.ascii(F.substring(value, at, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, code(i) * 128 + code(i + 1) + 1))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_llr: float = LEAST_LLR) -> DataFrame:
    """(id_col, base array<SPAN>, spans array<SPAN>), one row per row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scanned = docs.select(F.col(id_col), base_spans(text).alias("base"), spans.find(text, LONG, "markov", text.rlike(LONG)).alias("long"))
    # Tokens that touch a base span are that span's; the rest are the ordinary samples and the candidates.
    scanned = materialize(scanned.withColumn("long", F.filter("long", lambda s: spans.apart(s, F.col("base")))), "scanned")
    sample = lambda column, random: scanned.select(F.explode(column).alias("s")).select(F.lit(random).alias("random"), F.col("s.value").alias("value"))
    table = ratios(sample("base", True).unionAll(sample("long", False).filter(~F.col("value").rlike("[0-9]"))))
    added = F.filter("long", lambda s: llr(s["value"], table) >= least_llr)
    return scanned.select(id_col, "base", F.concat("base", added).alias("spans"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans.joined(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
        spans.joined(F.col("spans"), KINDS, False).alias("spans"),
    )
