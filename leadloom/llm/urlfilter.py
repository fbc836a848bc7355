"""URL filters: host and path rules, and for what no rule fits a logistic regression on hashed character n-grams.

The regression is trained by Spark's own optimiser from a labelled URL table (url, label: block or allow), of
which at most TRAIN_ROWS different URLs are taken (those with the least hash, so the choice is repeatable). Features
are the presence of n-grams of the host (3 to 5 characters, with marks at both ends) and of the path (3 and 4),
each kind under its own names, hashed into FEATURES slots. Everything is columns and Spark's transformers; a URL
is split into characters once, so a long URL costs its length.

Rules (host, path, verdict) fit their host and its subdomains where the URL's path starts with theirs; the one whose
host and path are longest together wins, of equally long ones the first by text. Up to FEW_RULES are one constant
array in the plan; more are joined on the suffixes of distinct (host, path) pairs, dealt over SALTS copies of the
rules, so that neither a common suffix nor a common URL is one key.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the
model's intercept; rows are kept one for one, repeated ids too; an empty labelled table, or one with one label only,
gives that label (allow, where there is none) to all; rules or labelled rows that hold nulls are passed over.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import materialize, read_table

FEATURES, TRAIN_ROWS, FEW_RULES, SALTS = 1 << 16, 20_000, 200, 16
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Words of hosts and paths that the small labelled table is built from.
UNWANTED = "casino poker slots bets betting jackpot lottery viagra pills porn xxx escort adult nude loans payday warez crack keygen spam followers bonus win prize replica gamble dating clickbait ads banner tracker".split()
WANTED = "news library garden school museum travel recipe weather city health science music history market forum journal archive photo sport craft kitchen studio clinic church river bridge village energy".split()
_AFTER = "farm win free club best online zone hub cheap track shop top".split()
_PLACES = "center group daily online house local point market club shop world guide".split()
_TONGUES = "en de fr es".split()
#: Syllables of names that are no words.
_SYLLABLES = "the re on in tion er ha th an ing ed or ly es st ba mo ri lu ka ne vo du ge fi".split()


def host_path(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for a null or a URL without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label) that is used where none is given: word pairs in hosts, words in paths, made-up names."""
    rows = []
    for label, words, others in (("block", UNWANTED, _AFTER), ("allow", WANTED, _PLACES)):
        for i, word in enumerate(words):
            for j, other in enumerate(others):
                host = [f"{word}-{other}.example.com", f"{other}-{word}.example.org", f"www.{word}{other}.example.net", f"blog.{other}{word}.example.com"][(i + j) % 4]
                plain = f"/{_TONGUES[(i + j) % 4]}/{i * 331 + j * 7}{['', '/', '.html'][j % 3]}"
                path = plain if (i + j) % 3 else [f"/{word}/{other}.html", f"/{_TONGUES[i % 4]}/{words[(i + 3) % len(words)]}/{j}/", ""][j % 3]
                rows.append((f"http{'s' if j % 2 else ''}://{host}{path}", label))
    for i in range(900):  # ordinary names that are no words
        name = "".join(_SYLLABLES[(i * k + k * k + i // 25) % len(_SYLLABLES)] for k in range(1, 3 + i % 3))
        rows.append((f"http{'s' if i % 2 else ''}://{['', 'www.', 'blog.', 'm.'][i % 4]}{name}.example.{['com', 'net', 'org'][i % 3]}/{_TONGUES[i // 3 % 4]}/{i * 37}{['', '/', '.html'][i // 5 % 3]}", "allow"))
    return spark.createDataFrame(rows, "url string, label string")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _with_grams(df: DataFrame) -> DataFrame:
    """df (with host and path) and the hashed n-grams of both as the vector features."""
    chars = lambda c: F.filter(F.split(F.concat(F.lit("^"), c, F.lit("$")), ""), lambda x: x != "")
    df, kinds = df.withColumns({"_h": chars(F.col("host")), "_p": chars(F.col("path"))}), []
    for kind, sizes in (("_h", HOST_GRAMS), ("_p", PATH_GRAMS)):
        for n in sizes:
            df = NGram(n=n, inputCol=kind, outputCol=f"{kind}{n}").transform(df)
            kinds.append(F.transform(f"{kind}{n}", lambda x, kind=kind: F.concat(F.lit(kind), x)))
    df = df.withColumn("_grams", F.concat(*kinds))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features").transform(df)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS):
    """A fitted model, or the one label there is."""
    host, path = host_path(F.col("url"))
    some = labelled.select("url", "label").filter("url is not null and label in ('block', 'allow')").distinct()
    some = some.orderBy(F.xxhash64("url"), "url", "label").limit(rows).select(host.alias("host"), path.alias("path"), (F.col("label") == "block").cast("double").alias("label"))
    some = materialize(some.coalesce(1), "labelled-urls")
    sizes = dict(map(tuple, some.groupBy("label").count().collect()))
    if len(sizes) < 2:
        return "block" if 1.0 in sizes else "allow"
    weight = F.when(F.col("label") == 1.0, sizes[0.0] / sizes[1.0]).otherwise(1.0)  # both labels weigh the same
    learner = LogisticRegression(maxIter=40, regParam=0.0003, standardization=False, weightCol="weight")
    return learner.fit(_with_grams(some).select("features", "label", weight.alias("weight")))


def score_urls(urls: DataFrame, model) -> DataFrame:
    """urls (with host and path) and score, the model's probability of block."""
    if isinstance(model, str):
        return urls.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    out = model.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("").transform(_with_grams(urls))
    return out.select(*urls.columns, F.get(vector_to_array("_probability"), F.lit(1)).alias("score"))


def apply_rules(urls: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """urls (with host and path) and the winning rule's text and verdict as rule and rule_verdict, null where none fits."""
    sound = rules.select(F.translate("host", *_LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    sound = sound.filter("r_host is not null and r_path is not null and r_verdict in ('block', 'allow')")
    text = F.concat("r_host", "r_path")
    sound = sound.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).withColumns({"r_text": text, "r_size": -F.length(text)})
    table = sound.orderBy("r_size", "r_text", "r_path").limit(few + 1).collect()
    if len(table) <= few:
        if not table:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
        array = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("r_host", "r_path", "r_verdict", "r_text")]) for r in table])
        dotted = F.concat(F.lit("."), F.col("host"))
        fits = F.filter(array, lambda r: F.endswith(dotted, F.concat(F.lit("."), r["r_host"])) & F.startswith(F.col("path"), r["r_path"]))
        first = F.get(fits, F.lit(0))
        return urls.withColumns({"rule": first["r_text"], "rule_verdict": first["r_verdict"]})
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    distinct = urls.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = distinct.select("host", "path", "salt", F.explode(suffixes).alias("r_host")).join(sound.withColumn("salt", copies), ["r_host", "salt"])
    won = met.filter(F.startswith("path", F.col("r_path"))).groupBy("host", "path").agg(F.min(F.struct("r_size", "r_text", "r_path", "r_verdict")).alias("r"))
    won = won.select("host", "path", F.col("r.r_text").alias("rule"), F.col("r.r_verdict").alias("rule_verdict"), copies.alias("salt"))
    spread = urls.withColumn("salt", (F.rand(7) * SALTS).cast("int"))
    return spread.join(won, ["host", "path", "salt"], "left").select(*urls.columns, "rule", "rule_verdict")


def judge(pages: DataFrame, labelled: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    host, path = host_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    scored = score_urls(apply_rules(urls, rules), train(labelled))
    learnt = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", learnt).alias("verdict"), "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), labelled_urls(spark), rule_table(spark, RULES))
