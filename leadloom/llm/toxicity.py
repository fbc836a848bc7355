"""Toxic passages by maximum-scoring segment search over token log-odds.

A token's score is the largest lower confidence bound of the log-odds (toxic against clean documents, with
an informative Dirichlet prior) among the token and its prefixes, less a drift that makes the expected
score negative. A linear-time scan finds all maximal scoring segments of a document. The extreme-value law
of the largest segment gives each segment a p-value and each document a length-corrected score, which a
logistic curve turns into a probability.

The classifier is fitted on at most `train_rows` labelled documents, those with the smallest hashes of their
ids, of which equal texts (their words in order) with equal marks count once and no other row is dropped; labels of
such a bounded sample are broadcast, so only the sample's texts are shuffled. The curve and the extreme-value
law are fitted on scores from the half of the sample that the log-odds did not see.

Defined cases: a null or empty text scores as a document without a passage; labels with a null id or mark
are ignored; repeated labels each count; with labels of one kind only, all documents get the share of toxic ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import alnum_words, crc_mod, map_rows, materialize, read_table

TRAIN_ROWS, PREFIXES = 20_000, (4, 5, 6)
PRIOR, BOUND, DRIFT, ALPHA = 10.0, 2.5, 0.1, 0.3
#: A feature of fewer toxic documents has no positive bound; features that a task counts before it passes them on.
LEAST_TOXIC, COUNTED = 3, 400_000
#: Token scores are counted in bins of this width for the extreme-value law.
BIN, BINS, LOWEST = 0.05, 256, -2.0
CACHE_WORDS = 400_000
#: Stands among the features for the documents themselves.
DOCUMENTS = ""


def features(word: bytes) -> list[str]:
    """A word and its prefixes."""
    text = word.decode("utf-8", "replace")
    return [text, *(f"{text[:n]}*" for n in PREFIXES if len(text) >= n)]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Lower confidence bounds of features' log-odds, 0 where not positive."""
    share = (toxic + clean) / max(1, n_toxic + n_clean)
    prior = PRIOR * share + ALPHA
    a, b = toxic + prior, clean + prior
    whole_a, whole_b = n_toxic + PRIOR + 1, n_clean + PRIOR + 1
    delta = np.log(a / np.maximum(whole_a - a, ALPHA)) - np.log(b / np.maximum(whole_b - b, ALPHA))
    return np.maximum(0, delta - BOUND * np.sqrt(1 / a + 1 / b))


class TokenScores:
    """Token scores under a table of features' log-odds, with a bounded cache."""

    def __init__(self, table: dict[str, float]):
        self.table, self.cache = table, {}
        #: Every feature of a word begins with its first characters, so most words are settled by one look here.
        self.stems = {f[: PREFIXES[0]] for f in table}

    def score(self, word: bytes) -> float:
        if word.decode("utf-8", "replace")[: PREFIXES[0]] not in self.stems:
            return -DRIFT
        return max([self.table.get(f, 0.0) for f in features(word)]) - DRIFT

    def __call__(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.score(w)
        return np.fromiter(map(cache.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time."""
    high = np.flatnonzero(scores > 0).tolist()
    if not high:
        return []
    total = [0.0, *np.cumsum(scores).tolist()]
    # Of each segment: first, last + 1, sum before, sum after, and the nearest earlier segment with a smaller sum before;
    # following these links instead of stepping back makes the scan linear.
    found: list[tuple[int, int, float, float, int]] = []
    for at in high:
        first, end, low, top = at, at + 1, total[at], total[at + 1]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= top:
                found.append((first, end, low, top, k))
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
    return [(a, b - 1, float(d - c)) for a, b, c, d, _ in found]


class Law:
    """Largest segment score S of n background tokens: P(S >= s) = 1 - exp(-k n exp(-rate s)); then a logistic curve."""

    def __init__(self, rate: float, k: float, slope: float, base: float):
        self.rate, self.k, self.slope, self.base = rate, k, slope, base

    def reduced(self, score: float | np.ndarray, n: int | np.ndarray) -> float | np.ndarray:
        return self.rate * score - np.log(self.k * np.maximum(n, 1))

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-math.exp(min(50.0, -float(self.reduced(score, n)))))

    def probability(self, score: float, n: int) -> float:
        x = self.slope * float(np.clip(self.reduced(score, n), -60, 60)) + self.base
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, x))))


def fit_law(bins: np.ndarray, score: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> Law:
    """bins: token scores of clean documents; score, n, toxic: a document each."""
    at, share = LOWEST + BIN * (np.arange(len(bins)) + 0.5), bins / max(1, bins.sum())
    rate = 1.0
    if share[at > 0].sum() > 0 and (share * at).sum() < 0:
        low, high = 1e-3, 60.0
        for _ in range(80):
            rate = (low + high) / 2
            low, high = (low, rate) if (share * np.exp(np.minimum(rate * at, 700))).sum() > 1 else (rate, high)
        rate = max(rate, 0.05)
    clean = toxic == 0
    k = max(1e-12, clean.sum() / max(1e-12, (np.maximum(n, 1) * np.exp(-rate * score))[clean].sum()))
    law = Law(rate, k, 1.0, 0.0)
    x = np.clip(law.reduced(score, n), -60, 60)
    a, b = 0.0, math.log((toxic.sum() + 0.5) / (clean.sum() + 0.5))
    for _ in range(60):  # damped Newton steps with a light penalty, which keeps a separable sample finite
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - toxic) * x).sum() + 1e-2 * a, (p - toxic).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    law.slope, law.base = max(0.0, float(a)), float(b)
    return law


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, mark_col: str, learn: Column, train_rows: int) -> DataFrame:
    """(text, mark, half) of the labelled documents to learn from."""
    known = labels.select(F.col(id_col).cast("string").alias("k"), F.col(mark_col).cast("int").alias("mark"), learn.alias("learn"))
    known = known.filter("k is not null and mark in (0, 1) and learn").select("k", "mark", F.xxhash64("k").alias("h"))
    rows = known.orderBy("h", "mark").limit(train_rows).collect()
    chosen = docs.sparkSession.createDataFrame([(r.k, r.mark, int(r.h >> 7 & 1)) for r in rows], "k string, mark int, half int")
    texts = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "k")
    # Copies would count the same evidence again: of rows with the same words in the same order and the same mark, one stays.
    same = F.sha2(F.array_join(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), " "), 256)
    one = F.min_by(F.struct("text", "mark", "half"), "k")
    return materialize(sample.groupBy("mark", same.alias("same")).agg(one.alias("s")).select("s.*"), "labelled")


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", mark_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], Law]:
    """(features' log-odds, law) from a bounded sample of labelled documents."""
    spark = docs.sparkSession
    sample = _sample(docs, labels, id_col, text_col, mark_col, learn, train_rows)

    def count(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache: dict[bytes, list[str]] = {}
        total: list[Counter] = [Counter() for _ in range(4)]  # half, mark

        def out() -> dict[str, list]:
            rows = [(k, f, n) for k in range(4) for f, n in total[k].items()]
            for c in total:
                c.clear()
            return {"kind": [r[0] for r in rows], "feature": [r[1] for r in rows], "n": [r[2] for r in rows]}

        for part in slices:
            for text, mark, half in zip(part["text"], part["mark"], part["half"], strict=True):
                words = set(alnum_words(text))
                for w in words.difference(cache):
                    cache[w] = features(w)
                total[2 * half + mark].update({f for w in words for f in cache[w]})
                total[2 * half + mark][DOCUMENTS] += 1
                if len(cache) > CACHE_WORDS:
                    cache.clear()
            if sum(map(len, total)) > COUNTED:
                yield out()
        yield out()

    inputs = {c: F.col(c) for c in ("text", "mark", "half")}
    counted = map_rows(sample, inputs, "kind int, feature string, n bigint", count)
    columns = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4)]
    counted = counted.groupBy("feature").agg(*columns).filter(f"feature = '{DOCUMENTS}' or n1 + n3 >= {LEAST_TOXIC}").toPandas()
    docs_of = counted.loc[counted["feature"] == DOCUMENTS, [f"n{k}" for k in range(4)]].to_numpy(float).sum(axis=0)
    counted = counted[counted["feature"] != DOCUMENTS]
    feature, table = counted["feature"].tolist(), counted[[f"n{k}" for k in range(4)]].to_numpy(float).T

    def positive(toxic: list[int], clean: list[int]) -> dict[str, float]:
        odds = log_odds(table[toxic].sum(axis=0), table[clean].sum(axis=0), docs_of[toxic].sum(), docs_of[clean].sum())
        return {f: float(x) for f, x in zip(feature, odds.tolist(), strict=True) if x > 0}

    # The log-odds of half 0 score half 1, and the other way round.
    halves = [positive([2 * h + 1], [2 * h]) for h in (0, 1)]
    sent = spark.sparkContext.broadcast(halves)

    def score(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        scorers = [TokenScores(t) for t in sent.value]
        for part in slices:
            out: dict[str, list] = {"s": [], "n": [], "mark": [], "bins": []}
            bins = np.zeros(BINS, np.int64)
            for text, mark, half in zip(part["text"], part["mark"], part["half"], strict=True):
                tokens = scorers[1 - half](alnum_words(text))
                if not mark:
                    bins += np.bincount(np.clip(((tokens - LOWEST) / BIN).astype(int), 0, BINS - 1), minlength=BINS)
                for k, v in (("s", max((x[2] for x in segments(tokens)), default=0.0)), ("n", len(tokens)), ("mark", mark), ("bins", None)):
                    out[k].append(v)
            for k, v in (("s", 0.0), ("n", 0), ("mark", -1), ("bins", bins.tolist())):
                out[k].append(v)
            yield out

    scored = map_rows(sample, inputs, "s double, n bigint, mark int, bins array<bigint>", score).toPandas()
    own = scored[scored["mark"] >= 0]
    bins = sum((np.array(b, np.int64) for b in scored.loc[scored["mark"] < 0, "bins"]), np.zeros(BINS, np.int64))
    mark = own["mark"].to_numpy()
    if len(set(mark.tolist())) < 2:
        share = float(mark.mean()) if len(mark) else 0.0
        return {}, Law(1.0, 1.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    law = fit_law(bins, own["s"].to_numpy(), own["n"].to_numpy(), mark)
    return positive([1, 3], [0, 2]), law


SCORED = "score double, predicted int, passages array<struct<first_word:bigint,last_word:bigint,score:double,p_value:double>>"


def score_documents(docs: DataFrame, model: tuple[dict[str, float], Law], text_col: str = "text", significance: float = 0.05, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (or its columns carry) as _row, with its score, decision and significant passages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(slices: Iterable[dict[str, list]]) -> Iterator[dict[str, list]]:
        table, law = sent.value
        scorer = TokenScores(table)
        for part in slices:
            out: dict[str, list] = {"score": [], "predicted": [], "passages": []}
            for text in part["text"]:
                tokens = scorer(alnum_words(text))
                found = segments(tokens)
                p = law.probability(max((x[2] for x in found), default=0.0), len(tokens))
                kept = [(a, b, s, v) for a, b, s in found if (v := law.p_value(s, len(tokens))) <= significance]
                out["score"].append(p)
                out["predicted"].append(int(p >= 0.5))
                out["passages"].append([dict(first_word=a, last_word=b, score=s, p_value=v) for a, b, s, v in kept])
            yield out

    return map_rows(docs, {"text": F.col(text_col).cast("string")}, SCORED, rows, keep_row=True, carry=carry)


def learns(id_col: str = "doc_id") -> Column:
    """Rows to learn from: those whose crc32(id as text) mod 5 is not 0."""
    return crc_mod(id_col, 5) != 0


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that are predicted toxic, columns unchanged."""
    model = train(docs, labels, learns(), **options)
    return score_documents(docs, model).filter("predicted = 0").select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_documents(docs, train(docs, labels, learns()), carry=["doc_id"])
    doc_id = F.col("_row.doc_id")
    held = F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))
    return scored.select(doc_id.alias("doc_id"), held.alias("held_out"), "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"))
