"""Benchmark decontamination with training suffix arrays.

The training documents of a task are put into shards of about `shard_words` words. Each shard gets a suffix array over
its word ids by prefix doubling, to the depth of a window. Every suffix of every benchmark item is searched: the
names that prefix doubling gives to runs of 2, 4, 8 words refuse most suffixes at once, the others are found by
binary search, which gives all places where the suffix's window stands verbatim. Where the word before differs, the
common prefix is followed to its end, which gives the longest verbatim matches with their locations.

Words that no item holds can't be in a match, so they have one id, 0, and no suffix.

The benchmark is never assumed to be small. It is cut into blocks of at most `block_bytes` of text by
item; each block is broadcast in turn and all documents pass it, carrying what earlier blocks hit.

Defined cases: a null text has no words; an item without words has no window; an item with a null id
still marks words as hit but is not listed; repeated items count once by id; repeated documents are each
judged; an empty benchmark leaves every document clean; extra columns are kept untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import alnum_words, map_rows, read_table

WINDOW = 13
#: Benchmark text that is broadcast at a time.
BLOCK_BYTES = 16 << 20
#: A shard is closed at so many words.
SHARD_WORDS = 1 << 20

FOUND = (
    "n_words bigint, n_hit bigint, hits array<struct<first:bigint,last:bigint>>, items array<string>, longest bigint, "
    "matches array<struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>>"
)


class TestSuffixes:
    """A block of items as word ids on end, each with a zero after it, and where the windows begin."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window, self.vocab, self.ids = window, {}, []
        parts, begin, at, sizes, lengths = [], [], 1, [], []
        for name, text in items:
            words = alnum_words(text)
            if words:
                parts.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] + [0], np.int64))
                begin.append(at)
                sizes.append(min(window, len(words)))
                lengths.append(len(words))
                at += len(words) + 1
                self.ids.append(name)
        self.words = np.concatenate([np.zeros(1, np.int64), *parts, np.zeros(2 * window, np.int64)])
        begin, sizes, lengths = (np.array(x, dtype=np.int64) for x in (begin, sizes, lengths))
        count = lengths - sizes + 1
        self.item = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # place in the item
        self.place, self.size = np.repeat(begin, count) + self.at, np.repeat(sizes, count)


class SuffixArray:
    """Suffixes of a shard that begin with a known word, in the order of their words to the depth of a window."""

    def __init__(self, words: np.ndarray, known: int, window: int):
        self.words = words  # ends with at least two windows of zeros
        at, name, base, h = np.flatnonzero(words), words, known + 1, 1
        #: Of each doubling: the length h of the halves, the number of their names, and the keys of the runs of 2 h words.
        self.levels: list[tuple[int, int, np.ndarray]] = []
        while h < window:
            keys, own = np.unique(name[at] * base + name[at + h], return_inverse=True)
            self.levels.append((h, base, keys))
            name = np.zeros_like(words)
            name[at] = own + 1
            base, h = len(keys) + 1, 2 * h
        self.places = at[np.argsort(name[at], kind="stable")]

    def alive(self, tests: TestSuffixes) -> np.ndarray:
        """Test windows whose leading runs of 2, 4, ... words all stand somewhere in the shard."""
        ok, name = np.ones(len(tests.place), bool), tests.words
        for h, base, keys in self.levels:
            at = np.flatnonzero(name)
            at = at[at + h < len(name)]
            key = name[at] * base + name[at + h]
            found = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            there = keys[found] == key if len(keys) else np.zeros(len(key), bool)
            name = np.zeros_like(name)
            name[at[there]] = found[there] + 1
            ok &= (name[tests.place] > 0) | (tests.size < 2 * h)
        return np.flatnonzero(ok)

    def bound(self, tests: TestSuffixes, which: np.ndarray, after: bool) -> np.ndarray:
        """The first place in the array whose suffix isn't less than the window, or is beyond all that begin with it."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.places))
        ahead = np.arange(tests.window)
        wanted = tests.words[tests.place[which, None] + ahead]
        inside = ahead < tests.size[which, None]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            apart = (self.words[self.places[middle, None] + ahead] - wanted[open_]) * inside[open_]
            differ = apart[np.arange(len(open_)), (apart != 0).argmax(axis=1)]
            less = differ <= 0 if after else differ < 0
            low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
        return low


def shard_matches(words: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the shard, test window, words) of each longest verbatim match that holds a window; words begins with a zero and ends with two windows of zeros."""
    array = SuffixArray(words, len(tests.vocab), tests.window)
    which = array.alive(tests)
    first = array.bound(tests, which, False)
    count = array.bound(tests, which, True) - first
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, which = array.places[np.repeat(first, count) + within], np.repeat(which, count)
    before = words[place - 1]
    opens = (before == 0) | (before != tests.words[tests.place[which] - 1])
    place, which = place[opens], which[opens]
    at, length = tests.place[which], tests.size[which].copy()
    going = np.arange(len(place))
    while going.size:
        a, b = words[place[going] + length[going]], tests.words[at[going] + length[going]]
        going = going[(a == b) & (a > 0)]
        length[going] += 1
    return place, which, length


def _judge(block: list[list[bytes]], old: list[list], tests: TestSuffixes) -> dict[str, list]:
    """Matches of a shard of documents, merged with the hits of earlier blocks."""
    lengths = np.array([len(w) for w in block], dtype=np.int64)
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))  # a zero before each document parts it from the others
    words = np.zeros(starts[-1] + 2 * tests.window + 1, np.int64)
    for k, w in enumerate(block):
        words[starts[k] : starts[k] + len(w)] = np.fromiter(map(tests.vocab.get, w, itertools.repeat(0)), np.int64, len(w))
    place, which, length = shard_matches(words, tests)
    doc = np.searchsorted(starts, place, "right") - 1
    order = np.lexsort((tests.at[which], place, tests.item[which], doc))
    doc, place, which, length = (x[order] for x in (doc, place, which, length))
    out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "hits", "items", "longest", "matches")}
    edge = np.searchsorted(doc, np.arange(len(block) + 1))
    for k, w in enumerate(block):
        found = [
            {"item_id": tests.ids[tests.item[which[m]]], "item_word": int(tests.at[which[m]]), "doc_word": int(place[m] - starts[k]), "n_words": int(length[m])}
            for m in range(edge[k], edge[k + 1])
        ]
        before = old[k] or {"hits": [], "items": [], "longest": 0, "matches": []}
        spans = sorted([(m["doc_word"], m["doc_word"] + m["n_words"] - 1) for m in found] + [(h["first"], h["last"]) for h in before["hits"]])
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out["n_words"].append(len(w))
        out["n_hit"].append(sum(b - a + 1 for a, b in merged))
        out["hits"].append([{"first": a, "last": b} for a, b in merged])
        out["items"].append(sorted({m["item_id"] for m in found if m["item_id"] is not None} | set(before["items"])))
        out["longest"].append(max([before["longest"], *(m["n_words"] for m in found)]))
        out["matches"].append(before["matches"] + found)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple[str | None, bytes | None]], bool]]:
    """(items, whether other blocks exist): the items, at most about block_bytes of text at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("binary").alias("_text")).filter("_text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(n)) == k)
        yield [(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()], n > 1


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of docs (or its columns carry) as struct _row, with its verbatim benchmark matches (see FOUND)."""
    spark = docs.sparkSession
    done = None
    for block, more in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def rows(slices: Iterator[dict[str, list]], sent=sent) -> Iterator[dict[str, list]]:
            tests = TestSuffixes(sent.value, window)
            words, old, cuts = [], [], [0]

            def judged() -> Iterator[dict[str, list]]:
                out = _judge(words, old, tests)
                for a, b in itertools.pairwise(cuts):  # what came in one slice goes out in one
                    yield {k: v[a:b] for k, v in out.items()}

            for part in slices:
                words += [alnum_words(t) for t in part["text"]]
                old += part.get("old") or [None] * len(part["text"])
                cuts.append(len(words))
                if sum(map(len, words)) >= shard_words:
                    yield from judged()
                    words, old, cuts = [], [], [0]
            if words:
                yield from judged()

        if done is None:
            done = map_rows(docs, {"text": F.col(text_col).cast("string")}, FOUND, rows, keep_row=True, carry=carry and ([*dict.fromkeys([*carry, text_col])] if more else carry))
        else:
            again = done.select("_row", F.struct("hits", "items", "longest", "matches").alias("old"))
            chained = map_rows(again, {"text": F.col(f"_row.`{text_col}`").cast("string"), "old": "old"}, FOUND, rows, keep_row=True)
            done = chained.select(F.col("_row._row").alias("_row"), *[c for c in chained.columns if c != "_row"])
    return done


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, columns unchanged."""
    return find_matches(docs, benchmark, **options).filter(f"NOT ({CONTAMINATED})").select("_row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )
