"""URL filter, prefix trie and collocations against brute force, and their edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import phrases, trie, urlfilter

# --- URL filter -------------------------------------------------------------------------------------------------


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net?/en/", "https://notexample.net/en/", "https://xnet/", "ftp://sub.example.com/de/1#a/b", "https://example.com/DE/1",
    "x://y://z/p", "https://a.org/fr/", "https://org/fr/q", "https://É.Org/fr/", "https://u:p@host.org:80/fr/x", "https://a.b/\nline?x", "https://casino-bets.example.com/en/1", "https://a.net#/", "://net/",
]


def wanted_rule(host: str, path: str, rules) -> str | None:
    fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits, key=lambda r: (-len(r), r)) if fits else None


@pytest.mark.parametrize("few", [0, 200])
def test_hosts_paths_and_rules(spark, few):
    rules = [*urlfilter.RULES, ("a.example.net", "/en/x", "block"), ("z", "/", "allow")]
    host, path = urlfilter.host_path(F.col("url"))
    df = spark.createDataFrame(list(enumerate(URLS)), "id int, url string").select("id", host.alias("host"), path.alias("path"))
    table = urlfilter.rule_table(spark, [*rules, (None, "/", "block"), ("y", None, "block"), ("q", "/", "maybe")])
    out = {r["id"]: (r["host"], r["path"], r["rule"]) for r in urlfilter.apply_rules(df, table, few).collect()}
    assert out == {k: (*parts(u), wanted_rule(*parts(u), rules)) for k, u in enumerate(URLS)}


def test_learnt_verdicts(spark):
    rows = urlfilter.labelled_urls(spark)
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    host, path = urlfilter.host_path(F.col("url"))
    held = rows.filter(fold == 0).select(host.alias("host"), path.alias("path"), "label")
    scored = urlfilter.score_urls(held, urlfilter.train(rows.filter(fold != 0))).toPandas()
    right = (scored["score"] >= 0.5) == (scored["label"] == "block")
    assert len(right) > 200 and right.mean() >= 0.9


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, None, "h"), (1, "https://x.net/", "h"), (None, "https://q.example/" + "a" * 200_000, "h")], "page_id long, url string, host string")
    none, rules = spark.createDataFrame([], "url string, label string"), urlfilter.rule_table(spark, urlfilter.RULES)
    out = urlfilter.judge(pages, none, rules)
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in out.collect()} == {(1, None, "allow"), (1, "net/", "block"), (None, None, "allow")} and out.count() == 3
    only = spark.createDataFrame([("https://a/", "block"), (None, "allow"), ("https://b/", "odd")], "url string, label string")
    assert {r["verdict"] for r in urlfilter.judge(pages, only, rules.limit(0)).collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), only, rules).count() == 0


# --- prefix trie ------------------------------------------------------------------------------------------------


def brute_trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1]) if key else 0
    sha = lambda key: hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
    return {(min(m), len(key), min(members[key[:-1]]) if key else None, len(m), kids[key], leaves[key], saved[key], sha(key)) for key, m in members.items()}


def conversations(seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for c in [*range(0, 40), *range(100, 240)]:
        kind = draw.random()
        size = 0 if kind < 0.05 else draw.choice([1, 2, 3, 5])
        same = draw.random() < 0.4
        for turn in range(size):
            text = "same ü" * (turn + 1) if same else draw.choice("abc")
            rows.append((c, turn, "user" if turn % 2 else "assistant", text))
    rows += [(7, None, None, None), (7, None, "x", "first"), (7, None, "x", "first"), (None, 1, "u", "lost"), (-250, 1, "u", "below"), (-200, 1, "u", "base"), (-200, 2, "u", "base"), (10**15, 1, "u", "big")]
    return rows


@pytest.mark.parametrize("local_ids", [6, 1 << 18])
def test_trie_equals_brute_force(spark, local_ids):
    rows = conversations(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, bucket string").repartition(7)
    out = trie.prefix_trie(df, local_ids).collect()
    assert len(out) == len({tuple(r) for r in out})
    assert {tuple(r) for r in out} == brute_trie(rows)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    one = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 6 >= 1 and c % 100)
    rows = [(one, 1, "u", "gone")]  # its only turn is replaced by a base that isn't there
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()} == brute_trie(rows) == {(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())}
    long = [(c, t, "u", "w" * (t % 7)) for c in (300, 400) for t in range(3000)]
    assert {tuple(r) for r in trie.prefix_trie(spark.createDataFrame(long, schema), 10).collect()} == brute_trie(long)


def test_trie_of_long_equal_conversations(spark):
    """What test_trie_edges asks of 3,000 turns, against the closed form: its brute force takes cubic time."""
    turns, none = 3000, hashlib.sha256(b"").hexdigest()
    rows = [(c, t, "u", "w" * (t % 7)) for c in (300, 400) for t in range(turns)]
    wanted, saved = {(300, turns, 300, 2, 0, 1, (turns - 1) % 7, hashlib.sha256(b"300,400").hexdigest())}, (turns - 1) % 7
    for d in range(turns - 1, -1, -1):
        saved += (d - 1) % 7 if d else 0
        wanted.add((300, d, 300 if d else None, 2, 1, 1, saved, none))
    out = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 10).collect()
    assert len(out) == turns + 1 and {tuple(r) for r in out} == wanted


def test_digests_stream_through_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = spark.range(100).select(F.lit(b"a").alias("class"), F.col("id").alias("conv_id")).unionByName(spark.range(1).select(F.lit(b"b").alias("class"), (F.col("id") - 5).alias("conv_id")))
    out = {bytes(r[0]): r[1] for r in trie.end_digests(rows.repartition(5)).collect()}
    assert out == {b"a": hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), b"b": hashlib.sha256(b"-5").hexdigest()}


# --- collocations -----------------------------------------------------------------------------------------------


def brute_phrases(docs: list[tuple], least: int) -> dict:
    counts, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\x0b\x0c\r":
            low = low.replace(mark, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    held = {(lang, p) for (lang, w), a in cands.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if (p := w[i:j]) != w and counts[lang, p] <= a}
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in held:
            score, cut = min((1000 * a * n[lang] // (counts[lang, w[:j]] * counts[lang, w[j:]]), j) for j in range(1, len(w)))
            out[lang, " ".join(w)] = (a, counts[lang, w[:cut]], counts[lang, w[cut:]], n[lang], score)
    return out


def texts(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    vocabulary = ["the", "Of", "of", "ü", "x\x00y", "w" * 300, "W" * 299 + "w", *"abcdef"]
    out = [(draw.choice(["en", "de", None]), "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", ", "]) for _ in range(draw.randrange(0, 60)))) for _ in range(300)]
    return [*out, ("en", None), ("en", ""), ("fr", " \t "), ("en", "new york city " * 40), ("en", "new york city " * 40)]


@pytest.mark.parametrize("slots", [150, 1 << 20])
def test_collocations_equal_brute_force(spark, slots):
    docs = texts(5)
    df = spark.createDataFrame([(*d, "x") for d in docs], "lang string, text string, id string").repartition(3)
    got = phrases.collocations(df, 12, 5, slots).collect()
    found = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got}
    assert len(found) == len(got) > 50 and found == brute_phrases(docs, 12)


def test_top_phrases_break_ties_by_bytes(spark):
    rows = [("en", p, a, 1, 1, 1, s) for p, a, s in [("é b", 5, 9), ("z b", 5, 9), ("a b", 4, 9), ("b b", 9, 8), ("c b", 9, 10)]]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    assert [(r["rank"], r["phrase"]) for r in phrases.top_phrases(df, 4).orderBy("rank").collect()] == [(1, "c b"), (2, "z b"), (3, "é b"), (4, "a b")]


def test_collocation_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty, 2).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string"), 2).count() == 0


def test_scores_beyond_64_bits():
    a, n, l, r = 10**9, 10**13, 2 * 10**9, 3 * 10**9
    assert 1000 * a * n // (l * r) == (1000 * 10**22) // (6 * 10**18)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << 20, (n, 5)).astype(np.uint64), axis=0)
    table = phrases.PerfectHash(keys)
    slots = table.find(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    others = draw.integers(1 << 21, 1 << 22, (100, 5)).astype(np.uint64)
    assert (table.find(others) == -1).all()


def test_word_ids_depend_on_word_and_language_only():
    coder = phrases.WordHash(4)
    seen: dict[tuple, int] = {}
    for lang in ("en", "de"):
        for text in (b"a bb a. ccc a", b"ccc  \t bb " + b"q" * 700, b"x " * 5 + b"a bb"):
            cut, data, starts, ends, _ = phrases.cut(text)
            for w, i in zip([cut[s:e] for s, e in zip(starts, ends, strict=True)], coder(cut, data, starts, ends, lang).tolist(), strict=True):
                assert seen.setdefault((lang, w), i) == i
    assert len(set(seen.values())) == len(seen)
