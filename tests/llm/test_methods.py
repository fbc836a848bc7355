"""The methods by themselves, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import decontam, licenses, lm, nndescent, packing, pii, secrets, simhash, spans, tokenfile, toxicity
from leadloom.llm.common import alnum_words, shared_path, space_words
from leadloom.llm.components import components
from leadloom.llm.encoder import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def coder():
    return Encoder(vocabulary_path())


PARTS = ["a", "b", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "1", " ", "ß", "!", "?", ".", "日", "\r\n", "<|endoftext|>", "The", " it's", "🙂", "\x00", "　", "a.b", "é,", "×", ",.", "ab%%"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_encoder_agrees_with_the_library(coder, parts):
    text = "".join(parts)
    assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    assert [w.decode() for w in alnum_words(text.encode("utf-8", "ignore"))] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode("utf-8", "ignore").decode())
    assert [w.decode() for w in space_words(text.encode("utf-8", "ignore"))] == re.findall(r"[^\x20\x09-\x0D]+", low.encode("utf-8", "ignore").decode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=60))
def test_packing_loses_nothing(sizes):
    bins = packing.pack(sizes)
    seen = defaultdict(list)
    for b in bins:
        used = sum(n for _, _, n in b)
        assert 0 < used <= 2048
        assert used & (used - 1) == 0 or 2048 - used < packing.LEAST_PIECE
        for d, a, n in b:
            seen[d].append((a, n))
    for d, size in enumerate(sizes):
        at = 0
        for a, n in sorted(seen[d]):
            assert a == at
            at += n
        assert at == size


def test_tree_takes_the_leftmost_bin():
    tree = packing.CapacityTree(5, 10)
    assert [tree.place(n) for n in (6, 5, 4, 5, 7, 3)] == [0, 1, 0, 1, 2, 2]


def test_index_is_minimal_and_perfect():
    for n in (1, 2, 3, 50, 3000):
        keys = [tokenfile.document_key(k) for k in range(n)]
        pilots, slots = tokenfile.build_index(keys)
        shard = {"pilots": pilots, "slots": slots, "offsets": np.arange(n + 1).astype("<u8").tobytes(), "payload": b"\0" * 2 * n, "width": 2}
        index = tokenfile.Index(shard)
        assert [index.place(k) for k in range(n)] == list(range(n))
        assert sum(index.place(k) is not None for k in range(n, n + 2000)) == 0


def test_lookup_by_key(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id bigint, text string").repartition(5)
    path = shared_path(spark, "ids")
    tokenfile.write_ids(docs, path, vocabulary_path())
    got = {r.doc_id: bytes(r.ids) for r in tokenfile.lookup(spark, path, [7, 49, 1000]).collect()}
    coder = Encoder(vocabulary_path())
    assert got == {k: coder.encode([f"text number {k}".encode()])[0] + b"\0\0\0\0" for k in (7, 49)}


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(8))]))
    child, parent = simhash.forest(np.zeros(len(fp), int), fp, 4, simhash.pivots())
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1:
            root[max(find(i), find(j))] = min(find(i), find(j))
    label = np.arange(len(fp))
    label[child] = parent
    assert [find(k) for k in range(len(fp))] == label.tolist()


def test_hot_buckets_are_dealt_without_loss(spark):
    rng = random.Random(5)
    values = list({sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(150)} | {(1 << 40) + k for k in range(60)})
    fps = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "fp bigint, doc_id bigint")
    got = {}
    for rows in (8192, 16):
        got[rows] = {r.fp: r.component_id for r in simhash.classes(fps, bucket_rows=rows).collect()}
    assert got[8192] == got[16] and len(got[16]) == len(values)


def test_deduplicate_finds_every_copy_above_the_similarity(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for wanted in (0.7, 0.76, 0.8, 0.82, 0.85, 0.9, 0.95):
        for _ in range(8):
            base = [word() for _ in range(204)]
            n = 200 - math.ceil(400 * wanted / (1 + wanted))  # shingles to lose at the end
            texts += [" ".join(base), " ".join(base[: len(base) - n] + [word() for _ in range(n)])]
    hub = [word() for _ in range(204)]
    texts += [" ".join(hub), *(" ".join(hub[:-12] + [word() for _ in range(12)]) for _ in range(30))]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for chunk in (256, 4):
        assert {r.doc_id for r in simhash.deduplicate(df, chunk=chunk).collect()} == set(root)


def test_pivot_tables_of_sets_lose_no_link():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.append(rng.choice(base[k % 6], 60 - k % 9, replace=False), rng.integers(0, 1 << 62, k % 5).astype(np.uint64))) for k in range(60)]
    sets += [np.zeros(0, np.uint64)] * 2 + [rng.integers(0, 1 << 62, 9).astype(np.uint64)]
    linked = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    left = simhash.within(np.repeat(np.arange(len(sets)), size), at, size, at.max() + 1, 0.2)
    assert not (linked & ~left).any() and left.sum() < left.size
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in np.flatnonzero(linked[j, :j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert simhash.similar(sets, 0.8).tolist() == root


def test_fingerprints_of_sets_propose_candidates(spark):
    hashes = np.array([3, 5, 1 << 63], np.uint64)
    assert simhash.majority(hashes) == 1 and simhash.majority(hashes[:0]) == 0 and simhash.majority(hashes[2:]) == -(1 << 63)
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 15), (4, (1 << 40) - 1)], "node bigint, fp bigint")
    assert {tuple(sorted(r)) for r in simhash._fingerprint_links(nodes).collect()} == {(1, 2), (1, 3)}


def test_components(spark):
    edges = [(a, a + 1) for a in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 150: 150, 200: 150}


def test_suffix_arrays_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 5, 9]))) for k in range(12)]
    docs = [(k, text(rng.randint(0, 60)) + (" " + items[k % 12][1] if k % 2 else "")) for k in range(40)]
    window = 4
    found = decontam.find_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=window)
    got = {r._row.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    for d, t in docs:
        w, hit, names = t.split(), set(), set()
        for i, s in items:
            own = s.split()
            n = min(window, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(str(i))
        assert got[d] == (len(w), len(hit), sorted(names))


def test_segments_are_maximal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.2, 1, 30)
        found = toxicity.segments(s)
        best = max((s[a : b + 1].sum() for a in range(30) for b in range(a, 30)), default=0)
        assert not found or abs(max(x[2] for x in found) - max(best, 0)) < 1e-9
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    plain, bad = [f"plain{k}" for k in range(300)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        w = [rng.choice(plain) for _ in range(40)]
        for _ in range(3 * toxic):
            w.insert(rng.randint(0, 40), rng.choice(bad) + rng.choice(["", "ness", "ly"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = toxicity.score_documents(docs, toxicity.train(docs, marks, toxicity.learns()))
    held = [(r._row.doc_id, r.predicted, r.score) for r in scored.collect()]
    assert sum(p == (d % 4 == 0) for d, p, _ in held) / len(held) > 0.97 and all(0 <= s <= 1 for _, _, s in held)
    assert toxicity.drop_toxic(docs, marks).count() == sum(p == 0 for _, p, _ in held)


def test_only_equal_labelled_texts_are_dropped(spark):
    shared = "constitutional responsibilities"
    rows = [(k, f"{shared} word{k} other{k % 7}", k % 2) for k in range(40)]  # alike in their long words only
    rows += [(100, "The same text, twice", 1), (101, "the same text twice", 1), (102, "the same text twice", 0), (103, None, 0), (104, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = Counter((r.text, r.mark) for r in toxicity._sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), 1000).collect())
    wanted = [(t, m) for k, t, m in rows if k not in (101,)]
    assert got == Counter(wanted)


def test_attention_gradients():
    counts = np.arange(40)[::-1] ** 2
    vocab = lm.Vocabulary(counts, np.arange(40) % 2 == 0, classes=16, own_slots=16)
    rng = np.random.default_rng(1)
    model = lm.Attention(vocab, rng.integers(0, 9, (vocab.slots, 16)).astype(float))
    model.weights = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in model.weights.items()}
    x, y = rng.integers(0, vocab.slots, (3, lm.WINDOW)), rng.integers(0, 16, (3, lm.STRIDE))
    live = rng.random((3, lm.STRIDE)) < 0.8
    _, g = model.gradients(x, y, live)
    for name in model.NAMES:
        w = model.weights[name]
        at, eps = tuple(rng.integers(0, n) for n in w.shape), 1e-3
        old = w[at]
        w[at] = old + eps
        up = model.gradients(x, y, live)[0]
        w[at] = old - eps
        down = model.gradients(x, y, live)[0]
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3, name


def test_probabilities_add_up_and_training_helps():
    counts = np.array([50, 30, 10, 5, 3, 2, 20, 15, 9, 40])
    vocab = lm.Vocabulary(counts, np.arange(10) % 2 == 0, classes=4, own_slots=4)
    model = lm.Attention(vocab)
    prefix = np.array([1, 5, 3])
    scores = [lm.sequence_scores([np.append(prefix, k)], vocab, model)[0] - lm.sequence_scores([prefix], vocab, model)[0] for k in range(10)]
    assert abs(sum(10.0**s for s in scores) - 1) < 1e-3
    text = [np.array([0, 1, 6, 7, 9] * 40)] * 8
    before = lm.sequence_scores(text, vocab, model).sum()
    model = lm.Attention(vocab, np.random.default_rng(2).integers(1, 3, (vocab.slots, 4)).astype(float))
    for _ in range(30):
        model.fit((x, y, live) for x, y, _, live in lm._examples(text, vocab, 16))
    assert lm.sequence_scores(text, vocab, model).sum() > before * 0.8
    assert np.allclose(lm.sequence_scores(text[:1], vocab, model)[0] * 8, lm.sequence_scores(text, vocab, model).sum())


def test_every_training_document_is_trained_on_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocab = lm.Vocabulary(np.arange(1, 41), np.arange(40) % 2 == 0)
    rows = [(k, rng.integers(0, 39, 50).astype("<u4").tobytes()) for k in range(90)]
    df = spark.createDataFrame(rows, "rid bigint, ids binary")
    monkeypatch.setattr(lm, "TRAINER_IDS", 1000)
    after = lm.class_counts(df, vocab)
    assert after.sum() == 90 * 50 and lm.id_counts(df, 40).sum() == 90 * 50
    one, other = (lm.train_attention(df.repartition(n), vocab, after, 90 * 50).vector() for n in (1, 5))
    assert np.allclose(one, other, atol=1e-4) and not np.allclose(one, lm.Attention(vocab, after).vector())


def test_log_class_equals_a_plain_softmax():
    rng = np.random.default_rng(3)
    vocab = lm.Vocabulary(rng.integers(0, 99, 60), np.arange(60) % 3 > 0, classes=16, own_slots=16)
    model, first = lm.Attention(vocab, rng.integers(0, 9, (vocab.slots, 16)).astype(float)), lm.WINDOW - lm.STRIDE
    model.weights["out"] = (0.3 * rng.standard_normal(model.weights["out"].shape)).astype(np.float32)
    x, y = rng.integers(0, vocab.slots, (5, lm.WINDOW)), rng.integers(0, 16, (5, lm.STRIDE))
    y[0] = 3  # groups without a row
    for large in (1, 6, 600):  # exponents far under the bound, and not
        w = {k: v.astype(np.float64) * (large if k == "query" else 1) for k, v in model.weights.items()}
        model.load(np.concatenate([w[k].ravel() for k in model.NAMES]))
        for rows, places in ((x, y), (x[:1], y[:1])):
            h = model.embed[rows] + w["place"]
            q, k, v = h @ w["query"], h @ w["key"], h @ w["value"]
            wanted = np.empty(places.shape)
            for i, t in np.ndindex(*places.shape):
                a = k[i, : first + t + 1] @ q[i, first + t] * lm.WIDTH**-0.5
                a = np.exp(a - a.max())
                z = (a / a.sum()) @ v[i, : first + t + 1] @ w["out"] + w["base"]
                z += np.concatenate([model.group_table[rows[i, first + t]], model.member_table[rows[i, first + t]]])
                group, member = divmod(int(places[i, t]), model.members)
                logs = lambda s: s - np.log(np.exp(s).sum())
                wanted[i, t] = logs(z[: model.groups])[group] + logs(z[model.groups :].reshape(-1, model.members)[group])[member]
            assert np.allclose(model.log_class(rows, places), wanted, atol=2e-3)


def test_few_short_texts_have_finite_scores(spark):
    df = spark.createDataFrame([(1, "a b, c"), (3, None), (5, "Ünï z ... don't $$$ " + "w" * 300), (6, " \t ")], "doc_id bigint, text string")
    assert all(np.isfinite(r.score) and r.score < 0 for r in lm.score_documents(df, F.lit(True), vocabulary_path()).collect())


def test_words_and_their_marks_have_the_ids_of_the_whole_word(monkeypatch):
    rng, plain = random.Random(5), Encoder(vocabulary_path())
    monkeypatch.setattr(lm, "CACHED_WORDS", 40)
    coder = lm.WordIds(vocabulary_path())
    stems = ["the", "é", "naïve", "a1", "don't", "7", "x" * 60, "über", "\u00a0", "-", "日本", "q"]
    words = [(rng.choice(stems) + "".join(rng.choices(".,!?$%&*)-'\"_`", k=rng.randrange(5)))).encode() for _ in range(3000)]
    for k in range(0, len(words), 100):
        assert coder.of(words[k : k + 100]) == [plain.encoded(b" " + w) for w in words[k : k + 100]]
    assert len(coder) <= 200 and coder.older


def test_frequent_words_are_one_id_and_others_are_spelled(spark):
    docs = [(k, "often often, seldom once%d" % k) for k in range(lm.LEAST_SEEN)] + [(50, None), (51, "often unseen$$$ often,")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    counts = lm.word_counts(df.filter("doc_id < 50"), "text")
    words = lm.frequent_words(counts.filter("token != 'seldom'").unionByName(spark.createDataFrame([("seldom", lm.LEAST_SEEN - 1)], counts.schema)), vocabulary_path(), lm.FREQUENT)
    assert words.n_words == 2 and words.end == words.n_subwords + 2
    plain = Encoder(vocabulary_path())
    own = {"often": [words.n_subwords], "often,": [words.n_subwords + 1]}
    got = {r._row.doc_id: r for r in lm.encode_documents(df, F.lit(True), words, vocabulary_path(), "text", ["doc_id"]).collect()}
    for k, text in docs:
        wanted = [i for w in (text or "").split() for i in own.get(w, np.frombuffer(plain.encoded(f" {w}".encode()), "<u4").tolist())]
        assert np.frombuffer(got[k].ids, "<u4").tolist() == [*wanted, words.end]
    assert (got[51].n_tokens, got[51].n_known) == (4, 3) and [tuple(r) for r in got[51].rare] == [("unseen$$$", 1)]
    assert (got[50].n_tokens, got[50].n_known, got[50].rare) == (1, 1, [])


def test_windows_score_each_token_once():
    ids, starts, lengths = lm.windows([np.arange(5), np.arange(100), np.arange(1)], -7)
    first = lm.WINDOW - lm.STRIDE
    scored = np.concatenate([ids[s + first + 1 : s + lm.WINDOW + 1] for s in starts])
    assert Counter(scored[scored >= 0].tolist()) == Counter([*range(5), *range(100), 0])
    assert lengths.tolist() == [5, 100, 1]


def test_licenses_against_brute_force():
    rng = random.Random(4)
    templates = {f"t{k}": " ".join(rng.sample([f"w{j}" for j in range(25)], rng.randint(1, 12))) for k in range(30)}
    index = licenses.TemplateIndex(templates, {f"w{j}".encode(): rng.randint(0, 9) for j in range(25)}, 0.8)
    for _ in range(400):
        block = {f"w{j}".encode() for j in rng.sample(range(30), rng.randint(0, 28))}
        wanted = [(t, n / len(w)) for t, s in sorted(templates.items()) for w in [{x.encode() for x in s.split()}] for n in [len(w & block)] if n / len(w) >= 0.8]
        assert index.matches(block) == wanted


def test_wrapped_notices_and_scattered_words(spark):
    grant = "x = 1\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal"
    scattered = " ".join(w + " filler" * 30 for w in "released under the mit license".split())
    df = spark.createDataFrame([(0, grant), (1, scattered), (2, "a\nreleased under\nthe MIT license\n" * 2)], "doc_id bigint, text string")
    got = {r._row.doc_id: [(b.label, b.line, b.containment) for b in r.blocks] for r in licenses.find_licenses(df).collect()}
    assert got == {0: [("notice:mit-grant", 1, 1.0)], 1: [], 2: [("notice:mit", 1, 1.0), ("notice:mit", 4, 1.0)]}


BASE = [
    ("email", pii.EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", None),
    ("ip", pii.IP, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", None),
    ("card", pii.CARD, r"[0-9]([\x20-]?[0-9])+", lambda m: sum(c.isdigit() for c in m) >= 13),
    ("phone", pii.PHONE, r"\+[0-9][\x20().0-9-]+[0-9]", None),
    ("access", secrets.ACCESS, r"AKIA[A-Z0-9]+", lambda m: len(m) >= 16),
    ("hex", secrets.HEX, r"[0-9a-f]+", lambda m: len(m) >= 32),
    ("assign", secrets.ASSIGN, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
]


def test_native_spans_against_the_plain_patterns(spark):
    rng = random.Random(9)
    pieces = ["a@b.c", "@", ".", "_", "x", "1", "22", "333", " ", "-", "+", "(", "é", "🙂", "AKIA", "ABCD1234", "0af9", "f" * 30, "token", "=", ":", '"', "passWD", "1.2.3.4", "4041 8949 7460 8795", "api_key", "b.co"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(600)] + ["1 " * 30_000, "a" * 100_000 + "@b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    made = df.select("k", *[spans.find(F.col("t"), p, name, F.lit(True)).alias(name) for name, p, _, _ in BASE]).collect()
    for r in made:
        for name, _, plain, keep in BASE:
            wanted = [(m.start(), m.end()) for m in re.finditer(plain, texts[r.k]) if keep is None or keep(m[0])]
            assert [(s.start, s.end) for s in r[name]] == wanted, (name, texts[r.k][:80])


def test_markov_models_find_random_strings(spark):
    rng = random.Random(3)
    words = ["configuration", "user", "account", "manager", "service", "handler", "request", "response", "database", "connection"]
    plain = ["_".join(rng.choice(words) for _ in range(3)) for _ in range(300)]
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    docs = [(k, f"see {plain[k]} and password={key()} here") for k in range(300)] + [(1000, f"lone {key()} string"), (1001, "only database_connection_handler_service here")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1000] == ["markov"] and got[1001] == [] and got[5] == ["assign"]


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(6)
    filler = [f"filler{chr(97 + k // 26)}{chr(97 + k % 26)}" .replace("0", "") for k in range(200)]
    rows = [(k, " ".join(rng.choice(filler) for _ in range(30))) for k in range(200)]
    rows += [(300 + k, f"{rng.choice(filler)} Zephyrine contact {' '.join(rng.choice(filler) for _ in range(40))} at zeph@mail.org {rng.choice(filler)}") for k in range(3)]
    rows += [(400 + k, f"contact somebody at {rng.choice(filler)}") for k in range(100)]
    rows += [(600 + k, "Copied Quixote has solo@mail.org") for k in range(5)]
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).select("_row.*", "spans")
    got = {r.text[s.start : s.end] for r in out.filter("doc_id between 300 and 399").collect() for s in r.spans if s.kind == "term"}
    assert "Zephyrine" in got and "contact" not in got
    assert not [s for r in out.filter("doc_id >= 600").collect() for s in r.spans if s.kind == "term"]  # copies are one text


def test_nn_descent_links(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((60, 24))
    rows = np.concatenate([centers + 0.05 * rng.standard_normal((60, 24)) for _ in range(4)] + [centers[:1] + 0.02 * rng.standard_normal((80, 24))])
    label = np.concatenate([np.arange(60) % 3] * 4 + [np.zeros(80, int)])
    df = spark.createDataFrame([(k, v.tolist(), int(x)) for k, (v, x) in enumerate(zip(rows, label, strict=True))], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in nndescent.near_duplicates(df, block=32).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    true = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    assert sum(got.values()) >= 0.97 * true.sum() and all(got[k] <= true[k] for k in got)


def test_links_between_saturated_groups(spark):
    rng = np.random.default_rng(4)
    one, other = np.eye(16)[0], math.cos(0.176) * np.eye(16)[0] + math.sin(0.176) * np.eye(16)[1]  # cosine 0.9845
    rows = np.concatenate([c + 0.001 * rng.standard_normal((12, 16)) for c in (one, other)])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
    for block in (512, 8):
        got = sorted(map(tuple, nndescent.near_duplicates(df, block=block).collect()))
        assert got == [(k, 23, 0, k == 0) for k in range(24)]


def test_base_scores_do_not_depend_on_the_broadcast_list(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(f"Wörd{int(rng.paretovariate(0.6)) % 50}" for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(60, None), (61, "never seen")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    tokens = lambda t: [*(w.lower() for w in (t or "").split()), ""]
    counts = Counter(w for k, t in docs if k < 40 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for frequent in (lm.FREQUENT, 5, 0):
        for r in lm.score_documents(df, F.col("doc_id") < 40, vocabulary_path(), frequent=frequent).collect():
            own = tokens(r._row.text)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
            assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
