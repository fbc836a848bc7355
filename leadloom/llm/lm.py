"""Language-model scoring: a word base model, and a causal self-attention model over words and subwords.

Texts are words, lower-cased, joined by a space and ended by an end mark. The base model is an add-one
unigram over words. Its counts are an aggregate over the whole training part; the most frequent words (a
list of stated length) are broadcast and scored where the text is, and only the other words of each document
are joined with the counts, so neither frequent words nor a growing vocabulary are sent to every task.

The attention model's ids are the frequent words seen at least `LEAST_SEEN` times in training, one id each, the
subwords that spell all others, and the end mark. It predicts a group of classes, a class of the group (ids of like frequency, apart for ids that
open a word), and the id within its class by the smoothed counts of the whole training part, so probabilities of
all ids add up to one. Three things come from counts over all training documents: the classes, the logits of a
class after the last id, and the embeddings (the leading singular vectors of these logits). The attention
weights on top are trained in numpy, on every training document once: documents are dealt by row to trainers of
about `TRAINER_IDS` ids and to rounds; the trainers of a round start from the same weights, and their
weights are averaged after it, so the number of executors changes nothing. Scoring slides a window over each
document by `stride` positions; a window's first positions are context, and each token is scored just once.

Defined cases: a null or empty text is the end mark alone; a row where learn is null is neither learned from nor
held out; repeated rows are learned and scored each; with nothing to learn from, all ids are equally likely.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import crc_mod, map_rows, materialize, read_table, space_words, vector_sum, whole_groups
from leadloom.llm.encoder import encoder, vocabulary_path

FREQUENT, COUNTED, CACHED_WORDS = 300_000, 300_000, 500_000
#: Longer words aren't held. What a word may end in without changing the ids of the letters before.
CACHED_BYTES, MARKS = 48, b"!#$%&()*+,./:;<=>?@[\\]^{|}~-"
#: Words seen as often in training are one id of the model each, if they are among the frequent ones; others are spelled in subwords.
LEAST_SEEN = 4
#: Levels for each doubling of a count, by which the frequent words are chosen.
COUNT_LEVELS = 16
WINDOW, STRIDE, WIDTH, CLASSES, GROUPS, OWN_SLOTS = 32, 24, 16, 128, 8, 512
#: Each document is in one round; ids of a trainer in all rounds; windows of a step of training and of scoring.
ROUNDS, TRAINER_IDS, BATCH, RATE, WINDOWS_AT_ONCE = 3, 4_000_000, 96, 0.01, 96
#: Where exponents may lie further than this from zero, they are taken relative to their largest, so that sums of them are neither infinite nor zero.
LARGEST = np.float32(60)
#: Stands for the end mark among the words.
END = ""


class WordIds(dict):
    """Little-endian 32-bit subword ids of a space and a word, with a bounded cache of two generations for each worker."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.encoder = encoder(vocabulary)
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if stem and len(stem) < len(word) and stem.decode().isalpha():  # letters and marks after them are two pre-tokens
            return self[stem] + self._mark_ids(word[len(stem) :])
        ids = self.older.get(word)
        if ids is None:
            ids = self.encoder.encoded(b" " + word)
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids

    def _mark_ids(self, marks: bytes) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.encoder.encoded(marks)
            if len(marks) <= CACHED_BYTES and len(self.marks) < CACHED_WORDS // 8:
                self.marks[marks] = ids
        return ids

    def of(self, words: Iterable[bytes]) -> list[bytes]:
        if len(self) > CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        return [*map(self.__getitem__, words)]


@functools.cache
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, n) over all rows of docs; the empty token is the end mark."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        total: Counter = Counter()
        ends = 0

        def out(more: list[tuple[str, int]]) -> dict[str, list]:
            pairs = [(w.decode(), n) for w, n in total.items()] + more
            total.clear()
            return {"token": [p[0] for p in pairs], "n": [p[1] for p in pairs]}

        for part in slices:
            for text in part["text"]:
                total.update(space_words(text))
            ends += len(part["text"])
            if len(total) > COUNTED:
                yield out([])
        yield out([(END, ends)])

    counted = map_rows(docs, {"text": F.col(text_col).cast("string")}, "token string, n bigint", rows)
    return counted.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")


class Vocabulary:
    """Classes, input slots and probabilities within a class, from the counts of ids; the last id is the end mark."""

    def __init__(self, counts: np.ndarray, opens: np.ndarray, classes: int = CLASSES, own_slots: int = OWN_SLOTS):
        n = len(counts)
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.cls = np.zeros(n, np.int32)
        opening = float(share[opens].sum())
        n_opening = classes * bool(opens.any()) if opens.all() or not opens.any() else min(max(round(classes * opening), 1), classes - 1)
        for kind, begin, many in ((False, 0, classes - n_opening), (True, classes - n_opening, n_opening)):  # classes of like mass in the order of frequency, apart for ids that open a word
            ids = np.flatnonzero(opens == kind)
            ids = ids[np.argsort(-counts[ids], kind="stable")]
            mass = np.cumsum(share[ids])
            if len(ids):
                self.cls[ids] = begin + np.minimum((many * (mass - share[ids]) / mass[-1]).astype(np.int64), many - 1)
        class_mass = np.bincount(self.cls, share, classes)
        self.class_share = class_mass
        self.log_within = np.log(share / class_mass[self.cls]).astype(np.float32)
        self.slot = own_slots + self.cls
        top = np.argsort(-counts, kind="stable")[:own_slots]
        self.slot[top] = np.arange(len(top), dtype=np.int32)
        self.begin, self.slots, self.classes = own_slots + classes, own_slots + classes + 1, classes
        self.groups = math.gcd(GROUPS, classes)
        self.members = classes // self.groups
        # Begin and padding marks follow the ids.
        self.slot_of, self.class_of = np.append(self.slot, [self.begin, self.begin]).astype(np.int32), np.append(self.cls, [0, 0]).astype(np.int32)


def windows(sequences: list[np.ndarray], begin: int, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths): all sequences on end, each after begin marks; a window at starts[i] scores the stride ids that follow its context."""
    parts, starts, at = [], [], 0
    for s in sequences:
        tail = -len(s) % stride
        parts += [np.full(window - stride + 1, begin), s, np.full(tail, begin + 1)]
        starts.append(at + np.arange(0, len(s), stride))
        at += window - stride + 1 + len(s) + tail
    return np.concatenate(parts), np.concatenate(starts), np.array([len(s) for s in sequences])


class Attention:
    """One causal self-attention layer over fixed embeddings, added to fixed logits of a class after an id."""

    NAMES = ("place", "query", "key", "value", "out", "base")

    def __init__(self, vocab: Vocabulary, after: np.ndarray | None = None, seed: int = 0):
        rng, c = np.random.default_rng(seed), vocab.classes
        shapes = {"place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH)}
        self.weights = {k: (0.2 * rng.standard_normal(v)).astype(np.float32) for k, v in shapes.items()}
        self.weights |= {"out": np.zeros((WIDTH, vocab.groups + c), np.float32), "base": np.zeros(vocab.groups + c, np.float32)}
        after = np.zeros((vocab.slots, c)) if after is None else after
        share = np.maximum(vocab.class_share, 1e-12)
        seen = after.sum(axis=1, keepdims=True)
        chance = (after + 4 * share) / (seen + 4)
        lift = np.log(chance) - np.log(share)
        self.groups, self.members = vocab.groups, vocab.members
        in_group = chance.reshape(len(chance), self.groups, -1).sum(axis=2)
        self.group_table, self.member_table = np.log(in_group).astype(np.float32), np.log(chance).astype(np.float32)
        weight = np.sqrt(seen / max(1.0, seen.sum()))
        left = np.linalg.svd(weight * lift, full_matrices=False)[2][:WIDTH]
        embed = np.zeros((vocab.slots, WIDTH))
        embed[:, : len(left)] = lift @ left.T
        self.embed = (embed / np.maximum(1e-6, np.sqrt((embed**2).mean()))).astype(np.float32)
        self.mask = np.tri(WINDOW, dtype=np.float32)[WINDOW - STRIDE :]

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in self.NAMES])

    def load(self, vector: np.ndarray) -> Attention:
        at = 0
        for k in self.NAMES:
            w = self.weights[k]
            self.weights[k] = np.asarray(vector[at : at + w.size], np.float32).reshape(w.shape)
            at += w.size
        return self

    def _tables(self) -> tuple:
        """What a batch takes rows from, for the weights at hand: queries, keys and values of slots and of places, logits of groups and of their members, and whether exponents stay under LARGEST."""
        w, g, first, scale = self.weights, self.groups, WINDOW - STRIDE, np.float32(WIDTH**-0.5)
        q, pq = (self.embed @ w["query"]) * scale, (w["place"][first:] @ w["query"]) * scale
        kv = np.concatenate([w["key"], w["value"]], axis=1)
        kv, pkv = self.embed @ kv, w["place"] @ kv
        norm = lambda t: math.sqrt(float(np.einsum("ij,ij->i", t, t).max()))
        k, v = (norm(kv[:, at]) + norm(pkv[:, at]) for at in (slice(WIDTH), slice(WIDTH, None)))
        low = max((norm(q) + norm(pq)) * k, v * norm(w["out"].T) + float(w["base"].max())) < LARGEST
        outs = np.ascontiguousarray(w["out"][:, g:].reshape(WIDTH, g, self.members).transpose(1, 0, 2))
        return q, pq, kv, pkv, self.group_table + w["base"][:g], (self.member_table + w["base"][g:]).reshape(-1, self.members), outs, low

    def _forward(self, x: np.ndarray, y: np.ndarray, tables: tuple | None = None) -> tuple:
        """(queries, keys and values, exponents of the attention, their sums, its result, order by group, first of each group, result in that order, members' weights, and in that order of the groups and of the group's members the exponents, their sums, the logarithm and the place of y) of the windows x."""
        tq, pq, tkv, pkv, group_table, member_table, outs, low = tables or self._tables()
        first, g = WINDOW - STRIDE, self.groups
        own = x[:, first:].ravel()
        # np.take copies short rows several times faster than indexing.
        q = np.take(tq, own, axis=0).reshape(len(x), STRIDE, WIDTH)
        q += pq
        kv = np.take(tkv, x.ravel(), axis=0).reshape(len(x), WINDOW, 2 * WIDTH)
        kv += pkv
        a = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        if not low:
            a += (self.mask - 1) * np.float32(1e9)
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= self.mask
        # Products with ones sum short rows faster than sum().
        whole = a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), np.float32)
        o = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
        o /= whole
        # By group, each row meets the weights of its group's members only.
        group, member = np.divmod(y.ravel(), self.members)
        order = np.argsort(group.astype(np.uint8 if g < 256 else np.int64), kind="stable")
        group, member, own, so = group[order], member[order], own[order], np.take(o, order, axis=0)
        starts = np.searchsorted(group, np.arange(g + 1))
        zg = so @ self.weights["out"][:, :g]
        zg += np.take(group_table, own, axis=0)
        zm = np.take(member_table, own * g + group, axis=0)
        for k, (lo, hi) in enumerate(itertools.pairwise(starts.tolist())):
            zm[lo:hi] += so[lo:hi] @ outs[k]
        parts, rows = [], np.arange(len(so))
        for z, n in ((zg, group), (zm, member)):
            if not low:
                z -= z.max(axis=1, keepdims=True)
            picked = z[rows, n]
            np.exp(z, out=z)
            total = z @ np.ones((z.shape[1], 1), np.float32)
            parts.append((z, total, picked - np.log(total.ravel()), n))
        return q, kv, a, whole, o, order, starts, so, outs, parts

    def log_class(self, x: np.ndarray, y: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Log-probabilities of the classes y that follow the last stride positions of the windows x."""
        *_, order, _, _, _, parts = self._forward(x, y, tables)
        out = np.empty(len(order), parts[0][2].dtype)
        out[order] = parts[0][2] + parts[1][2]
        return out.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(loss, gradients) over the positions after a window's context that live marks, so each token counts once."""
        w, scale, first, g = self.weights, np.float32(WIDTH**-0.5), WINDOW - STRIDE, self.groups
        q, kv, a, whole, o, order, starts, so, outs, parts = self._forward(x, y)
        live = live.ravel()[order].astype(np.float32)
        rows, n = np.arange(len(o)), np.float32(max(1, int(live.sum())))
        loss = -float((parts[0][2] + parts[1][2]) @ live) / float(n)
        live /= n
        for z, total, _, at in parts:
            z *= live[:, None] / total
            z[rows, at] -= live
        dg, dm = parts[0][0], parts[1][0]
        dout, dbase, one = np.empty(w["out"].shape, o.dtype), np.empty(len(w["base"]), o.dtype), np.ones(len(o), np.float32)
        dout[:, :g], dbase[:g], dso = so.T @ dg, one @ dg, dg @ w["out"][:, :g].T
        for k, (lo, hi) in enumerate(itertools.pairwise(starts.tolist())):
            at = slice(g + k * self.members, g + (k + 1) * self.members)
            dout[:, at], dbase[at] = so[lo:hi].T @ dm[lo:hi], one[lo:hi] @ dm[lo:hi]
            dso[lo:hi] += dm[lo:hi] @ outs[k].T
        do = np.empty_like(dso)
        do[order] = dso
        do /= whole
        da = do.reshape(q.shape) @ kv[:, :, WIDTH:].transpose(0, 2, 1)
        da -= np.einsum("ij,ij->i", do, o).reshape(len(x), STRIDE, 1)
        da *= a
        dq = da @ kv[:, :, :WIDTH]
        dq *= scale  # q is scaled already
        dkv = np.concatenate([da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do.reshape(q.shape)], axis=2)
        h = np.take(self.embed, x.ravel(), axis=0).reshape(len(x), WINDOW, WIDTH) + w["place"]
        dw = h.reshape(-1, WIDTH).T @ dkv.reshape(-1, 2 * WIDTH)
        by_place = dkv.sum(0)
        place = by_place[:, :WIDTH] @ w["key"].T + by_place[:, WIDTH:] @ w["value"].T
        place[first:] += dq.sum(0) @ w["query"].T
        query = h[:, first:].reshape(-1, WIDTH).T @ dq.reshape(-1, WIDTH)
        return loss, {"query": query, "key": dw[:, :WIDTH], "value": dw[:, WIDTH:], "out": dout, "base": dbase, "place": place}

    def fit(self, batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE) -> list[float]:
        """Adam over batches of windows; gives the losses."""
        at, losses = self.vector(), []
        m, v = np.zeros_like(at), np.zeros_like(at)
        for step, (x, y, live) in enumerate(batches, 1):
            loss, g = self.gradients(x, y, live)
            losses.append(loss)
            d = np.concatenate([g[k].ravel() for k in self.NAMES])
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            at -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
            self.load(at)
        return losses


def _examples(sequences: list[np.ndarray], vocab: Vocabulary, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(input slots, next classes, next ids, live) of at most so many windows at a time, next ones of the last stride positions."""
    begin, first = len(vocab.cls), WINDOW - STRIDE
    ids, starts, _ = windows(sequences, begin)
    slot, cls, live = np.take(vocab.slot_of, ids), np.take(vocab.class_of, ids), ids < begin
    for at in range(0, len(starts), most):
        x = starts[at : at + most, None] + np.arange(WINDOW)
        y = x[:, first:] + 1
        yield np.take(slot, x), np.take(cls, y), np.take(ids, y), np.take(live, y)


def _vectors(encoded: DataFrame, add: Callable[[list[np.ndarray], np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows' id sequences of what add puts into a vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                add([np.frombuffer(b, "<u4").astype(np.int32) for b in batch.column(0).slice(at, 256).to_pylist()], total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    return vector_sum(encoded.select("ids").mapInArrow(run, "v binary"), size)


def id_counts(encoded: DataFrame, ids: int) -> np.ndarray:
    """Occurrences of each subword id, the end mark last."""

    def add(sequences: list[np.ndarray], total: np.ndarray) -> None:
        if sequences:
            total += np.bincount(np.concatenate(sequences), minlength=ids)

    return _vectors(encoded, add, ids)


def class_counts(encoded: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """How often each class follows each slot."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocab)

    def add(sequences: list[np.ndarray], total: np.ndarray) -> None:
        vocab = sent.value
        if sequences:
            ids = np.concatenate([p for s in sequences for p in ([len(vocab.cls)], s)])
            cell = np.take(vocab.slot_of, ids[:-1]).astype(np.int64) * vocab.classes + np.take(vocab.class_of, ids[1:])
            total += np.bincount(cell[ids[1:] < len(vocab.cls)], minlength=len(total))

    return _vectors(encoded, add, vocab.slots * vocab.classes).reshape(vocab.slots, vocab.classes)


def train_attention(encoded: DataFrame, vocab: Vocabulary, after: np.ndarray, n_ids: int, rounds: int = ROUNDS) -> Attention:
    """Weights trained on each row of encoded (rid, ids) once: in each round on its rows, averaged over its trainers."""
    spark, model = encoded.sparkSession, Attention(vocab, after)
    trainers = max(1, -(-int(n_ids) // TRAINER_IDS))
    at = F.xxhash64("rid")
    dealt = encoded.select("rid", "ids", F.pmod(at, F.lit(trainers)).alias("trainer"), F.pmod(F.shiftright(at, 32), F.lit(rounds)).alias("round"))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((vocab, after, model.vector()))

        def learn(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocab, after, vector = sent.value
            for rows, starts in whole_groups(batches, ["trainer"]):
                for lo, hi in itertools.pairwise(starts.tolist()):
                    own = Attention(vocab, after).load(vector)
                    column = rows.column("ids")

                    def some(lo=lo, hi=hi, column=column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                        for k in range(lo, hi, 64):
                            sequences = [np.frombuffer(b, "<u4").astype(np.int32) for b in column.slice(k, min(64, hi - k)).to_pylist()]
                            yield from ((x, y, live) for x, y, _, live in _examples(sequences, vocab, BATCH))

                    steps = float(len(own.fit(some())))
                    yield pa.RecordBatch.from_arrays([pa.array([np.append(own.vector() * steps, steps).astype(np.float64).tobytes()])], ["v"])

        rows = dealt.filter(F.col("round") == turn).drop("round").repartition("trainer").sortWithinPartitions("trainer", "rid")
        total = vector_sum(rows.mapInArrow(learn, "v binary"), len(model.vector()) + 1)
        if total[-1]:
            model.load(total[:-1] / total[-1])
    return model


def sequence_scores(sequences: list[np.ndarray], vocab: Vocabulary, model: Attention) -> np.ndarray:
    """log10 probability of each id sequence."""
    out, tables = [], model._tables()
    for x, y, ids, live in _examples(sequences, vocab, WINDOWS_AT_ONCE):
        scores = model.log_class(x, y, tables) + np.take(vocab.log_within, np.where(live, ids, 0))
        out.append(np.where(live, scores, 0).sum(axis=1, dtype=np.float64))
    of = np.repeat(np.arange(len(sequences)), [-(-len(s) // STRIDE) for s in sequences])
    return np.bincount(of, np.concatenate(out), len(sequences)) / math.log(10)


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` tokens, none rarer than those left out, and the end mark: counts by levels of their logarithm give the least level that fits."""
    level = F.floor(COUNT_LEVELS * F.log2("n"))
    least, reached = None, 0
    for of, tokens in sorted(counts.groupBy(level.alias("level")).agg(F.count("*")).collect(), reverse=True):  # at most 63 * COUNT_LEVELS rows
        reached += tokens
        if reached > most:
            break
        least = of
    end = F.col("token") == END
    return counts.filter(end if least is None else end | (level >= F.lit(least)))


ENCODED = "n_tokens bigint, n_known bigint, logs double, rare array<struct<token:string,n:bigint>>, ids binary"


class Words(dict):
    """Places of the frequent words (and of the end mark) in the tables of what they add to the base score and of their ids in the model."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, subwords: list[bytes], n_subwords: int):
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        super().__init__((tokens[k], at) for at, k in enumerate(order))
        counts, spelled = np.asarray(counts, np.int64)[order], [np.frombuffer(subwords[k], "<u4") for k in order]
        end = END.encode()
        self.end_known = end in self
        own = counts >= LEAST_SEEN
        if self.end_known:
            own[self[end]] = False
        self.n_subwords, self.n_words = n_subwords, int(own.sum())
        self.end = n_subwords + self.n_words
        ids = n_subwords + np.cumsum(own) - 1
        parts = [np.array([i]) if o else sub for i, o, sub in zip(ids.tolist(), own.tolist(), spelled, strict=True)]
        self.logs = np.log10(counts + 1.0)
        if not self.end_known:
            self[end] = len(parts)
            parts.append(np.zeros(0))
            self.logs = np.append(self.logs, 0.0)
        parts[self[end]] = np.array([self.end])
        self.length = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.ids = np.concatenate(parts).astype(np.uint32)


def frequent_words(counts: DataFrame, vocabulary: str, most: int) -> Words:
    """The most frequent words, each encoded once, in a task."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        coder = word_ids(vocabulary)
        for part in slices:
            yield {"token": [t.decode() for t in part["token"]], "n": part["n"], "ids": [coder.of([t])[0] if t else b"" for t in part["token"]]}

    found = map_rows(_most_frequent(counts, most), {"token": "token", "n": "n"}, "token string, n bigint, ids binary", rows).toArrow()
    tokens = found.column("token").cast(pa.binary()).to_pylist()
    return Words(tokens, found.column("n").to_numpy(), found.column("ids").to_pylist(), encoder(vocabulary).tokenizer.get_vocab_size())


def encode_documents(docs: DataFrame, learn: Column, words: Words, vocabulary: str, text_col: str, carry: list[str]) -> DataFrame:
    """(_row, rid, learn, and ENCODED) of each row: its ids, and what its frequent words add to the base score."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        words, coder, end, unknown = sent.value, word_ids(vocabulary), END.encode(), itertools.repeat(-1)
        for part in slices:
            tokens, ends = [], [0]
            for text in part["text"]:
                tokens += space_words(text)
                tokens.append(end)
                ends.append(len(tokens))
            at = np.fromiter(map(words.get, tokens, unknown), np.int64, len(tokens))
            rare = np.flatnonzero(at < 0)
            names = [tokens[k] for k in rare.tolist()]
            spelled = coder.of(names)
            logs, length, start = np.take(words.logs, at), np.take(words.length, at), np.take(words.start, at)
            logs[rare] = 0.0
            length[rare] = own = np.array([len(b) // 4 for b in spelled], np.int64)
            start[rare] = len(words.ids) + np.cumsum(own) - own
            upto = np.cumsum(length)
            source = np.repeat(start - upto + length, length)
            source += np.arange(len(source))
            ids = np.take(np.concatenate([words.ids, np.frombuffer(b"".join(spelled), "<u4")]), source).astype("<u4")
            bounds = np.array(ends)
            n_rare, n_tokens = np.searchsorted(rare, bounds), np.diff(bounds)
            cuts = np.append(0, upto[bounds[1:] - 1]).tolist()
            yield {
                "n_tokens": n_tokens.tolist(),
                "n_known": (n_tokens - np.diff(n_rare) - (not words.end_known)).tolist(),
                "logs": np.add.reduceat(logs, bounds[:-1]).tolist(),
                "rare": [[*Counter(names[lo:hi]).items()] for lo, hi in itertools.pairwise(n_rare.tolist())],
                "ids": [ids[lo:hi].tobytes() for lo, hi in itertools.pairwise(cuts)],
            }

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept"), learn.alias("learn"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
    found = map_rows(kept, {"text": "text"}, ENCODED, rows, keep_row=True, carry=["kept", "rid", "learn"])
    return materialize(found.select(F.col("_row.kept").alias("_row"), "_row.rid", "_row.learn", *[c for c in found.columns if c != "_row"]), "encoded")


def score_documents(docs: DataFrame, learn: Column, vocabulary: str, text_col: str = "text", carry: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Each row of docs (or its columns carry) as _row, with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs.filter(learn), text_col), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = frequent_words(counts, vocabulary, frequent)
    encoded = encode_documents(docs, learn, words, vocabulary, text_col, carry or docs.columns)
    coder = encoder(vocabulary)
    names = coder.tokenizer.get_vocab()
    size = words.end + 1
    learned = encoded.filter("learn").select("rid", "ids")
    ids = id_counts(learned, size)
    opens = np.zeros(size, bool)
    opens[[k for t, k in names.items() if t[:1] == coder.letters[32]]] = True
    opens[words.n_subwords :] = True
    vocab = Vocabulary(ids, opens)
    after = class_counts(learned, vocab)
    model = train_attention(learned, vocab, after, int(ids.sum()))
    sent = spark.sparkContext.broadcast((vocab, after, model.vector()))

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        vocab, after, vector = sent.value
        model = Attention(vocab, after).load(vector)
        for part in slices:
            yield {"score": sequence_scores([np.frombuffer(b, "<u4").astype(np.int32) for b in part["ids"]], vocab, model).tolist()}

    kept = ["_row", "rid", "n_tokens", "n_known", "logs"]
    scored = map_rows(encoded, {"ids": "ids"}, "score double", rows, keep_row=True, carry=kept)
    scored = scored.select(*[F.col(f"_row.{c}").alias(c) for c in kept], "score")
    rare = encoded.select("rid", F.explode("rare").alias("w")).select("rid", F.col("w.token").alias("token"), F.col("w.n").alias("k"))
    found = rare.join(counts, "token").groupBy("rid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"))
    both = scored.join(found, "rid", "left")
    zero = F.lit(0)
    return both.select(
        "_row",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, crc_mod("doc_id", 7) != 2, vocabulary_path(), carry=["doc_id"])
    doc_id = F.col("_row.doc_id")
    return scored.select(doc_id.alias("doc_id"), F.coalesce(crc_mod(doc_id, 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
