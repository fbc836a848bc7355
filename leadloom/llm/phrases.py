"""Phrase collocations: exact counts of frequent phrases and the score of their weakest cut, by language.

1. Words are counted by language. A word's id is a seeded 64-bit hash; the seed is one under which no two words of
   the corpus share an id (a second hash and an aggregate over all words tell), so ids stand for words.
2. The corpus is written once as rows of ids, with 0 for a rare word and for the end of a piece.
3. Candidates are Apriori-safe: for 2, 3, 4 and 5 words in turn, tasks count hashes of the phrases whose both
   parts one word shorter may be frequent, Spark sums them, and hashes that reach MIN_COUNT are kept. Which parts
   may be frequent is told by a Bloom filter of bounded size (BITS); what it or a hash lets through wrongly is counted
   exactly later, and nothing frequent can be lost. Phrases of the kept hashes are the candidates.
4. Candidates, single words too, lie in blocks of about SLOTS keys. Each block gets a minimal perfect hash (hash and
   displace) with the keys stored by slot. Tasks look every phrase up, compare the stored key, and add its slot to a
   numpy array with bincount; the arrays are added up in a tree. Then a pass over the candidates reads their count
   and the counts of all their cuts by slot. One block is broadcast at a time; blocks follow each other, each written
   before the next, so memory is bounded at any size of the corpus, while the number of passes grows with the candidates.
5. Scores are computed in Python's integers. A candidate is dropped where a candidate one word longer, which holds it,
   is as frequent; a longer one that is as frequent implies such a one.

Defined cases: null text is empty, null lang is "und"; empty texts and tables have no phrases; other columns are not
read; equal rows count each; ties of the score are ordered by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import map_rows, materialize, read_table, vector_sum

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Bits of a Bloom filter at most (two bits an entry); keys of a block; ids of a written row (small, as readers hold ten thousand
#: rows) and of an array that is worked on; hashes a task adds up before it sends them.
BITS, SLOTS, ROW_IDS, ARRAY_IDS, HELD = 1 << 26, 1 << 20, 1 << 8, 1 << 16, 1 << 21
#: Bytes of texts of a language that are taken apart at once; longer words are hashed one by one.
TEXT_BYTES, LONG_WORD = 1 << 20, 256
#: Lists of the best TOP in the first of two steps.
SALTS = 32
#: A-Z are lower-cased, a tab is a space, and marks that end a piece become a byte that no text holds.
_TEXT = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_END, _SPACED_END = b"\xff", b" \xff "
_W = [f"w{k}" for k in range(1, LONGEST + 1)]


def words(text: bytes | None) -> list[bytes]:
    """The words of a text, with _END where a piece ends."""
    return text.translate(_TEXT).replace(_END, _SPACED_END).split() if text else []


class WordHash:
    """64-bit ids of the words of a text, all at once: differences of running sums of byte values times powers of a base.

    Long words, for which sums modulo 2^64 have known collisions, go through XXH64 instead.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.seed, self.values = seed, draw.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(draw.integers(0, 1 << 62)) * 4 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base & ((1 << 64) - 1), np.uint64)]))
            self.powers, self.inverses = power(self.base), power(pow(self.base, -1, 1 << 64))

    def __call__(self, text: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        sizes = ends - starts
        salt = np.uint64(xxhash.xxh64_intdigest(lang.encode(), self.seed))
        out = _mix(((sums[ends] - sums[starts]) * self.inverses[starts]) ^ salt + sizes.astype(np.uint64))
        for k in np.flatnonzero(sizes > LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(lang.encode() + b"\n" + text[starts[k] : ends[k]], self.seed)
        return out


def cut(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(translated text, its bytes, starts and ends of its words, the number of the piece of each word)."""
    text = text.translate(_TEXT)
    data = np.frombuffer(text, np.uint8)
    within = np.zeros(len(data) + 2, np.int8)
    within[1:-1] = (data != 32) & (data != 255)
    edges = np.diff(within)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return text, data, starts, ends, np.cumsum(data == 255, dtype=np.int32)[starts]


def _by_language(slices: Iterator[dict[str, list]]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts of it joined by a mark that ends a piece), about TEXT_BYTES at a time."""
    for part in slices:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(part["lang"], part["text"], strict=True):
            if text:
                texts.setdefault(lang.decode(), []).append(text)
        for lang, many in texts.items():
            held, size = [], 0
            for text in many:
                held.append(text)
                size += len(text)
                if size >= TEXT_BYTES:
                    yield lang, b"\n".join(held)
                    held, size = [], 0
            if held:
                yield lang, b"\n".join(held)


def _inputs(text_col: str, lang_col: str) -> dict[str, Column]:
    return {"lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), "text": F.col(f"`{text_col}`").cast("string")}


def count_words(docs: DataFrame, seed: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n, id) of all words; a row without a word tells of two words with one id."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        first, second = WordHash(2 * seed), WordHash(2 * seed + 1)
        held: dict[str, list] = {}

        def out(lang: str) -> dict[str, list]:
            texts, ids, checks, where = zip(*held.pop(lang), strict=True)
            ids, checks = np.concatenate(ids), np.concatenate(checks)
            values, at, inverse, counts = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            offset = np.cumsum([0, *map(len, (w[0] for w in where))])
            found: list[str | None] = []
            text_of = np.searchsorted(offset, at, "right") - 1
            for k, t in zip((at - offset[text_of]).tolist(), text_of.tolist(), strict=True):
                found.append(texts[t][where[t][0][k] : where[t][1][k]].decode())
            n, values = counts.tolist(), values.view(np.int64).tolist()
            if (checks != checks[at[inverse]]).any():
                found.append(None), n.append(0), values.append(0)
            return {"lang": [lang] * len(n), "word": found, "n": n, "id": values}

        size = 0
        for lang, text in _by_language(slices):
            text, data, starts, ends, _ = cut(text)
            if len(starts):
                held.setdefault(lang, []).append((text, first(text, data, starts, ends, lang), second(text, data, starts, ends, lang), (starts, ends)))
                size += len(starts)
                if size >= HELD >> 3:
                    for lang in list(held):
                        yield out(lang)
                    size = 0
        for lang in list(held):
            yield out(lang)

    sent = map_rows(docs, _inputs(text_col, lang_col), "lang string, word string, n bigint, id bigint", rows, slice_rows=4096)
    return sent.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("id").alias("id"))


def with_ids(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """(lang, word, n, id) of all words, where different words have different ids other than 0, and the seed of the ids, the first from seed on."""
    while True:
        coded = materialize(count_words(docs, seed), "words")
        if coded.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1 or id = 0").isEmpty():
            return coded, seed
        seed += 1


def bloom(keys: DataFrame, most: int = BITS) -> bytes:
    """Bits of the 64-bit keys of a one-column table, 32 for each key but at most so many; tasks fill one array each, which are joined in a tree."""
    bits = max(1 << 16, min(most, 1 << (32 * keys.count()).bit_length()))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(have, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()])], ["v"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for v in batch.column(0):
                have |= np.frombuffer(v.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()])], ["v"])

    few = keys.coalesce(8).mapInArrow(fill, "v binary")  # keys come from a written table; few tasks send few arrays
    return bytes(few.repartition(1).mapInArrow(join, "v binary").first()[0])


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [keys & np.uint64(bits - 1), (keys >> np.uint64(32)) & np.uint64(bits - 1)]


def _member(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _probes(keys, len(have) << 3):
        out &= (have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def encode(docs: DataFrame, seed: int, frequent: bytes, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ids binary, part): the corpus as little-endian ids, 0 between pieces and for what is not frequent; part names the task that wrote a row."""
    handle = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        have, coder, held, size, part = np.frombuffer(handle.value, np.uint8), WordHash(2 * seed), [], 0, TaskContext.get().partitionId()
        for lang, text in _by_language(slices):
            text, data, starts, ends, piece = cut(text)
            if not len(starts):
                continue
            ids = coder(text, data, starts, ends, lang)
            ids[~_member(have, ids)] = 0
            found = np.zeros(len(ids) + int(np.count_nonzero(np.diff(piece))) + 1, np.uint64)  # room for a 0 after each piece
            found[np.arange(len(ids)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)] = ids
            keep = np.ones(len(found), bool)  # one 0 is as good as many
            keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
            held.append(found[keep])
            size += len(held[-1])
            if size >= ARRAY_IDS:
                rows_ = _cut_rows(np.concatenate(held))
                yield {"ids": rows_, "part": [part] * len(rows_)}
                held, size = [], 0
        if size:
            rows_ = _cut_rows(np.concatenate(held))
            yield {"ids": rows_, "part": [part] * len(rows_)}

    return map_rows(docs, _inputs(text_col, lang_col), "ids binary, part int", rows, slice_rows=4096)


def _cut_rows(ids: np.ndarray) -> list[bytes]:
    """Ids that end with a 0 as rows that do, of ROW_IDS or as many more as the piece takes."""
    ends = np.flatnonzero(ids == 0) + 1
    cuts, at = [0], 0
    while at < len(ids):
        at = int(ends[np.searchsorted(ends, min(at + ROW_IDS, len(ids)))])
        cuts.append(at)
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(part, ids of its rows) in arrays of about ARRAY_IDS; rows end with a 0, so any of them may follow each other."""
    for batch in batches:
        parts = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(parts)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
            if b > a:
                for ids in _joined(batch.column(0).slice(a, b - a)):
                    yield int(parts[a]), ids


def _joined(rows: pa.Array) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    ids, ends, at = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]) >> 3, 0
    while at < len(ids):
        upto = int(ends[min(int(np.searchsorted(ends, at + ARRAY_IDS)), len(rows))])
        yield ids[at:upto]
        at = upto


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _grams(ids: np.ndarray, filters: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the phrases of 2 to longest words whose parts may be frequent; filters[0] tells of two words."""
    places = np.flatnonzero(ids)
    hashes = ids[places]
    for k in range(2, longest + 1):
        follows = places[1:] == places[:-1] + 1  # the phrase that starts one word later is there too
        places, hashes = places[:-1][follows], hashes[:-1][follows]
        hashes = _mix(hashes * np.uint64(0xC2B2AE3D27D4EB4F) + ids[places + (k - 1)])
        yield k, places, hashes
        if k - 2 < len(filters):
            sure = _member(filters[k - 2], hashes)
            places, hashes = places[sure], hashes[sure]


def frequent_hashes(corpus: DataFrame, k: int, filters: list, min_count: int) -> DataFrame:
    """(hash, n, part) of the phrases of k words that may reach min_count, with one part that has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, held, size, part = [np.frombuffer(f.value, np.uint8) for f in filters], [], 0, -1

        def out() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts), pa.array(np.full(len(values), part, np.int32))], ["hash", "n", "part"])

        for of, ids in _arrays(batches):
            if held and of != part:
                yield out()
                held, size = [], 0
            part = of
            for n, _, hashes in _grams(ids, have, k):
                if n == k and len(hashes):
                    held.append(hashes)
                    size += len(hashes)
            if size >= HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    # Tasks have added up what they can, so there is nothing to gain from Spark's own sums before the shuffle.
    sums = corpus.mapInArrow(run, "hash bigint, n bigint, part int").repartition("hash").groupBy("hash").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    return materialize(sums.filter(F.col("n") >= min_count), f"phrases-{k}")


def _tuples(ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(places), LONGEST), np.uint64)
    for j in range(k):
        out[:, j] = ids[places + j]
    return out


def _of_part(hashes: np.ndarray, part: int) -> np.ndarray:
    """Keys of phrases as those of a part."""
    return _mix(hashes ^ _mix(np.array([part + 1], np.uint64)))


def part_keys(hashes: DataFrame) -> DataFrame:
    """(key): _of_part of (hash, part)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _mix((batch.column(1).to_numpy() + 1).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_mix(batch.column(0).to_numpy().view(np.uint64) ^ parts).view(np.int64))], ["key"])

    return hashes.select("hash", "part").mapInArrow(run, "key bigint")


def candidate_keys(corpus: DataFrame, filters: list, owners: list, kept: DataFrame, longest: int) -> DataFrame:
    """(k, w1 .. w5): the different phrases whose hashes are in kept (k, hash).

    A phrase is sent from the part that was noted for it only (owners tell), and once, as long as the task remembers it (HELD phrases).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, own = ([np.frombuffer(f.value, np.uint8) for f in many] for many in (filters, owners))
        held, size = [], 0
        sent: dict[int, np.ndarray] = {}

        def fresh(k: int) -> pa.RecordBatch | None:
            hashes, checks, keys = (np.concatenate(x) for x in zip(*[h[1:] for h in held if h[0] == k], strict=True))
            # A phrase is known by its hash and a check of its words, so other phrases of an equal hash are sent as well.
            order = np.lexsort((checks, hashes))
            hashes, checks, keys = hashes[order], checks[order], keys[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
            hashes, checks, keys = hashes[new], checks[new], keys[new]
            known = sent.get(k, np.zeros(0, np.uint64))
            both = hashes ^ _mix(checks)
            unseen = ~np.isin(both, known)
            sent[k] = np.concatenate([known, both[unseen]]) if len(known) < HELD else both[unseen]
            if not unseen.any():
                return None
            columns = [pa.array(np.full(int(unseen.sum()), k, np.int32)), pa.array(hashes[unseen].view(np.int64)), *(pa.array(np.ascontiguousarray(keys[unseen, j]).view(np.int64)) for j in range(LONGEST))]
            return pa.RecordBatch.from_arrays(columns, ["k", "hash", *_W])

        def out() -> Iterator[pa.RecordBatch]:
            for k in sorted({h[0] for h in held}):
                batch = fresh(k)
                if batch is not None:
                    yield batch

        for part, ids in _arrays(batches):
            for k, places, hashes in _grams(ids, have, longest):
                sure = _member(own[k - 2], _of_part(hashes, part))
                if sure.any():
                    keys = _tuples(ids, places[sure], k)
                    checks = np.zeros(len(keys), np.uint64)
                    for j in range(k):
                        checks = _mix(checks ^ keys[:, j])
                    held.append((k, hashes[sure], checks, keys))
                    size += len(keys)
            if size >= HELD >> 3:
                yield from out()
                held, size = [], 0
        yield from out()

    sent_ = corpus.mapInArrow(run, "k int, hash bigint, " + ", ".join(f"{w} bigint" for w in _W)).distinct()
    return sent_.join(kept.select("k", "hash"), ["k", "hash"], "left_semi").select("k", *_W).distinct()


class PerfectHash:
    """A minimal perfect hash of distinct keys (rows of LONGEST ids), with the keys stored by slot for verification."""

    def __init__(self, keys: np.ndarray):
        self.n, self.seed = len(keys), 0
        hashed = self._hash(keys)
        while len(np.unique(hashed)) < len(keys):
            self.seed += 1
            hashed = self._hash(keys)
        self.pilots = np.zeros(self.n // 3 + 1, np.int64)
        self.slots = np.full(self.n, -1, np.int64)
        bucket = ((hashed >> np.uint64(32)) % np.uint64(len(self.pilots))).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(self.pilots))
        starts = np.cumsum(sizes) - sizes
        for size in range(int(sizes.max(initial=0)), 1, -1):
            waiting = np.flatnonzero(sizes == size)
            members = by_bucket[starts[waiting][:, None] + np.arange(size)]
            pilot = 0
            while len(waiting):
                at = self._slot(hashed[members], pilot)
                fits = (self.slots[at] < 0).all(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                some = np.flatnonzero(fits)
                if len(some):  # of buckets that want a slot at once the first gets it
                    flat = at[some].ravel()
                    _, first = np.unique(flat, return_index=True)
                    mine = np.zeros(len(flat), bool)
                    mine[first] = True
                    won = some[mine.reshape(-1, size).all(axis=1)]
                    self.slots[at[won]] = members[won]
                    self.pilots[waiting[won]] = pilot
                    left = np.ones(len(waiting), bool)
                    left[won] = False
                    waiting, members = waiting[left], members[left]
                pilot += 1
        alone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(self.slots < 0)  # a bucket of one names its slot outright
        self.slots[free] = by_bucket[starts[alone]]
        self.pilots[alone] = -1 - free
        self.keys = keys[self.slots]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = np.full(len(keys), self.seed + 1, np.uint64)
        for j in range(keys.shape[1]):
            h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, j])
        return h

    def _slot(self, hashed: np.ndarray, pilot: int | np.ndarray) -> np.ndarray:
        salt = np.asarray(pilot).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (_mix(hashed ^ salt) % np.uint64(max(self.n, 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that aren't stored."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        hashed = self._hash(keys)
        pilot = self.pilots[((hashed >> np.uint64(32)) % np.uint64(len(self.pilots))).astype(np.int64)]
        slot = np.where(pilot < 0, -1 - pilot, self._slot(hashed, np.maximum(pilot, 0)))
        return np.where((self.keys[slot] == keys).all(axis=1), slot, -1)


def count_block(corpus: DataFrame, block: PerfectHash, filters: list, longest: int) -> np.ndarray:
    """Occurrences of the block's phrases by slot."""
    handle = corpus.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, table = [np.frombuffer(f.value, np.uint8) for f in filters], handle.value
        counts = np.zeros(table.n, np.int64)

        def add(ids: np.ndarray, places: np.ndarray, k: int) -> None:
            slots = table.find(_tuples(ids, places, k))
            counts[:] += np.bincount(slots[slots >= 0], minlength=table.n)

        for _, ids in _arrays(batches):
            add(ids, np.flatnonzero(ids), 1)
            for k, places, hashes in _grams(ids, have, longest):
                add(ids, places[_member(have[k - 2], hashes)], k)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype("<f8").tobytes()])], ["v"])

    out = vector_sum(corpus.mapInArrow(run, "v binary"), table_size := block.n).astype(np.int64)
    assert len(out) == table_size
    handle.destroy()
    return out


#: Places of a row's counts: its own, then left and right of each cut.
_PARTS = 1 + 2 * (LONGEST - 1)


def read_cuts(candidates: DataFrame, block: PerfectHash, counts: np.ndarray) -> DataFrame:
    """candidates (k, w1 .. w5, parts) with the counts of the parts that the block holds filled in."""
    handle = candidates.sparkSession.sparkContext.broadcast((block, counts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, have = handle.value
        for batch in batches:
            keys = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in _W], axis=1) if batch.num_rows else np.zeros((0, LONGEST), np.uint64)
            ks = batch.column("k").to_numpy()
            parts = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i8").reshape(-1, _PARTS).copy()

            def put(place: int, wanted: np.ndarray, rows: np.ndarray) -> None:
                slots = table.find(wanted)
                found = slots >= 0
                parts[rows[found], place] = have[slots[found]]

            put(0, keys, np.arange(len(keys)))
            for cut in range(1, LONGEST):
                rows = np.flatnonzero(ks > cut)
                left, right = np.zeros((len(rows), LONGEST), np.uint64), np.zeros((len(rows), LONGEST), np.uint64)
                left[:, :cut], right[:, : LONGEST - cut] = keys[rows, :cut], keys[rows, cut:]
                put(2 * cut - 1, left, rows)
                put(2 * cut, right, rows)
            yield batch.set_column(batch.schema.get_field_index("parts"), "parts", pa.array([r.tobytes() for r in parts], pa.binary()))

    return candidates.mapInArrow(run, candidates.schema)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer candidate of the same frequency holds.

    The exact counts of the candidates must add up to those of their hashes. Where they don't, two phrases share a
    hash, and one of them may not have been sent; all is then done again under another seed.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    all_words, seed = with_ids(docs, seed)
    totals = all_words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = all_words.filter(F.col("n") >= min_count)
    corpus = encode(docs, seed, bloom(frequent.select("id"))).write.option("compression", "zstd").option("parquet.block.size", 16 << 20)
    corpus = materialize_with(spark, corpus, "corpus-ids", "ids binary, part int")
    filters, owners, kept = [], [], None
    for k in range(2, longest + 1):
        hashes = frequent_hashes(corpus, k, filters, min_count)
        filters.append(share(bloom(hashes.select("hash"))))
        owners.append(share(bloom(part_keys(hashes))))
        tagged = hashes.select(F.lit(k).alias("k"), "hash", "n")
        kept = tagged if kept is None else kept.unionByName(tagged)
    long_ = candidate_keys(corpus, filters, owners, kept, longest)
    single = frequent.select(F.lit(1).alias("k"), F.col("id").alias("w1"), *[F.lit(0).cast("bigint").alias(w) for w in _W[1:]])
    keys = materialize(long_.unionByName(single).withColumn("h", F.xxhash64(*_W)), "phrase-keys")
    n_blocks = max(1, -(-keys.count() * 4 // (slots * 3)))
    rows = keys.filter("k > 1").select("k", *_W, F.lit(bytes(8 * _PARTS)).alias("parts"))
    for b in range(n_blocks):
        taken = keys.filter(F.pmod("h", F.lit(n_blocks)) == b).select(*_W).toArrow()
        block = PerfectHash(np.stack([taken.column(w).to_numpy().view(np.uint64) for w in _W], axis=1))
        rows = materialize(read_cuts(rows, block, count_block(corpus, block, filters, longest)), "cuts")
    for f in (*filters, *owners):
        f.destroy()
    scored = _score(rows, frequent, totals, min_count)
    if scored.agg(F.sum("a")).first()[0] != kept.agg(F.sum("n")).first()[0]:
        return collocations(docs, min_count, longest, slots, seed + 1)
    return _kept(scored, frequent)


def materialize_with(spark: SparkSession, writer, name: str, schema: str) -> DataFrame:
    """materialize() for a writer with options."""
    from leadloom.llm.common import shared_path

    path = shared_path(spark, name)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _score(rows: DataFrame, frequent: DataFrame, totals: DataFrame, min_count: int) -> DataFrame:
    """(k, w1 .. w5, lang, n, a, l, r, score) of the candidates that reach min_count."""
    known = frequent.select(F.col("id").alias("w1"), "lang").join(totals, "lang")
    found = rows.join(known, "w1")

    def run(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            out: dict[str, list] = {c: [] for c in ("a", "l", "r", "score")}
            for k, n, counts in zip(part["k"], part["n"], part["parts"], strict=True):
                c = np.frombuffer(counts, "<i8").tolist()
                score, cut = min((1000 * c[0] * n // (c[2 * j - 1] * c[2 * j]), j) for j in range(1, k)) if c[0] >= min_count else (0, 1)
                for name, value in zip(("a", "l", "r", "score"), (c[0], c[2 * cut - 1], c[2 * cut], score), strict=True):
                    out[name].append(value)
            yield out

    scored = map_rows(found, {"k": "k", "n": "n", "parts": "parts"}, "a bigint, l bigint, r bigint, score bigint", run, keep_row=True, carry=["k", *_W, "lang", "n"])
    return materialize(scored.filter(F.col("a") >= min_count).select("_row.*", "a", "l", "r", "score"), "scored")


def _kept(scored: DataFrame, frequent: DataFrame) -> DataFrame:
    """The candidates with their words, but for those that one longer by a word holds with the same frequency."""
    none = F.lit(0).cast("bigint")
    holds = lambda ws: F.struct(*[c.alias(w) for w, c in zip(_W, ws, strict=True)])
    first = holds([*[F.when(F.col("k") > j + 1, F.col(_W[j])).otherwise(none) for j in range(LONGEST - 1)], none])
    last = holds([*[F.col(_W[j + 1]) for j in range(LONGEST - 1)], none])
    inside = scored.filter("k > 2").select(F.explode(F.array(first, last)).alias("p"), "a").select("p.*", "a")
    left = scored.join(inside, [*_W, "a"], "left_anti")
    spelt = left.select("*", F.posexplode(F.filter(F.array(*_W), lambda w: w != 0)).alias("at", "id")).join(frequent.select("id", "word"), "id")
    return spelt.groupBy("lang", *_W, "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")).drop(*_W)


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best; SALTS lists are cut before the last one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(collocations(read_table(spark, sf_dir, "documents")))


OP13_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, a, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k > 2),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND i.a = b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept
QUALIFY rank <= 2000"""
