"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64-bit SimHash over word shingles. Distinct fingerprints meet where two of six bit
segments agree (with at most four differing bits, at least two segments are untouched, so no link is
lost). Inside such a bucket a pivot table holds the Hamming distances to many reference fingerprints; a
pair whose tables differ in some coordinate by more than the radius cannot be a link (triangle
inequality) and is discarded, and the survivors are verified bit by bit. A bucket sends on a spanning
forest of its links, never all its pairs, and a bucket of over `bucket_rows` fingerprints is dealt out to
pairs of chunks, so that each task holds at most two chunks.

deduplicate(), the pipeline's stage, has its own contract: Jaccard similarity of five-word shingles, see there.

Defined cases: a null or empty text has the fingerprint 0, which is linked like any other; rows with a
null id take part, and a component's id is its smallest non-null id; repeated rows are linked with each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import map_rows, materialize, read_table, space_words, whole_groups
from leadloom.llm.components import components

SHINGLE, SEED, RADIUS, PIVOTS, BUCKET_ROWS = 4, 42, 4, 16, 8192
SEGMENTS = 6
#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16
#: Of the pipeline's stage: words of a shingle, similarity of a link, bands and min-hashes of a band, texts of a chunk.
WORDS, SIMILARITY, BANDS, BAND, CHUNK = 5, 0.8, 24, 4, 256
#: Shingles that are compared at a time.
SLAB = 8192


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of space-joined shingles, repeats included; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(text, seed)
        n = 1
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest, n = xxhash.xxh64_digest, len(words) - shingle + 1
        digests = b"".join([digest(text[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[k : k + COUNT_ROWS], axis=1).sum(0, dtype=np.int64) for k in range(0, n, COUNT_ROWS))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """(id_col, or the columns carry as _row; fp long)."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            yield {"fp": [fingerprint(space_words(t), shingle) for t in part["text"]]}

    out = map_rows(docs, {"text": F.col(text_col).cast("string")}, "fp bigint", rows, keep_row=True, carry=carry or [id_col])
    return out if carry else out.select(F.col(f"_row.`{id_col}`").alias(id_col), "fp")


def _segments() -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _buckets(fps: DataFrame) -> DataFrame:
    """(bucket, fp): one row for each two segments of a fingerprint."""
    keys = []
    for n, (x, y) in enumerate(itertools.combinations(_segments(), 2)):
        parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in (x, y)]
        keys.append(F.shiftleft(F.shiftleft(parts[0], y[1]).bitwiseOR(parts[1]), 4).bitwiseOR(F.lit(n)))
    return fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def _dealt(buckets: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds the pair of chunks (x, y) under which a row is compared; buckets of the usual size have one chunk."""
    hot = materialize(buckets.groupBy("bucket").count().filter(F.col("count") > bucket_rows), "hot-buckets")
    if hot.isEmpty():
        return buckets.select("bucket", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp")
    chunks = F.coalesce(F.ceil(F.col("count") / bucket_rows), F.lit(1)).cast("int")
    own = buckets.join(hot, "bucket", "left").withColumn("n", chunks)
    own = own.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    each = own.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("bucket", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), "fp")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(0).integers(0, 1 << 64, n, dtype=np.uint64)


def forest(group: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) positions: a spanning forest of the links between rows of equal group; rows are sorted by group."""
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)
    label = np.arange(len(fp))
    left = np.arange(len(fp))
    for shift in range(1, len(fp)):
        left = left[left + shift < len(fp)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            break
        a, b = left, left + shift
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for k in range(len(refs)):  # discard by the largest coordinate difference
            near = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[near], b[near]
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if linked.any():
            _unite(label, a[linked], b[linked])
    child = np.flatnonzero(label != np.arange(len(fp)))
    return child, label[child]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of a and b; label always holds each row's root, the first row of its class."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(label[a].tolist(), label[b].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    old = np.array(sorted(parent), dtype=np.int64)
    if len(old):
        new = np.array([root(x) for x in old.tolist()], dtype=np.int64)
        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
        moved = old[at] == label
        label[moved] = new[at[moved]]


def links(fps: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect just what links of at most radius bits connect."""
    if radius > SEGMENTS - 2:
        raise ValueError(f"radius is at most {SEGMENTS - 2}")
    dealt = _dealt(_buckets(fps), bucket_rows)
    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "fp")
    refs = pivots(n_pivots)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            bucket, x, y, fp = cols
            fresh = np.ones(len(fp), bool)
            fresh[1:] = (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            child, parent = forest(np.cumsum(fresh), fp.view(np.uint64), radius, refs)
            return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.array(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))  # the rows of the last group are held until it is complete
            held = [c[cut:] for c in cols]
            if cut:
                yield flush([c[:cut] for c in cols])
        if held is not None:
            yield flush(held)

    return dealt.mapInArrow(solve, "a bigint, b bigint").distinct()


def classes(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, **options) -> DataFrame:
    """(fp, root, component_id): for each fingerprint a name of its component, and the smallest id in it."""
    least = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "fingerprints")
    roots = components(links(least.select("fp"), radius, **options))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    named = materialize(named, "rooted")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, fingerprint hex, component_id), one row per row of docs."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fps")
    out = fps.join(classes(fps, id_col, **options), "fp")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; one of all words where there are fewer, none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    seen = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    own = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(size, len(own))
    total = np.zeros(len(own) - n + 1, np.uint64)
    for k in range(n):
        total = _mixed(total + own[k : len(own) - n + 1 + k])
    return np.unique(total)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of min-hashes; sets of similarity s agree in one with 1 - (1 - s ** BAND) ** BANDS."""
    if not len(hashes):
        return []
    odd = np.random.default_rng(1).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    step = COUNT_ROWS // 16
    least = np.min([(hashes[k : k + step, None] * odd).min(axis=0) for k in range(0, len(hashes), step)], axis=0).reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND):
        key = _mixed(key + least[:, k])
    return key.view(np.int64).tolist()


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of the hashes of a set: bits that are set in over half of them."""
    ones = sum((np.unpackbits(hashes[k : k + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(hashes), COUNT_ROWS)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "little", signed=True)


def within(row: np.ndarray, place: np.ndarray, size: np.ndarray, width: int, radius: float, n_pivots: int = PIVOTS) -> np.ndarray:
    """Pairs of rows that a pivot table of Jaccard distances leaves open.

    Jaccard distance is a metric, so rows whose distances to some pivot differ by more than the radius are farther apart than it.
    """
    refs = np.unique(np.linspace(0, len(size) - 1, n_pivots).astype(int))
    left = np.ones((len(size), len(size)), bool)
    for ref in refs.tolist():
        own = np.zeros(width)
        own[place[row == ref]] = 1
        shared = np.bincount(row, own[place], len(size))
        shared[ref] = size[ref]
        distance = 1 - shared / np.maximum(1, size + size[ref] - shared)
        distance[(size == 0) & (size[ref] == 0)] = 0
        left &= np.abs(distance[:, None] - distance[None, :]) <= radius + 1e-9
    return left


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first row of each row's class, where sets of at least this Jaccard similarity are linked.

    Pairs that the pivot table discards are no links; only rows with pairs left are compared hash by hash.
    """
    size = np.array([len(s) for s in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, place = np.repeat(np.arange(len(sets)), size)[held[at] > 1], (np.cumsum(held > 1) - 1)[at[held[at] > 1]]
    width = int((held > 1).sum())
    left = within(row, place, size, width, 1 - similarity)
    rows = np.flatnonzero(left.sum(axis=1) > 1)
    kept = np.isin(row, rows)
    row, place = np.searchsorted(rows, row[kept]), place[kept]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    shared = np.zeros((len(rows), len(rows)))
    for k in range(0, width, SLAB):
        lo, hi = np.searchsorted(place, [k, k + SLAB])
        part = np.zeros((len(rows), min(SLAB, width - k)), np.float32)
        part[row[lo:hi], place[lo:hi] - k] = 1
        shared += part @ part.T
    near = shared >= similarity * (size[rows][:, None] + size[rows][None, :] - shared) - 1e-9
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(rows, rows)] = near & left[np.ix_(rows, rows)]
    label = np.full(len(sets), -1)
    for k in range(len(sets)):
        if label[k] < 0:
            label[k], fresh = k, np.array([k])
            while len(fresh):
                fresh = np.flatnonzero(linked[fresh].any(axis=0) & (label < 0))
                label[fresh] = k
    return label


def _verified(dealt: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the links among the rows (root, x, y, node, text) of each root, x and y."""
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["root", "x", "y"]):
            node, text = rows.column("node").to_numpy(), rows.column("text").cast(pa.large_binary())
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                label = similar([shingles(space_words(t), size) for t in text.slice(lo, hi - lo).to_pylist()], similarity)
                child = np.flatnonzero(label != np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][child]), pa.array(node[lo:hi][label[child]])], ["a", "b"])

    return dealt.select("root", "x", "y", "node", "text").mapInArrow(solve, "a bigint, b bigint").filter("a <> b").distinct()


def similar_texts(texts: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(node, root): the classes of texts (root, node, text) that links of at least this shingle similarity connect.

    Only texts of one candidate class (root, its smallest node) are compared, where pivot tables leave them open. Each of its chunks is solved with the
    class's first text; then the texts outside the class's largest part meet all others, chunk by chunk.
    """
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    sizes = texts.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    each = texts.join(sizes, "root")
    first = each.filter("node = root").withColumn("x", spread(F.col("n"))).filter(F.col("x") != own(F.col("n")))
    inner = _verified(each.withColumn("x", own(F.col("n"))).unionByName(first).withColumn("y", F.lit(0)), size, similarity)
    inner = materialize(inner, "inner-links")
    parts = components(inner).select("node", F.col("root").alias("part"))
    parts = materialize(texts.select("root", "node").join(parts, "node", "left").select("root", "node", F.coalesce("part", "node").alias("part")), "parts")
    largest = parts.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    rest = largest.filter(F.col("all") > F.col("most")).select("root", "largest", F.ceil((F.col("all") - F.col("most")) / chunk).cast("int").alias("m"))
    open_ = materialize(each.join(parts, ["root", "node"]).join(rest, "root"), "open")
    outside = open_.filter("part <> largest").withColumn("x", own(F.col("m"))).withColumn("y", spread(F.col("n")))
    whole = open_.withColumn("x", spread(F.col("m"))).withColumn("y", own(F.col("n")))
    met = whole.filter((F.col("part") == F.col("largest")) | (F.col("x") != own(F.col("m"))))
    met = met.unionByName(outside).dropDuplicates(["root", "x", "y", "node"])
    return components(inner.unionByName(_verified(met, size, similarity)))


def _fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(node, first): candidate links of nodes (node, fp): equal fingerprints, and those that links() finds near."""
    named = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    near = links(named.select("fp"))
    ends = near.join(named.select(F.col("fp").alias("a"), F.col("first").alias("node")), "a").join(named.select(F.col("fp").alias("b"), "first"), "b").select("node", "first")
    return nodes.join(named, "fp").filter("node <> first").select("node", "first").unionByName(ends)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each near-duplicate group, the first by id (nulls last), columns unchanged.

    Texts are linked when the Jaccard similarity of their word shingles is at least `similarity`, counted exactly.
    SimHash fingerprints of the shingles propose pairs by buckets and pivot tables, as in near_duplicates(); at 0.8
    fingerprints differ in about ten bits, beyond any bucket, so bands of min-hashes propose further pairs. In a
    candidate class, pivot tables of Jaccard distances discard pairs before the exact count.
    Texts with equal shingles are one node. Row ids are written together with the rows, so they hold when tasks run again.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))

    def keys(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            sets = [shingles(space_words(t), size) for t in part["text"]]
            yield {"same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "fp": [majority(s) for s in sets], "bands": [bands(s) for s in sets]}

    written = map_rows(rows, {"text": F.col(f"row.`{text_col}`").cast("string")}, "same binary, fp bigint, bands array<bigint>", keys, keep_row=True)
    written = materialize(written.select("_row.row", "_row.rid", "same", "fp", "bands"), "shingled")
    nodes = materialize(written.groupBy("same").agg(F.min("rid").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
    each = nodes.select("node", F.explode("bands").alias("band"))
    first = each.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    banded = each.join(first, "band").select("node", "first")
    roots = components(banded.unionByName(_fingerprint_links(nodes)))
    texts = written.select(F.col("rid").alias("node"), F.col(f"row.`{text_col}`").cast("string").alias("text")).join(roots, "node")
    found = similar_texts(materialize(texts.select("root", "node", "text"), "candidates"), size, similarity, chunk)
    named = written.select(F.col(f"row.`{id_col}`").alias("id"), "rid", "same").join(nodes.select("same", "node"), "same").join(found, "node", "left")
    one = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(one.alias("first")).select("first.rid")
    return written.join(kept, "rid", "left_semi").select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
