"""Token-id files with a minimal perfect hash index.

Documents are put in ascending id order by a range partitioning, encoded, and written as shards: rows of a
Parquet table with the raw little-endian id payload (two bytes an id where the vocabulary allows it), the
documents' ids and offsets, and a minimal perfect hash index of the document keys. The index (hash and
displace) gives each key one of exactly n slots; a slot stores the key's fingerprint and the document's
place, so a lookup is one hash, one comparison and one slice, and an unknown key is refused but for a
fingerprint collision (2^-32). Spark's committer writes the shards, so a lost executor only repeats its tasks.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of an equal id are
in the order of the input, each is written, and the index key of the k-th such row in a shard is (id, k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import map_rows, read_table, shared_path
from leadloom.llm.encoder import encoder, vocabulary_path

END_ID = 0
#: A shard is closed at so many ids (a longer document is a shard of its own) or documents.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 16
SHARD = (
    "part int, part_start bigint, n_ids bigint, width int, doc_ids array<bigint>, offsets binary, "
    "payload binary, pilots binary, slots binary"
)
_MASK = (1 << 64) - 1
_SLOT = np.dtype([("fingerprint", "<u4"), ("place", "<u4")])


def document_key(doc_id: int | None, k: int = 0) -> int:
    """64-bit hash of an index key."""
    return xxhash.xxh64_intdigest(f"{doc_id}/{k}".encode(), 7)


def _slot(key: int, pilot: int, n: int) -> int:
    """One of n slots for a key under a pilot."""
    x = (key ^ (pilot * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


def build_index(keys: list[int]) -> tuple[bytes, bytes]:
    """(pilots, slots) of a minimal perfect hash of distinct 64-bit keys, whose places are 0, 1, ..."""
    n = len(keys)
    if len(set(keys)) < n:
        raise ValueError("two document keys have the same hash")
    buckets: list[list[int]] = [[] for _ in range(n // 3 + 1)]
    for place, key in enumerate(keys):
        buckets[(key >> 32) % len(buckets)].append(place)
    pilots, slots, free = np.zeros(len(buckets), "<i4"), np.zeros(n, _SLOT), np.ones(n, bool)
    order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
    spare: Iterator[int] | None = None
    for b in order:
        members = buckets[b]
        if not members:
            break
        if len(members) == 1:  # names its slot outright
            spare = iter(np.flatnonzero(free).tolist()) if spare is None else spare
            at = [next(spare)]
            pilots[b] = -1 - at[0]
        else:
            pilot = 0
            while True:
                at = [_slot(keys[p], pilot, n) for p in members]
                if len(set(at)) == len(at) and free[at].all():
                    break
                pilot += 1
            pilots[b] = pilot
        free[at] = False
        for p, s in zip(members, at, strict=True):
            slots[s] = (keys[p] & 0xFFFFFFFF, p)
    return pilots.tobytes(), slots.tobytes()


class Index:
    """Constant-time access to the documents of a shard."""

    def __init__(self, shard: dict):
        self.pilots, self.slots = np.frombuffer(shard["pilots"], "<i4"), np.frombuffer(shard["slots"], _SLOT)
        self.offsets, self.payload, self.width = np.frombuffer(shard["offsets"], "<u8"), shard["payload"], shard["width"]

    def place(self, doc_id: int | None, k: int = 0) -> int | None:
        key = document_key(doc_id, k)
        pilot = int(self.pilots[(key >> 32) % len(self.pilots)])
        slot = self.slots[-1 - pilot if pilot < 0 else _slot(key, pilot, len(self.slots))]
        return int(slot["place"]) if int(slot["fingerprint"]) == key & 0xFFFFFFFF else None

    def ids(self, place: int) -> np.ndarray:
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        return np.frombuffer(self.payload, f"<u{self.width}", b - a, a * self.width).astype("<u4")


def write_ids(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes all documents' ids to the shard table at path."""

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        coder = encoder(vocabulary)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part, done, held, held_ids = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> dict[str, list]:
            seen: dict[int | None, int] = {}
            keys = []
            for doc_id, _ in held:
                seen[doc_id] = k = seen.get(doc_id, -1) + 1
                keys.append(document_key(doc_id, k))
            pilots, slots = build_index(keys)
            offsets = np.cumsum([0, *(len(p) // 4 for _, p in held)]).astype("<u8").tobytes()
            payload = np.frombuffer(b"".join(p for _, p in held), "<u4").astype(f"<u{width}").tobytes()
            row = dict(part=part, part_start=done, n_ids=held_ids, width=width, doc_ids=[d for d, _ in held], offsets=offsets, payload=payload, pilots=pilots, slots=slots)
            return {k: [v] for k, v in row.items()}

        for piece in slices:
            for doc_id, ids in zip(piece["id"], coder.encode(piece["text"]), strict=True):
                held.append((doc_id, ids + end))
                held_ids += len(ids) // 4 + 1
                if held_ids >= SHARD_IDS or len(held) >= SHARD_DOCS:
                    yield shard()
                    done, held, held_ids = done + held_ids, [], 0
        if held:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    shards = map_rows(ordered, {"id": "id", "text": "text"}, SHARD, rows)
    # Small row groups keep readers' memory to a few shards.
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of each document through the index of its shard."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each partition that wrote
    starts, at = [], 0
    for part, n in sorted(map(tuple, totals)):
        starts.append((part, at))
        at += n
    placed = shards.join(F.broadcast(spark.createDataFrame(starts, "part int, start bigint")), "part")

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for piece in slices:
            for k in range(len(piece["start"])):
                shard = {n: v[k] for n, v in piece.items()}
                index, seen = Index(shard), {}
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for doc_id in shard["doc_ids"]:
                    seen[doc_id] = nth = seen.get(doc_id, -1) + 1
                    place = index.place(doc_id, nth)
                    ids = index.ids(place)
                    out["doc_id"].append(doc_id)
                    out["start"].append(shard["start"] + int(index.offsets[place]))
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids.tobytes())
                yield out

    columns = ["width", "doc_ids", "offsets", "payload", "pilots", "slots"]
    inputs = {c: F.col(c) for c in columns} | {"start": F.col("start") + F.col("part_start")}
    return map_rows(placed, inputs, "doc_id bigint, start bigint, n_tokens bigint, ids binary", rows, slice_rows=4)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids binary) of the named documents, a bounded list: only shards whose range holds one are opened."""
    wanted = sorted(set(doc_ids))
    shards = spark.read.schema(SHARD).parquet(path)
    low, high = F.element_at("doc_ids", 1), F.element_at("doc_ids", -1)
    some = F.exists(F.array(*map(F.lit, wanted)), lambda x: (low.isNull() | (x >= low)) & (x <= high)) if wanted else F.lit(False)

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for piece in slices:
            for k in range(len(piece["payload"])):
                index = Index({n: v[k] for n, v in piece.items()})
                found = [(d, index.ids(p).tobytes()) for d in wanted if (p := index.place(d)) is not None]
                yield {"doc_id": [d for d, _ in found], "ids": [i for _, i in found]}

    inputs = {c: F.col(c) for c in ("width", "offsets", "payload", "pilots", "slots")}
    return map_rows(shards.filter(some), inputs, "doc_id bigint, ids binary", rows, slice_rows=4)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path, vocabulary_path())
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

