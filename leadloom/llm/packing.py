"""Packing into training sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt into randomised groups of about `group_docs`, which are packed independently, so a task
holds one group. In a group each document is cut into full sequences and a remainder; the remainders go,
longest first, into the leftmost bin with room, which a tournament tree finds in logarithmic time. As
documents may be cut, the gaps of the fullest bins are then filled from the emptiest bins, and what is left
in the last bin becomes sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; rows with null or repeated ids are packed each;
groups are dealt by row, so neither repeated ids nor a hot source make a group large.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import map_rows, read_table
from leadloom.llm.encoder import encoder, vocabulary_path

LENGTH, END_ID, GROUP_DOCS = 2048, 1, 512
#: A gap below this is left as padding, so that cutting makes no crumbs.
LEAST_PIECE = 16
PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class CapacityTree:
    """Bins 0, 1, ... of equal capacity; each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts size into the leftmost bin with room and gives the bin."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        found = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def pack(sizes: list[int], length: int = LENGTH, least_piece: int = LEAST_PIECE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of the given sizes."""
    full = [[(d, a, length)] for d, n in enumerate(sizes) for a in range(0, n - length + 1, length)]
    rest = sorted(((n % length, d) for d, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    if not rest:
        return full
    tree = CapacityTree(len(rest), length)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for n, d in rest:
        bins.setdefault(tree.place(n), []).append((d, sizes[d] - n, n))
    filled = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    last = len(filled) - 1
    for at, one in enumerate(filled):
        gap = length - sum(p[2] for p in one)
        while gap >= least_piece and last > at:
            d, a, n = filled[last].pop()
            take = min(gap, n)
            one.append((d, a, take))
            gap -= take
            if take < n:
                filled[last].append((d, a + take, n - take))
            elif not filled[last]:
                last -= 1
    kept = [b for b in filled if b]
    final = kept[-1]
    if 0 < length - sum(p[2] for p in final) >= least_piece:
        kept[-1:] = _powers(final)
    return full + kept


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are powers of two, largest first."""
    left, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        one: list[tuple[int, int, int]] = []
        while size:
            d, a, n = pieces.pop()
            take = min(size, n)
            one.append((d, a, take))
            size -= take
            if take < n:
                pieces.append((d, a + take, n - take))
        out.append(one)
    return out


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece (see PIECE, and ids_crc32); sequences are to be padded to length except at a power of two."""
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
    )
    dealt = dealt.repartition("group").sortWithinPartitions("group", "id")

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        coder, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        group, held = None, []

        def packed() -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for nth, pieces in enumerate(pack([len(ids) // 4 for _, ids in held], length)):
                at = 0
                for d, start, n in pieces:
                    doc_id, ids = held[d]
                    ids_here = ids[4 * start : 4 * (start + n)]
                    for k, v in (("doc_id", doc_id), ("start", start), ("length", n), ("ids", ids_here if with_ids else None), ("ids_crc32", zlib.crc32(ids_here)), ("doc_tokens", len(ids) // 4), ("sequence_id", group << 32 | nth), ("offset", at)):
                        out[k].append(v)
                    at += n
            return out

        for piece in slices:
            for doc_id, own, ids in zip(piece["id"], piece["group"], coder.encode(piece["text"]), strict=True):
                if own != group and held:
                    yield packed()
                    held = []
                group = own
                held.append((doc_id, ids + end))
        if held:
            yield packed()

    return map_rows(dealt, {"id": "id", "text": "text", "group": "group"}, PIECE + ", ids_crc32 bigint", rows)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
