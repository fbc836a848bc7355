"""What the training-data operators share: reading, materialising, text scanning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from leadloom.storage import materialize, shared_path

__all__ = ["ALNUM_LOWER", "alnum_words", "crc_mod", "map_rows", "materialize", "read_table", "shared_path", "space_words", "vector_sum", "whole_groups"]

#: Rows turned into Python objects at a time inside a task, and bytes, whichever is reached first.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Bytes that are not part of a word become spaces; A-Z become a-z; bytes of non-ASCII characters stay.
ALNUM_LOWER = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame,
    inputs: dict[str, Column | str],
    results: str,
    rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    keep_row: bool = False,
    carry: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Applies a generator over column slices in Arrow batches, without a shuffle.

    rows takes and yields dicts of equally long column lists. With keep_row, each output row also has
    the whole input row as the struct _row, so extra or clashing column names do no harm; rows must
    then yield one output per input, in order. carry narrows the kept row to some columns.
    """
    taken = df.select(
        *([F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("_row")] if keep_row else []),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in inputs.items()],
    )
    empty = df.sparkSession.createDataFrame([], results)
    target = to_arrow_schema(empty.schema)
    names = list(inputs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []

        def feed() -> Iterator[dict[str, list]]:
            for batch in batches:
                for part in _slices(batch, slice_rows):
                    if keep_row:
                        kept.append(part.column(0))
                    yield {n: _plain(part.column(part.schema.get_field_index(n))) for n in names}

        for out in rows(feed()):
            arrays = [pa.array(out[f.name], f.type) for f in target]
            if keep_row:
                yield pa.RecordBatch.from_arrays([kept.pop(0), *arrays], ["_row", *target.names])
            else:
                yield pa.RecordBatch.from_arrays(arrays, target.names)

    if keep_row:
        return taken.mapInArrow(run, StructType([StructField("_row", taken.schema["_row"].dataType), *empty.schema.fields]))
    return taken.mapInArrow(run, empty.schema)


def _slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for single long rows, about so many bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def vector_sum(df: DataFrame, size: int, parts: int = 16) -> np.ndarray:
    """The sum of equally long double vectors (column v, binary); tasks add them up to one vector each, another task adds these, and the driver gets one."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py(), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    few = df.repartition(parts, F.spark_partition_id()).mapInArrow(add, "v binary")
    return np.frombuffer(bytes(few.repartition(1).mapInArrow(add, "v binary").first()[0]), "<f8").copy()


def _plain(column: pa.Array) -> list:
    """Text as UTF-8 bytes, anything else as Python objects."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(ALNUM_LOWER).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.split cuts at just these bytes)."""
    return text.lower().split() if text else []


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, the first row of each group and the end), where no group of rows sorted by keys is cut in two."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        starts = _starts(rows, keys)
        cut = int(starts[-2])
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut), starts[:-1]
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    fresh = np.zeros(rows.num_rows, bool)
    fresh[0] = True
    for k in keys:
        column = rows.column(k).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(fresh), rows.num_rows)
