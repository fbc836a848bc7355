"""Data-subject lookup: every line of every file that holds a subject's phone or tax code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.contact import suppression_phone
from leadloom.functions.text import filled

#: Subjects' keys that are searched in one pass; more take more passes.
BLOCK = 500_000


def subject_keys(subjects: DataFrame) -> DataFrame:
    """(subject_id, kind, needle): the phone's digits (six and more, no country code) and the eleven digits of the tax code."""
    vat = F.regexp_replace("vat", "[^0-9]", "")
    both = F.array(F.struct(F.lit("phone").alias("kind"), suppression_phone(F.col("phone")).alias("needle")), F.struct(F.lit("vat").alias("kind"), F.when(F.length(vat) == 11, vat).alias("needle")))
    return subjects.select("subject_id", F.explode(both).alias("k")).select("subject_id", "k.kind", "k.needle").filter("needle is not null")


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, text) of text files of any size: lines are counted by file block, and a block starts after the blocks before it."""
    from pyspark.sql import Window

    raw = spark.read.text(paths, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def company_of(line: Column) -> Column:
    """The company a line is about: company_name of a JSON line, else its first cell without quotes."""
    json = F.try_variant_get(F.try_parse_json(line), "$.company_name", "string")
    return F.when(line.startswith("{"), json).otherwise(filled(F.regexp_replace(F.split_part(line, F.lit(","), F.lit(1)), '^"|"$', "")))


def find_subjects(lines: DataFrame, subjects: DataFrame, block: int = BLOCK) -> DataFrame:
    """(subject_id, file, line, company_name, matched_on) of lines (file, line, text) whose digits hold a key of a subject.

    A subject that is met by both keys in a line is matched on the phone. All keys of a block are searched in one pass
    by an automaton; only lines with a hit leave the task.
    """
    keys = subject_keys(subjects)
    needles = keys.select("needle").distinct()
    n, found = needles.count(), None
    for k in range(max(1, -(-n // block))):
        part = needles.filter(F.pmod(F.xxhash64("needle"), F.lit(max(1, -(-n // block)))) == k)
        hits = _search(lines, [r[0] for r in part.collect()])
        found = hits if found is None else found.unionByName(hits)
    met = found.join(keys, "needle").groupBy("subject_id", "file", "line").agg(F.first("text").alias("text"), F.min("kind").alias("matched_on"))
    return met.select("subject_id", "file", "line", company_of(F.col("text")).alias("company_name"), "matched_on")


def _search(lines: DataFrame, needles: list[str]) -> DataFrame:
    digits = F.regexp_replace("text", "[^0-9]", "")
    handle = lines.sparkSession.sparkContext.broadcast(needles)
    shortest = min(map(len, needles), default=6)
    schema = lines.select("file", "line", "text").schema.simpleString()[7:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for needle in handle.value:
            tree.add_word(needle, needle)
        if handle.value:
            tree.make_automaton()
        for batch in batches:
            take, which = [], []
            for k, figures in enumerate(batch.column("digits").to_pylist() if handle.value else []):
                for needle in {found for _, found in tree.iter(figures)}:
                    take.append(k), which.append(needle)
            out = batch.select(["file", "line", "text"]).take(pa.array(take, pa.int64()))
            yield out.append_column("needle", pa.array(which, pa.string()))

    return lines.select("file", "line", "text", digits.alias("digits")).filter(F.length("digits") >= shortest).mapInArrow(run, f"{schema.replace(':', ' ')}, needle string")
