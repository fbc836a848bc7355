"""Spans of regular expressions in code points, as DataFrame expressions only.

Splitting a text at a pattern and extracting all its matches walk through the same matches, so the lengths
of the parts and of the matches give each match's place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


#: Matches that are placed together, so that a text's cost doesn't grow with the square of its matches.
BLOCK = 64


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n)


def let(value: Column, result) -> Column:
    """result(value), where value is evaluated once."""
    return F.element_at(F.transform(F.array(value), result), 1)


def find(text: Column, pattern: str, kind: str, guard: Column, group: int = 0) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches; value is the group. Texts without guard aren't scanned."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    skips = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(skips, 1, F.size(skips) - 1).alias("skip"), F.transform(whole, F.length).alias("size"), value.alias("value"))

    def placed(block: Column, base: Column) -> Column:
        def at(row: Column, k: Column) -> Column:
            first = base + F.aggregate(F.slice(block, 1, k), F.lit(0), lambda acc, r: acc + r["skip"] + r["size"]) + row["skip"]
            return let(first, lambda first: F.struct(F.lit(kind).alias("kind"), first.alias("start"), (first + row["size"]).alias("end"), row["value"].alias("value")))

        return F.transform(block, at)

    def blocks(rows: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK)), lambda k: F.slice(rows, k, BLOCK))
        return let(cut, based)

    def based(cut: Column) -> Column:
        sums = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda acc, r: acc + r["skip"] + r["size"]))
        return let(sums, lambda sums: F.flatten(F.transform(cut, lambda b, k: placed(b, _sum(F.slice(sums, 1, k))))))

    spans = let(rows, lambda rows: F.when(F.size(rows) > 0, blocks(rows)).otherwise(no_spans()))
    return F.when(F.coalesce(guard, F.lit(False)), spans).otherwise(no_spans())


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """kind:start:end of the spans, comma-joined, by kind as listed and start, or the other way round."""
    order = F.array(*[F.lit(k) for k in kinds])

    def key(s: Column) -> Column:
        kind = F.array_position(order, s["kind"]).cast("int").alias("k")
        place = s["start"].alias("s")
        text = F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")
        return F.struct(kind, place, s["end"].alias("e"), text) if kind_first else F.struct(place, kind, s["end"].alias("e"), text)

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: s["t"]), ",")


def apart(span: Column, others: Column) -> Column:
    """Whether the span overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (o["end"] > span["start"]))


def replaced(text: Column, spans: Column, replacement) -> Column:
    """The text with each span replaced by replacement(span); of overlapping spans, what an earlier one leaves."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(before, replacement(s))).alias("parts"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        )

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
