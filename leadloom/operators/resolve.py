"""Entity resolution of leads: keys, review pairs, folds, components, upsert."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.contact import host, phone_key, registrable_domain, subdomain
from leadloom.functions.text import company_key_text, filled, key_text
from leadloom.storage import materialize

KEYS = ["k_phone", "k_name_city", "k_name_addr", "k_host"]


def _place() -> Column:
    return key_text(F.coalesce("city", F.lit("")))


def with_keys(leads: DataFrame) -> DataFrame:
    """Adds the matching keys, null where a lead has none."""
    name = company_key_text(F.col("company_name"))
    street = F.array_join(F.slice(F.filter(F.split(key_text(F.col("address")), " "), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$")), 1, 2), " ")
    words = F.array_sort(F.filter(F.split(name, " "), lambda t: t != ""))
    return (
        leads.withColumn("k_phone", phone_key(filled(F.col("phone"))))
        .withColumn("k_name_city", F.when((F.length(name) >= 3) & (F.length(_place()) >= 2), F.concat_ws("|", name, _place())))
        .withColumn("k_name_addr", F.when((F.length(name) >= 3) & (street != ""), F.concat_ws("|addr:", name, street)))
        .withColumn("k_host", host(filled(F.col("website"))))
        .withColumn("k_sorted", F.when((F.size(words) >= 2) & (F.length(_place()) >= 2), F.concat_ws("|", F.array_join(words, " "), _place())))
        .withColumn("k_domain", registrable_domain(filled(F.col("website"))))
    )


def canonical_key(keyed: DataFrame) -> DataFrame:
    """Adds dedup_key: the first key that a lead has, tagged, in the store's order."""
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(k[2:] + ":"), F.col(k))) for k in KEYS]
    return keyed.withColumn("dedup_key", F.coalesce(*tagged))


def aliases(keyed: DataFrame) -> DataFrame:
    """(seq, key_type, alias): every key of every lead."""
    rows = F.array(*[F.struct(F.lit(k[2:]).alias("key_type"), F.col(k).alias("alias")) for k in KEYS])
    return keyed.select("seq", F.explode(rows).alias("a")).select("seq", "a.*").filter("alias is not null")


def review_pairs(keyed: DataFrame) -> DataFrame:
    """(rule, key, existing, incoming): pairs to look at, each against the first lead of its key; never merged. Meant for
    leads that no exact key has merged; the first of a key is an aggregate, so a hot key is no group in one task."""

    def against_first(key: str, rule: str) -> DataFrame:
        rows = keyed.filter(F.col(key).isNotNull())
        first = rows.groupBy(key).agg(F.min_by(F.struct("seq", "k_name_city", "website"), "seq").alias("f"))
        rows = rows.join(first, key)
        return rows.filter((F.col("seq") != F.col("f.seq")) & ~F.col("k_name_city").eqNullSafe(F.col("f.k_name_city"))).withColumn("rule", F.lit(rule)).withColumn("key", F.col(key))

    words = against_first("k_sorted", "token_sort_name_city")
    sites = against_first("k_domain", "shared_registrable_host")
    own, first = subdomain(F.regexp_replace("website", r"//www\.", "//")), subdomain(F.regexp_replace("f.website", r"//www\.", "//"))
    sites = sites.filter(~F.coalesce((own != "") & (first != "") & (own != first), F.lit(False)))
    return words.unionByName(sites).select("rule", "key", F.col("f.seq").alias("existing"), F.col("seq").alias("incoming"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edge table (a, b) reaches; rounds of large and small stars."""
    edges = materialize(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        edges = materialize(small, "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def components(keyed: DataFrame) -> DataFrame:
    """(seq, entity): leads that share any key, directly or through others, have one entity, its smallest seq.

    Each key links its leads to the first of them, so a hot key makes as many links as it has leads.
    """
    each = materialize(aliases(keyed), "aliases")
    first = each.groupBy("key_type", "alias").agg(F.min("seq").alias("first"))
    roots = connected(each.join(first, ["key_type", "alias"]).select("seq", "first"))
    return keyed.select("seq").join(roots, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("root", "seq").alias("entity"))


def merge_components(keyed: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """One lead for each entity: of each column the first value by seq that isn't empty; sources are united."""
    rows = keyed.join(found, "seq")
    first = [F.min_by(filled(F.col(c)), F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("seq"))).alias(c) for c in columns]
    return rows.groupBy("entity").agg(F.count("*").alias("merged"), *first, F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


FOLD = ["seq", "company_name", "city", "address", "phone", "website", "email", "source", *KEYS]
#: Rows of a batch that are Python objects at a time.
FOLD_ROWS = 2048


class Fold:
    """The greedy ordered rule, a lead at a time: a lead joins the first earlier lead that any of its keys names, in the
    order of KEYS; otherwise it is kept. A merged lead lends its missing keys, which then name the kept one.

    Held are the keys seen and those of the kept leads, never the rows that were merged into them.
    """

    def __init__(self) -> None:
        self.index: list[dict[str, int]] = [{} for _ in KEYS]
        self.kept: dict[int, list[str | None]] = {}

    def add(self, seq: int, keys: list[str | None]) -> int:
        """The seq of the lead that this one is merged into, or its own."""
        found = next((own[k] for own, k in zip(self.index, keys, strict=True) if k and k in own), None)
        if found is None:
            found = seq
            self.kept[seq] = keys
        have = self.kept[found] = [h or k for h, k in zip(self.kept[found], keys, strict=True)]
        for own, k in zip(self.index, have, strict=True):
            if k:
                own[k] = found
        return found


def fold(group: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """(seq, kept seq) of the leads of one component."""
    rule = Fold()
    for lead in group.sort_values("seq")[["seq", *KEYS]].to_dict("records"):
        yield lead["seq"], rule.add(lead["seq"], [None if lead[k] != lead[k] else lead[k] for k in KEYS])


def dedupe_ordered(keyed: DataFrame) -> DataFrame:
    """(seq, kept): the greedy fold, run on each component by itself, as leads of different components share no key.

    A component's leads come sorted and batch by batch, so its task holds its keys and kept leads, not its rows.
    """
    blocks = keyed.select("seq", *KEYS).join(components(keyed), "seq").select("entity", "seq", *KEYS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, rule = None, Fold()
        for batch in batches:
            for at in range(0, batch.num_rows, FOLD_ROWS):
                part, kept = batch.slice(at, FOLD_ROWS), []
                own, seqs, *keys = (c.to_pylist() for c in part.columns)
                for e, seq, *k in zip(own, seqs, *keys, strict=True):
                    if e != entity:
                        entity, rule = e, Fold()
                    kept.append(rule.add(seq, k))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(kept, pa.int64())], ["seq", "kept"])

    return blocks.repartition("entity").sortWithinPartitions("entity", "seq").mapInArrow(run, "seq bigint, kept bigint")


def upsert(store: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The store after the incoming rows: present values stay, missing ones are filled, new keys are added, keyless rows are refused."""
    latest = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(filled(F.col(c)), F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("seq"))).alias(c) for c in columns])
    old = store.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("known"))
    both = old.join(latest, key, "full_outer")
    state = F.when(F.col("known").isNull(), "inserted").otherwise("kept")
    return both.select(key, *[F.coalesce(filled(F.col(f"old_{c}")), F.col(c)).alias(c) for c in columns], state.alias("state"))


def novel(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Leads none of whose keys is known."""
    seen = aliases(keyed).join(aliases(known).select("key_type", "alias").distinct(), ["key_type", "alias"], "left_semi").select("seq").distinct()
    return keyed.join(seen, "seq", "left_anti")
