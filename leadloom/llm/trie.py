"""Prefix trie of conversations, by MSD radix partitioning over dictionary-encoded turn ids.

A turn (role, text) becomes a 64-bit id, a seeded hash whose seed is one under which no two turns of the table
share an id (checked by an aggregate over SHA-256 digests; another seed is taken until it holds). A conversation is
then one row of ids and text lengths. Equal sequences are folded to one class first, so copies cost nothing later.

A bucket holds the classes that share a prefix. While a bucket has more ids left than LOCAL_IDS, Spark deals its
classes by their next id, jumps over what all classes of the new bucket share, and emits the nodes passed; this
repeats for the buckets that are still large, and each round is written to the shared folder. Smaller buckets are
finished in tasks, many a task, by multikey quicksort, which emits nodes while it recurses. The totals of
subtrees go up from finished buckets to all large ones above by one aggregate.

The digests of conversations that end in a node need all their ids in order: ids are range-partitioned by (class,
id), joined to pieces of PIECE ids inside tasks, and only the pieces of a class meet, as a stream.

Defined cases: turns in order of turn (null first), then role, then the turn's id in the dictionary, so ties and
repeated rows have a fixed order; null role or text is empty; rows without a conv_id belong to no conversation and
are left out; an empty table has no nodes, not even a root. Remainders keep the dividend's sign, as in SQL.
A conversation's ids, not its texts, are one row: 12 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import materialize, read_table, whole_groups

#: Ids left in a bucket that a task finishes; ids of conversations in a piece of text for a digest.
LOCAL_IDS, PIECE = 1 << 18, 4096
#: Conversations c - c % GROUP lend up to HEADS - 1 first turns.
GROUP, HEADS = 100, 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NAMES = [c.split()[0] for c in NODE.split(", ")]


def encode_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, id, size): turns with their ids and the code points of their texts."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = turns.select("conv_id", "turn", "role", F.length("text").alias("size"), whole.alias("whole"))
    seed = 0
    while True:
        coded = turns.withColumn("id", F.xxhash64("whole", F.lit(seed)))
        coded = materialize(coded.select("conv_id", "turn", "role", "id", "size", F.unhex(F.sha2("whole", 256)).alias("digest")), "turns")
        if coded.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").isEmpty():
            return coded.drop("digest")
        seed += 1


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes) of each conversation with the first turns of its group's first one in front."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size")))
    own = turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("t"))
    own = materialize(own, "conversations")
    heads = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<id:bigint,size:int>>")), F.lit(1), F.col("h"))
    rest = F.slice("t", F.col("h") + 1, F.size("t"))
    return both.select("conv_id", F.concat(head, rest).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def end_digests(members: DataFrame) -> DataFrame:
    """(class, ends): SHA-256 of the class's conversations, ascending and comma-joined; no class is held by a task."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, held))])], ["class", "first", "text"])

        for batch in batches:
            for k, c in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (k != key or len(held) >= PIECE):
                    yield out()
                    held = []
                if not held:
                    key, first = k, c
                held.append(c)
        if held:
            yield out()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if sha is not None and k != key:
                    done.append((key, sha.hexdigest()))
                    sha = None
                if sha is None:
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["class", "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["class", "ends"])

    spread = members.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")
    some = spread.mapInArrow(pieces, "class binary, first bigint, text string")
    return some.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digest, "class binary, ends string")


def fold(rebuilt: DataFrame) -> DataFrame:
    """(class, ids, sizes, n, conv, ends): one row for each different sequence, with its count, least conversation and digest."""
    key = F.unhex(F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256))
    rows = materialize(rebuilt.withColumn("class", key), "rebuilt")
    classes = rows.groupBy("class").agg(F.min(F.struct("ids", "sizes")).alias("s"), F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    return classes.join(end_digests(rows), "class").select("class", "s.ids", "s.sizes", "n", "conv", "ends")


def _finish(rows: list[tuple[list[int], list[int], int, int, str]], depth: int, parent: int) -> tuple[list[list], tuple[int, int]]:
    """Nodes below a prefix of so many turns, of classes (ids, sizes, n, conv, ends) that share the next turn, by multikey quicksort.

    Gives the nodes' columns, parents before children, and (leaves, saved) of the topmost node.
    """
    conv, deep, above, count, children, leaves, saved, ends, up = [], [], [], [], [], [], [], [], []

    def node(members: list, d: int, parent_conv: int, parent_place: int) -> int:
        if len(members) == 1:
            n, least = members[0][2], members[0][3]
        else:
            n, least = sum(m[2] for m in members), min(m[3] for m in members)
        last = members[0][1][d - 1]
        conv.append(least), deep.append(d), above.append(parent_conv), count.append(n), children.append(0)
        leaves.append(0), saved.append((n - 1) * last), ends.append(EMPTY_SHA), up.append(parent_place)
        if parent_place >= 0:
            children[parent_place] += 1
        return len(conv) - 1

    todo = [(rows, depth, parent, -1)]  # classes, turns they share, the node of that prefix
    while todo:
        group, d, parent_conv, place = todo.pop()
        while True:
            if len(group) == 1:  # a chain to the end
                ids, _, _, _, sha = group[0]
                while d < len(ids):
                    d += 1
                    place = node(group, d, parent_conv, place)
                    parent_conv = conv[place]
                ends[place] = sha
                break
            pivot = group[len(group) // 2][0][d]
            less = [g for g in group if g[0][d] < pivot]
            more = [g for g in group if g[0][d] > pivot]
            if less:
                todo.append((less, d, parent_conv, place))
            if more:
                todo.append((more, d, parent_conv, place))
            same = [g for g in group if g[0][d] == pivot] if less or more else group
            d += 1
            place = node(same, d, parent_conv, place)
            parent_conv = conv[place]
            group = [g for g in same if len(g[0]) > d]
            if len(group) < len(same):  # at most one class ends here
                ends[place] = next(g[4] for g in same if len(g[0]) == d)
            if not group:
                break
    for k in range(len(conv) - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    return [conv, deep, above, count, children, leaves, saved, ends], (leaves[0], saved[0])


def _local(rows: DataFrame) -> DataFrame:
    """NODE and bucket (of the topmost node, else null) for small groups of (bucket, next)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["bucket", "next"]):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(a, b - a).to_pydict()
                columns, _ = _finish(list(zip(part["ids"], part["sizes"], part["n"], part["conv"], part["ends"], strict=True)), part["depth"][0], part["above"][0])
                size = len(columns[0])
                arrays = [pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(_NAMES, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part["bucket"][0]] + [None] * (size - 1), pa.int64())], [*_NAMES, "bucket"])

    wanted = rows.select("bucket", "next", "depth", "above", "ids", "sizes", "n", "conv", "ends")
    return wanted.repartition("bucket", "next").sortWithinPartitions("bucket", "next").mapInArrow(run, f"{NODE}, bucket bigint")


def build_trie(classes: DataFrame, local_ids: int = LOCAL_IDS) -> DataFrame:
    """NODE of every prefix of the classes' sequences."""
    spark = classes.sparkSession
    # A large bucket is the node where its classes part: depth turns shared, reached from depth start of the bucket above.
    root = classes.agg(F.min("conv").alias("conv"), F.sum("n").alias("n")).filter("conv is not null")
    root = root.select(F.lit(0).cast("bigint").alias("bucket"), F.array(F.lit(0).cast("bigint")).alias("path"), F.lit(0).alias("start"), F.lit(0).alias("depth"), "conv", "n", F.lit(None).cast("bigint").alias("above"), F.array().cast("array<int>").alias("sizes"))
    large, local, ended = [materialize(root, "buckets")], [], []
    state = classes.select(F.lit(0).cast("bigint").alias("bucket"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("above"), "ids", "sizes", "n", "conv", "ends")
    state = state.join(large[0].select("bucket", F.col("conv").alias("top")), "bucket").withColumn("above", F.col("top")).drop("top")
    turn = 0
    while True:
        turn += 1
        state = materialize(state, "trie-state")
        ended.append(state.filter(F.size("ids") == F.col("depth")).select("bucket", "ends"))
        going = state.filter(F.size("ids") > F.col("depth")).withColumn("next", F.get("ids", F.col("depth")))
        left = F.sum(F.size("ids") - F.col("depth"))
        big = going.groupBy("bucket", "next").agg(left.alias("left"), F.count("*").alias("classes"), F.min("conv").alias("b_conv"), F.sum("n").alias("b_n"), F.min(F.struct("conv", "ids", "sizes")).alias("pivot"))
        big = big.filter((F.col("left") > local_ids) & (F.col("classes") > 1))
        big = materialize(big.withColumn("b", F.monotonically_increasing_id() + F.lit(turn << 56)).select("bucket", "next", "b", "b_conv", "b_n", F.col("pivot.ids").alias("p_ids"), F.col("pivot.sizes").alias("p_sizes")), "large")
        if big.isEmpty():
            local.append(going)
            break
        # AQE broadcasts the large buckets while they are small and splits what is skewed where they are not.
        met = going.join(big.select("bucket", "next", "b"), ["bucket", "next"], "left")
        met = materialize(met, "dealt")
        local.append(met.filter("b is null").drop("b"))
        inside = met.filter("b is not null").join(big.select("b", "p_ids"), "b")
        differ = F.array_position(F.zip_with("ids", "p_ids", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        common = F.when(differ == 0, F.size("ids")).otherwise(differ - 1).cast("int")
        shared = materialize(inside.groupBy("b").agg(F.min(common).alias("to")), "shared")
        above = large[-1].select("bucket", "path", F.col("depth").alias("start"), F.col("conv").alias("above"))
        fresh = big.join(shared, "b").join(above, "bucket").select(
            F.col("b").alias("bucket"), F.concat("path", F.array("b")).alias("path"), "start", F.col("to").alias("depth"), F.col("b_conv").alias("conv"), F.col("b_n").alias("n"), "above", F.slice("p_sizes", F.lit(1), F.col("to")).alias("sizes")
        )
        large.append(materialize(fresh, "buckets"))
        now = large[-1].select("bucket", F.col("depth").alias("to"), F.col("conv").alias("top"))
        state = met.filter("b is not null").drop("bucket").withColumnRenamed("b", "bucket").join(now, "bucket").select("bucket", F.col("to").alias("depth"), F.col("top").alias("above"), "ids", "sizes", "n", "conv", "ends")
    small = local[0]
    for more in local[1:]:
        small = small.unionByName(more.select(*small.columns))
    below = materialize(_local(small), "nodes-below")
    buckets, ends = large[0], ended[0]
    for more in large[1:]:
        buckets = buckets.unionByName(more)
    for more in ended[1:]:
        ends = ends.unionByName(more)
    return below.select(*_NAMES).unionByName(_above(spark, buckets, ends, below).select(*_NAMES))


def _above(spark: SparkSession, buckets: DataFrame, ends: DataFrame, below: DataFrame) -> DataFrame:
    """NODE of the large buckets and of the turns between them."""
    tops = below.filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kids = buckets.filter(F.size("path") > 1).groupBy(F.element_at("path", -2).alias("bucket")).agg(F.count("*").alias("big_kids"))
    # What a bucket's own chain of turns (start + 1 .. depth) saves, its last turn included.
    own = F.aggregate(F.slice("sizes", F.col("start") + 1, F.col("depth") - F.col("start")), F.lit(0).cast("bigint"), lambda a, s: a + s) * (F.col("n") - 1)
    full = buckets.withColumn("own", own).join(tops, "bucket", "left").join(kids, "bucket", "left").join(ends, "bucket", "left").na.fill(0, ["kids", "leaves", "saved", "big_kids"])
    full = materialize(full, "large-buckets")
    totals = full.select(F.explode("path").alias("a"), "bucket", "leaves", "saved", "own").groupBy("a").agg(
        F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("below"), F.sum(F.when(F.col("a") != F.col("bucket"), F.col("own")).otherwise(0)).alias("inner")
    )
    rows = full.join(totals.withColumnRenamed("a", "bucket"), "bucket")
    # From the chain's last turn upwards each turn adds its own saving.
    step = F.explode(F.when(F.col("depth") > F.col("start"), F.sequence(F.col("start") + 1, F.col("depth"))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("d", step)
    last = F.col("d") == F.col("depth")
    tail = F.aggregate(F.slice("sizes", F.greatest("d", F.lit(1)), F.col("depth") - F.col("d") + F.when(F.col("d") > 0, 1).otherwise(0)), F.lit(0).cast("bigint"), lambda a, s: a + s)
    n_children = F.when(last, F.col("kids") + F.col("big_kids")).otherwise(1)
    alone = (F.col("d") == 0) & (F.col("kids") + F.col("big_kids") == 0)  # a root without turns
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("d").cast("bigint").alias("depth"), F.when(F.col("d") == 0, None).when(F.col("d") == F.col("start") + 1, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), n_children.cast("bigint").alias("n_children"), F.when(alone, 1).otherwise(F.col("all_leaves")).cast("bigint").alias("n_leaves"),
        (F.col("below") + F.col("inner") + tail * (F.col("n") - 1)).cast("bigint").alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, local_ids: int = LOCAL_IDS) -> DataFrame:
    """NODE of every distinct prefix of the rebuilt conversations, the textless root included."""
    return build_trie(materialize(fold(rebuild(encode_turns(conversations))), "classes"), local_ids)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP12_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, l, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256])),
  lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 6 AS h FROM own),
re AS (SELECT c.conv_id, list_concat(coalesce(b.l[:c.h], []), c.l[c.h + 1:]) AS l FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d, len(l) AS n, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS size, sha256(to_json(l[:d])::VARCHAR) AS k FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM re)),
nodes AS (SELECT k, d, min(conv_id) AS conv, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM p GROUP BY k, d),
links AS (SELECT a.k, b.k AS up FROM nodes a JOIN p b ON b.conv_id = a.conv AND b.d = a.d - 1),
kids AS (SELECT up AS k, count(*) AS c FROM links GROUP BY up),
full_ AS (SELECT n.*, coalesce(c, 0) AS c FROM nodes n LEFT JOIN kids USING (k)),
tot AS (SELECT b.k, sum(CASE WHEN f.c = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.size) AS saved FROM full_ f JOIN p b ON b.conv_id = f.conv AND b.d <= f.d GROUP BY b.k)
SELECT f.conv AS conv_id, f.d::BIGINT AS depth, u.conv AS parent_conv_id, f.n AS n_convs, f.c AS n_children, tot.leaves::BIGINT AS n_leaves, tot.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN tot USING (k) LEFT JOIN links ON links.k = f.k LEFT JOIN nodes u ON u.k = links.up"""
