"""Embedding near-duplicates by NN-descent.

A neighbour list of k entries for each distinct vector starts from random-projection tables and is refined by
local joins: the neighbours and reverse neighbours of a vector are compared with each other, because a
neighbour's neighbour is likely a neighbour. A join compares only pairs with an entry that the last round
brought in. Edges at or above the threshold give the link components. Lists in which every entry is a link
are saturated; lists are then enlarged to their whole component, in blocks of bounded size that send on
counts, never pairs, so a dense group of any size gets all its links. A saturated list also hides links to other
components, but only to saturated vectors, since any other list would show the link from its side. So the saturated
vectors of a component lie within an angle of one of them, its pivot; components whose pivots are farther apart than
both angles and the threshold's can't be linked (triangle inequality), and the rest meet in blocks. A sample of
vectors, as many of each size of component, is compared with all rows after each round; further rounds with fresh
tables follow until the audited recall, the mean over vectors, is reached. Each round has larger cells, in which more
rows are compared, and longer lists; in the end a cell is a whole label, whose rows meet batch by batch. If the audit
misses its target even then, the search raises: it never returns with links lost in silence.

Equal vectors with equal labels are one node with a multiplicity.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, have no links; vectors of different lengths are never compared; repeated ids are separate rows; a row
with a null id takes part, and a component's id is its smallest non-null id (a row without links: its own id).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import materialize, read_table, whole_groups
from leadloom.llm.components import components

THRESHOLD, LIST_SIZE, TABLES, SCAN, ROUNDS, BLOCK, AUDIT_ROWS, AUDIT_RECALL = 0.98, 10, 8, 8, 2, 512, 100, 0.97


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows in double precision from equally long vectors stored as float64 bytes."""
    data = column.to_pylist()
    rows = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: rid, id, node or null; nodes: node, grp, vec, copies)."""
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("rid")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("v", F.when(ok, F.col("v"))), "vectors")
    nodes = rows.filter("v is not null").groupBy("label", "v").agg(F.min("rid").alias("node"), F.count("*").alias("copies"))
    grp = F.xxhash64(F.col("label").cast("string"), F.size("v"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.asarray(v, "<f8").tobytes() for v in b.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vecs, pa.binary()), b.column(3)], ["node", "grp", "vec", "copies"])

    nodes = nodes.select("node", grp.alias("grp"), "v", "copies").mapInArrow(pack, "node bigint, grp bigint, vec binary, copies bigint")
    return rows, materialize(nodes, "nodes")


def _start(nodes: DataFrame, bits: int, tables: int, seed: int, scan: int, keep: int) -> DataFrame:
    """(a, b, sim): for each table the best few of the next rows in the same cell, in the order of a projection."""

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[int, list[int]] = {}
            for k, v in enumerate(batch.column("vec").to_pylist()):
                groups.setdefault(len(v), []).append(k)
            for size, members in groups.items():
                part = batch.take(pa.array(members))
                unit = _matrix(part.column("vec"))
                rng = np.random.default_rng([seed, size])
                for t in range(tables):
                    side = unit @ rng.standard_normal((unit.shape[1], bits + 1))
                    cell = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64) * tables + t
                    yield pa.RecordBatch.from_arrays([part.column("grp"), pa.array(cell), pa.array(side[:, bits]), part.column("node"), part.column("vec")], ["grp", "cell", "at", "node", "vec"])

    dealt = nodes.select("node", "grp", "vec").mapInArrow(cells, "grp bigint, cell bigint, at double, node bigint, vec binary")
    # Ranges cut a large cell wherever it lies along the projection; at a cut only a few pairs of one table are lost.
    dealt = dealt.repartitionByRange("grp", "cell", "at").sortWithinPartitions("grp", "cell", "at")

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, cell, node = (batch.column(c).to_numpy() for c in ("grp", "cell", "node"))
            for lo, hi in _even(batch.column("vec")):
                unit = _matrix(batch.column("vec").slice(lo, hi - lo))
                g, c, ids = grp[lo:hi], cell[lo:hi], node[lo:hi]
                reach = min(scan, hi - lo - 1)  # no more rows follow in the batch
                sims = np.full((hi - lo, reach), -2.0)
                for s in range(1, reach + 1):
                    same = (g[s:] == g[:-s]) & (c[s:] == c[:-s])
                    sims[: hi - lo - s, s - 1] = np.where(same, (unit[s:] * unit[:-s]).sum(axis=1), -2.0)
                best = np.argsort(-sims, axis=1)[:, :keep]
                a = np.repeat(np.arange(hi - lo), best.shape[1])
                b = a + best.ravel() + 1
                sim = np.take_along_axis(sims, best, 1).ravel()
                ok = sim > -2
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.array(sim[ok])], ["a", "b", "sim"])

    return dealt.mapInArrow(near, "a bigint, b bigint, sim double")


def _even(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose vectors have one length."""
    size = pc.binary_length(column).to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(size)) + 1, [len(size)]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, sim, new): the k best neighbours of each node from pairs (a, b, sim, new) read in both directions."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new"))
    one = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _refine(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round: the graph after the local join of every node's neighbours and reverse neighbours."""
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    back = back.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    around = graph.unionByName(back).groupBy("a", "b").agg(F.max("new").alias("new"))
    members = around.join(nodes.select(F.col("node").alias("b"), "vec"), "b").join(worst.withColumnRenamed("a", "b"), "b", "left")
    members = members.select(F.col("a").alias("center"), F.col("b").alias("node"), "vec", "new", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    members = members.repartition("center").sortWithinPartitions("center")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["center"]):
            node, new, worst_ = rows.column("node").to_numpy(), rows.column("new").to_numpy(), rows.column("worst").to_numpy()
            vec = rows.column("vec")
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2 or not new[lo:hi].any():
                    continue
                unit = _matrix(vec.slice(lo, hi - lo))
                sim = unit @ unit.T
                w, n = worst_[lo:hi], new[lo:hi].astype(bool)
                better = np.triu((sim > np.minimum(w[:, None], w[None, :])) & (n[:, None] | n[None, :]), 1)
                a, b = np.nonzero(better)
                found.append((node[lo:hi][a], node[lo:hi][b], sim[a, b]))
            if found:
                a, b, sim = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], ["a", "b", "sim"])

    fresh = members.mapInArrow(join, "a bigint, b bigint, sim double").withColumn("new", F.lit(1))
    return _lists(graph.withColumn("new", F.lit(0)).unionByName(fresh), k)


def _counts(nodes: DataFrame, roots: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, n): linked rows of each node among the other nodes of its component, by blocks of the component."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = roots.join(sizes, "root").join(nodes, "node")
    own = own.withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = own.select("root", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), "c", "node", "vec", "copies")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["root", "x", "y"]):
            node, copies, vec = rows.column("node").to_numpy(), rows.column("copies").to_numpy(), rows.column("vec")
            c, x, y = (rows.column(k).to_numpy() for k in ("c", "x", "y"))
            total = np.zeros(len(node), np.int64)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                unit = _matrix(vec.slice(lo, hi - lo))
                near = unit @ unit.T >= threshold
                np.fill_diagonal(near, False)
                if x[lo] != y[lo]:
                    near &= c[lo:hi, None] != c[None, lo:hi]
                total[lo:hi] = near @ copies[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "n"])

    return dealt.mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def _full(graph: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float, k: int) -> DataFrame:
    """(root, grp, node, vec, copies) of the nodes whose k entries are all links."""
    full = graph.filter(F.col("sim") >= threshold).groupBy(F.col("a").alias("node")).count().filter(F.col("count") >= k).select("node")
    return materialize(roots.join(full, "node").join(nodes, "node").select("root", "grp", "node", "vec", "copies"), "saturated")


def _near_components(full: DataFrame, threshold: float, chunk: int = 1024) -> DataFrame:
    """(a, b): components whose saturated nodes may be linked, by the angles around a pivot of each."""
    pivot = materialize(full.groupBy("root", "grp").agg(F.min_by("vec", "node").alias("pivot")), "pivots")
    few = pivot.count() <= 10 * chunk
    own = full.select("root", "vec").join(F.broadcast(pivot.select("root", "pivot")) if few else pivot.select("root", "pivot"), "root")

    def angles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _even(batch.column("vec")):
                cos = (_matrix(batch.column("vec").slice(lo, hi - lo)) * _matrix(batch.column("pivot").slice(lo, hi - lo))).sum(axis=1) if hi > lo else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("root").slice(lo, hi - lo), pa.array(np.arccos(np.clip(cos, -1, 1)))], ["root", "angle"])

    wide = own.select("root", "vec", "pivot").mapInArrow(angles, "root bigint, angle double").groupBy("root").agg(F.max("angle").alias("angle"))
    wide = materialize(pivot.join(wide, "root"), "angles")
    sizes = wide.groupBy("grp").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    dealt = wide.join(sizes, "grp").withColumn("c", F.pmod(F.xxhash64("root"), F.col("n")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("grp", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), "root", "pivot", "angle")
    dealt = dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    reach = math.acos(threshold) + 1e-6

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["grp", "x", "y"]):
            root, angle = rows.column("root").to_numpy(), rows.column("angle").to_numpy()
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                unit = _matrix(rows.column("pivot").slice(lo, hi - lo))
                apart = np.arccos(np.clip(unit @ unit.T, -1, 1))
                a, b = np.nonzero(np.triu(apart <= angle[lo:hi, None] + angle[None, lo:hi] + reach, 1))
                yield pa.RecordBatch.from_arrays([pa.array(root[lo:hi][a]), pa.array(root[lo:hi][b])], ["a", "b"])

    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()


def _across(graph: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float, k: int, block: int) -> DataFrame:
    """(node, n, a, b): of links between components the count for a node (a, b null), and the pairs of components (node, n null)."""
    full = _full(graph, nodes, roots, threshold, k)
    wide = components(_near_components(full, threshold)).select(F.col("node").alias("root"), F.col("root").alias("area"))
    own = materialize(full.join(wide, "root"), "areas")
    sizes = own.groupBy("area").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = own.join(sizes, "area").withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = own.select("area", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), "c", "root", "node", "vec", "copies")
    dealt = dealt.repartition("area", "x", "y").sortWithinPartitions("area", "x", "y")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["area", "x", "y"]):
            c, x, y, root, node, copies = (rows.column(name).to_numpy() for name in ("c", "x", "y", "root", "node", "copies"))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                unit = _matrix(rows.column("vec").slice(lo, hi - lo))
                r = root[lo:hi]
                near = (unit @ unit.T >= threshold) & (r[:, None] != r[None, :])
                if x[lo] != y[lo]:
                    near &= c[lo:hi, None] != c[None, lo:hi]
                n = near @ copies[lo:hi]
                some = np.flatnonzero(n)
                i, j = np.nonzero(np.triu(near, 1))
                pairs = np.unique(np.stack([r[i], r[j]], axis=1), axis=0)
                none = lambda m: pa.nulls(m, pa.int64())
                columns = [[pa.array(node[lo:hi][some]), none(len(pairs))], [pa.array(n[some]), none(len(pairs))], [none(len(some)), pa.array(pairs[:, 0])], [none(len(some)), pa.array(pairs[:, 1])]]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in columns], ["node", "n", "a", "b"])

    return materialize(dealt.mapInArrow(count, "node bigint, n bigint, a bigint, b bigint"), "across")


def _audit(nodes: DataFrame, counts: DataFrame, roots: DataFrame, threshold: float, rows: int) -> float:
    """Found share of a node's links, the mean over a sample with as many nodes of each size of component, against all rows.

    The sample grows with the root of the number of nodes."""
    rows = max(rows, math.isqrt(nodes.count()))
    sizes = roots.groupBy("root").agg(F.floor(F.log2(F.count("*"))).alias("level"))
    known = nodes.join(counts, "node", "left").join(roots.join(sizes, "root").select("node", "level"), "node", "left")
    known = known.select("node", "grp", "vec", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("level", F.lit(-1)).alias("level"))
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.xxhash64("node"), "node"))
    each = math.ceil(rows / max(1, sizes.select("level").distinct().count() + 1))
    sample = known.withColumn("place", place).filter(F.col("place") <= each).select("node", "grp", "vec", "n").collect()
    sent = nodes.sparkSession.sparkContext.broadcast([(r.node, r.grp, bytes(r.vec)) for r in sample])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            grp, node, copies = (batch.column(k).to_numpy() for k in ("grp", "node", "copies"))
            for g in {q[1] for q in sent.value}:
                at = np.flatnonzero(grp == g)
                if len(at):
                    unit = _matrix(batch.column("vec").take(pa.array(at)))
                    asked = [q for q in sent.value if q[1] == g]
                    near = _matrix(pa.array([q[2] for q in asked])) @ unit.T >= threshold
                    for q, hits in zip(asked, near, strict=True):
                        total[q[0]] = total.get(q[0], 0) + int(copies[at][hits & (node[at] != q[0])].sum())
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([*total.values()], pa.int64())], ["node", "n"])

    true = dict(map(tuple, nodes.mapInArrow(scan, "node bigint, n bigint").groupBy("node").agg(F.sum("n")).collect()))
    shares = [min(r.n, true[r.node]) / true[r.node] for r in sample if true.get(r.node)]
    return sum(shares) / len(shares) if shares else 1.0


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    k: int = LIST_SIZE,
    tables: int = TABLES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
    audit_rows: int = AUDIT_ROWS,
    recall: float = AUDIT_RECALL,
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of vectors."""
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col)
    largest = nodes.groupBy("grp").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    bits = min(40, max(1, math.ceil(math.log2(max(2, largest) / 8))))
    graph = None
    for turn in itertools.count():
        scan = min(largest, SCAN << 2 * turn)
        fresh = _start(nodes, max(0, bits - 3 * turn), tables, turn, scan, 2 << turn).withColumn("new", F.lit(1))
        k <<= turn > 0
        graph = materialize(_lists(fresh if graph is None else graph.withColumn("new", F.lit(0)).unionByName(fresh), k), "graph")
        for _ in range(rounds):
            graph = materialize(_refine(graph, nodes, k), "graph")
            if graph.filter("new = 1").count() < 0.001 * k * max(1, graph.select("a").distinct().count()):
                break
        roots = materialize(components(graph.filter(F.col("sim") >= threshold).select("a", "b")), "roots")
        counts = materialize(_counts(nodes, roots, threshold, block), "counts")
        across = _across(graph, nodes, roots, threshold, k, block)
        more = components(across.filter("a is not null").select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("whole"))
        roots = materialize(roots.join(more, "root", "left").select("node", F.coalesce("whole", "root").alias("root")), "whole-roots")
        both = counts.unionByName(across.filter("node is not null").select("node", "n"))
        counts = materialize(both.groupBy("node").agg(F.sum("n").alias("n")), "all-counts")
        found_share = _audit(nodes, counts, roots, threshold, audit_rows)
        if found_share >= recall:
            break
        if scan == largest:  # nothing wider is left to try; links must not be lost in silence
            raise RuntimeError(f"the neighbour search found {found_share:.3f} of the audited links, of {recall} wanted")
    found = nodes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    found = found.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = _name_rows(rows, nodes, found)
    lowest = named.filter("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    out = named.join(lowest, "root", "left")
    component = F.coalesce("low", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _name_rows(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_links, root) for each row; null for rows that are not compared."""
    keyed = rows.filter("v is not null").groupBy("label", "v").agg(F.min("rid").alias("node"))
    known = rows.filter("v is not null").join(keyed, ["label", "v"]).join(found, "node")
    return materialize(known.select("id", "n_links", "root").unionByName(rows.filter("v is null").select("id"), allowMissingColumns=True), "named")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: Every pair of one label; only sensible on a small table.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
r AS (SELECT vec_id AS a, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.root) AS component_id, e.vec_id = min(r.root) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id
"""
