"""Similarity clusters by bisecting k-means.

Bisection from one root would be wrong here in a way that later splits cannot
mend: a plane through thousands of unrelated groups cuts many of them. So the
roots are the connected parts of the neighbour graph, whose links hold a
similarity of 0.40 or more by bits that chose none of them or by whole vectors.
They keep groups whole but may chain some together; bisecting k-means then
splits every node that is not compact until every member of every leaf is close
enough to the rest of its leaf, leaves of a root cut apart are joined again, and
members go to the nearest leaf of their root.

All arithmetic is on sign sketches (one bit per random direction), in which the
mean agreement of a vector with a set is linear in the set's sum. A node of any
size is therefore judged from one sum per partition; nodes of up to ``LOCAL``
rows are finished inside a task, larger ones by the same steps in passes over
the cluster. Sums are whole numbers and all ties go to the smaller id, so both
ways give the same clusters and ``LOCAL`` decides only where the work is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.neighbours import (
    ALL_BITS,
    FACE_DIM,
    Graph,
    binary,
    components,
    faces,
    fixed_bytes,
    level,
    linked_parts,
    per_partition,
    runs,
    signs,
)
from lumora.session import cut, discard, parallelism, parts_for, release
from lumora.tables import table

#: Rows of a node that one task may finish.
LOCAL = 4000
#: Assignments of a two-means at most; a node is split by the sides reached then, and judged again.
ROUNDS = 12
#: Rotations of the search: a face whose only partner is never met stays alone for good.
TABLES = 5
#: Nodes whose sums (4 KB each) may be broadcast; beyond, they are joined.
FEW_NODES = 2000
#: Rows and leaves of a root that meet in one task where it is settled over the cluster, and rows of a
#: leaf that one task adds up.
ROW_BLOCK, LEAF_BLOCK, HOT = 8192, 2048, 100_000


def dots(b: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Products of sign vectors with sums of at most ``n`` sign vectors, exact whatever the order of addition."""
    wide = np.float32 if n * ALL_BITS < 1 << 24 else np.float64
    return (b.astype(wide, copy=False) @ total.astype(wide, copy=False)).astype(np.float64)


def mean_agreement(b: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Mean agreement, -1 to 1, of each member with the other members of a set of sum ``total``."""
    if n < 2:
        return np.ones(len(b))
    return (dots(b, total, n) - ALL_BITS) / (ALL_BITS * (n - 1.0))


def nearer_second(b: np.ndarray, c0: np.ndarray, c1: np.ndarray, n: int) -> np.ndarray:
    """Whether each row is nearer to the second of two centres, given as sums of at most ``n`` rows."""
    c0, c1 = c0.astype(np.float64), c1.astype(np.float64)
    return dots(b, c1, n) / np.linalg.norm(c1) > dots(b, c0, n) / np.linalg.norm(c0)


def split_node(b: np.ndarray) -> np.ndarray:
    """Two-means of a node whose rows are in the order of their ids: True for the second part.

    Seeds are the member farthest from the whole and the one farthest from it.
    """
    far = int(np.argmin(dots(b, b.sum(0), len(b))))
    other = int(np.argmin(b @ b[far]))
    c0, c1 = b[other], b[far]
    side = np.zeros(len(b), bool)
    for _ in range(ROUNDS):
        new = nearer_second(b, c0, c1, len(b))
        if new.all() or not new.any():
            new = np.zeros(len(b), bool)
            new[far] = True
        if (new == side).all():
            break
        side = new
        c0, c1 = b[~side].sum(0), b[side].sum(0)
        if not np.any(c0) or not np.any(c1):
            break
    return side


def split_leaves(b: np.ndarray, compact: float) -> np.ndarray:
    """Leaf number of each row of sign vectors in the order of ids, splitting until all leaves are compact.

    A leaf is compact when each member's mean agreement with the others is at
    least ``compact``. Leaves are numbered by their first rows.
    """
    done: list[np.ndarray] = []
    todo = [np.arange(len(b))]
    while todo:
        # the order does not change the leaves
        rows = todo.pop()
        x = b[rows]
        if mean_agreement(x, x.sum(0), len(x)).min() >= compact:
            done.append(rows)
            continue
        side = split_node(x)
        todo += [rows[side], rows[~side]]
    out = np.empty(len(b), np.int64)
    for h, rows in enumerate(sorted(done, key=lambda r: r[0])):
        out[rows] = h
    return out


def close_leaves(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, compact: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves, of sums ``s`` and ``t`` and sizes ``n`` and ``m``, of a mean agreement of at least ``compact``."""
    ii, jj, gg = [], [], []
    for s0 in range(0, len(s), 512):
        g = s[s0 : s0 + 512] @ t.T / (ALL_BITS * n[s0 : s0 + 512, None] * m[None, :])
        i, j = np.nonzero(g >= compact)
        ii.append(i + s0), jj.append(j), gg.append(g[i, j])
    return np.concatenate(ii), np.concatenate(jj), np.concatenate(gg)


def join_leaves(sums: np.ndarray, n: np.ndarray, compact: float) -> np.ndarray:
    """First leaf of the group of each leaf; ``sums`` and ``n`` of first leaves become those of the groups.

    Leaves whose mean mutual agreement is at least ``compact`` are one group
    cut apart, and are joined, the closest first, if that holds for the groups
    they are in by then.
    """
    parent = list(range(len(n)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    i, j, g = close_leaves(sums, n, sums, n, compact)
    i, j, g = (v[i < j] for v in (i, j, g))
    for q in np.lexsort((j, i, -g)):
        u, v = sorted((top(int(i[q])), top(int(j[q]))))
        if u != v and sums[u] @ sums[v] / (ALL_BITS * n[u] * n[v]) >= compact:
            parent[v] = u
            sums[u] += sums[v]
            n[u] += n[v]
    return np.array([top(i) for i in range(len(n))], np.int64)


def nearest_leaf(b: np.ndarray, at: np.ndarray, sums: np.ndarray, n: np.ndarray, compact: float) -> tuple[np.ndarray, np.ndarray]:
    """The leaf with whose other members each row agrees most in the mean, and that mean.

    ``at`` is the row's own leaf, or -1 where that is not among these; a row
    alone in its leaf leaves it for means above ``compact``.
    """
    best, value = np.empty(len(b), np.int64), np.empty(len(b))
    most = int(n.max())
    for r0 in range(0, len(b), 1024):
        own = at[r0 : r0 + 1024, None] == np.arange(len(n))[None, :]
        s = dots(b[r0 : r0 + 1024], sums.T, most) / ALL_BITS
        mean = np.where(own & (n == 1), compact, (s - own) / np.maximum(n - own, 1))
        k = mean.argmax(1)
        best[r0 : r0 + 1024], value[r0 : r0 + 1024] = k, mean[np.arange(len(k)), k]
    return best, value


def bisect(b: np.ndarray, compact: float) -> np.ndarray:
    """Group number of each row of sign vectors in the order of ids: leaves split, joined, and their members moved."""
    leaf = split_leaves(b, compact)
    count = int(leaf.max()) + 1
    if count == 1:
        return leaf
    sums = np.stack([b[leaf == h].sum(0, dtype=np.float64) for h in range(count)])
    n = np.bincount(leaf).astype(float)
    head = join_leaves(sums, n, compact)
    used, at = np.unique(head[leaf], return_inverse=True)
    # a member nearer to another leaf than to its own moves there
    return used[nearest_leaf(b, at, sums[used], n[used], compact)[0]]


_NODE_SUMS = "node long, n long, total binary"


def _sums_out(node: np.ndarray, n: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums as batches of rows (node, n, total)."""
    for s in range(0, len(node), 1024):
        raw = np.ascontiguousarray(total[s : s + 1024], np.int32).view(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(node[s : s + 1024], pa.int64()), pa.array(n[s : s + 1024], pa.int64()), binary(raw)], names=["node", "n", "total"])


def _totals(column: pa.Array) -> np.ndarray:
    """Sums from their binary column."""
    return fixed_bytes(column, 4 * ALL_BITS).view(np.int32)


def node_sums(rows: DataFrame, parts: int) -> DataFrame:
    """(node, n, total) over rows (node, bits): one partial sum per node and partition first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        flush = lambda: _sums_out(*(np.array(v) for v in zip(*done)))
        for b in batches:
            if not b.num_rows:
                continue
            node = b["node"].to_numpy()
            for r, x in _by_node(b):
                if not done or done[-1][0] != node[r[0]]:
                    if len(done) == 256:
                        yield from flush()
                        done = []
                    done.append([node[r[0]], 0, np.zeros(ALL_BITS, np.int32)])
                done[-1][1] += len(r)
                done[-1][2] += x.sum(0).astype(np.int32)
        if done:
            yield from flush()

    def add(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order, ends = runs(t["node"].to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        node, n, total = t["node"].to_numpy()[order], t["n"].to_numpy()[order], _totals(t["total"])
        for s in range(0, len(starts), 1024):
            own = [total[order[a:z]].sum(0, dtype=np.int32) for a, z in zip(starts[s : s + 1024], ends[s : s + 1024])]
            yield from _sums_out(node[starts[s : s + 1024]], np.add.reduceat(n, starts)[s : s + 1024], np.stack(own))

    partial = rows.select("node", "bits").sortWithinPartitions("node").mapInArrow(part, _NODE_SUMS)
    return per_partition(partial, "node", add, _NODE_SUMS, parts)


def leaf_sums(rows: DataFrame, parts: int) -> DataFrame:
    """(node, n, total) over rows (id, node, bits) of many nodes, whose rows are brought together first."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / HOT))
    return node_sums(rows.join(sizes, "node").repartition(parts, F.xxhash64("node", salt)), parts)


def clusters(df: DataFrame, key: str, vector: str, dim: int, compact: float = 0.40, local: int = LOCAL, **search) -> DataFrame:
    """(id, cluster, closeness) for every usable vector.

    ``cluster`` is named by its smallest member; ``closeness`` is the mean
    agreement of the member with the others (1 for a lone one). ``compact`` is
    the mean similarity at which bisection stops, between groups and strangers.
    ``local`` does not change the result.
    Equal vectors are clustered as one and all their ids get a row. Unusable
    vectors have no row; an id counts once; an empty table gives no rows.
    """
    spark = df.sparkSession
    g = linked_parts(df, key, vector, dim, **search)
    sizes = g.parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = cut(g.parts.join(sizes, "root"))
    lone = placed.filter("n = 1").select("id", F.col("id").alias("cluster"), F.lit(1.0).alias("closeness"))
    rows = placed.filter("n > 1").join(g.sketches.select("id", "bits"), "id").select("id", F.col("root").alias("node"), "bits", "n")
    tau = level(compact, ALL_BITS) / ALL_BITS
    parts = parts_for(spark, g.n, 200_000)
    small, large = rows.filter(F.col("n") <= local).select("id", "node", "bits"), rows.filter(F.col("n") > local).select("id", "node", "bits")
    leaves = [cut(_finish(small, tau, parts, bisect))]
    release(spark)
    split = []
    while placed.filter(F.col("n") > local).head(1):  # every round makes two nodes of each that is not compact
        large = cut(large)
        if not large.head(1):
            break
        first = len(leaves) == 1
        done, halves = _bisect_large(large, tau)
        if first:
            leaves.append(done)  # whole parts
        else:
            split.append(done.select("id", F.col("cluster").alias("leaf")))
        n = cut(halves.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
        halves = halves.join(n, "node")
        finished = _finish(halves.filter(F.col("n") <= local).select("id", "node", "bits"), tau, parts, split_leaves)
        split.append(cut(finished.select("id", F.col("cluster").alias("leaf"))))
        large = halves.filter(F.col("n") > local).select("id", "node", "bits")
        release(spark)
    if split:
        leaves.append(_settle(_union(split), g, tau))
    out = cut(_union([lone, *leaves]))
    names = out.groupBy("cluster").agg(F.min("id").alias("name"))
    out = out.join(names, "cluster").select("id", F.col("name").alias("cluster"), "closeness")
    if g.classes is None:
        return out
    copies = g.classes.filter("id <> rep").select(F.col("id").alias("copy"), F.col("rep").alias("id"))
    return out.unionByName(out.join(copies, "id").select(F.col("copy").alias("id"), "cluster", "closeness"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _with_sums(rows: DataFrame, sums: DataFrame, n_nodes: int) -> DataFrame:
    """``rows`` with what is known of their nodes: broadcast where the number of nodes is small, or joined."""
    return rows.join(F.broadcast(sums) if n_nodes <= FEW_NODES else sums, "node")


def _by_node(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and sign vectors of the rows of each node of a batch."""
    x = signs(fixed_bytes(b["bits"], ALL_BITS // 8))
    order, ends = runs(b["node"].to_numpy())
    start = 0
    for e in ends:
        r = order[start:e]
        start = e
        yield r, x[r]


def _closeness(rows: DataFrame, sums: DataFrame, n_nodes: int) -> DataFrame:
    """``rows`` with the mean agreement of each with the others of its node."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, n, total = np.empty(b.num_rows), b["n"].to_numpy(), _totals(b["total"])
            for r, x in _by_node(b):
                v[r] = mean_agreement(x, total[r[0]], int(n[r[0]]))
            yield pa.RecordBatch.from_arrays([b["id"], b["node"], b["bits"], pa.array(v)], names=["id", "node", "bits", "closeness"])

    cols = _with_sums(rows, sums, n_nodes).select("id", "node", "bits", "n", "total")
    return cols.mapInArrow(score, "id long, node long, bits binary, closeness double")


def _bisect_large(rows: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    """Compact nodes of ``rows`` (id, node, bits) as leaves, and the halves of all others as new nodes.

    The first seed of a node is its member farthest from the whole, the second
    the member farthest from the first.
    """
    parts = parallelism(rows.sparkSession)
    sums = cut(node_sums(rows, parts))
    n_nodes = sums.count()
    scored = cut(_closeness(rows, sums, n_nodes))
    facts = scored.groupBy("node").agg(F.min("closeness").alias("least"), F.min_by(F.struct("id", "bits"), F.struct("closeness", "id")).alias("far"))
    loose = cut(facts.filter(F.col("least") < tau).select("node", F.col("far.id").alias("far"), F.col("far.bits").alias("far_bits")))
    leaves = scored.join(loose.select("node"), "node", "left_anti").select("id", F.col("node").alias("cluster"), "closeness", "bits")
    n_loose = loose.count()
    todo = cut(scored.join(loose.select("node"), "node", "left_semi").select("id", "node", "bits"))
    if not n_loose:
        return cut(leaves.select("id", "cluster", "closeness")), todo

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = fixed_bytes(b["bits"], ALL_BITS // 8) ^ fixed_bytes(b["far_bits"], ALL_BITS // 8)
                yield pa.RecordBatch.from_arrays([b["id"], b["node"], b["bits"], pa.array(np.bitwise_count(x).sum(1, dtype=np.int64))], names=["id", "node", "bits", "away"])

    away = _with_sums(todo, loose, n_loose).select("id", "node", "bits", "far_bits").mapInArrow(apart, "id long, node long, bits binary, away long")
    other = away.groupBy("node").agg(F.max_by("bits", F.struct("away", F.negative("id"))).alias("other_bits"))
    seeds = cut(loose.join(other, "node"))

    def near_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, z = (fixed_bytes(b[c], ALL_BITS // 8) for c in ("bits", "far_bits", "other_bits"))
                side = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) < np.bitwise_count(x ^ z).sum(1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b["id"], b["node"], b["bits"], pa.array(side)], names=["id", "node", "bits", "side"])

    def near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, c0, c1 = b["n"].to_numpy(), _totals(b["c0"]), _totals(b["c1"])
            side = b["side"].to_numpy(zero_copy_only=False).astype(bool)
            for r, x in _by_node(b):
                if c0[r[0]].any() and c1[r[0]].any():
                    side[r] = nearer_second(x, c0[r[0]], c1[r[0]], int(n[r[0]]))
            yield pa.RecordBatch.from_arrays([b["id"], b["node"], b["bits"], pa.array(side), b["side"]], names=["id", "node", "bits", "side", "old"])

    schema = "id long, node long, bits binary, side boolean"
    sided = cut(_with_sums(todo, seeds, n_loose).select("id", "node", "bits", "far_bits", "other_bits").mapInArrow(near_seed, schema))
    half = F.xxhash64("node", "side")
    for _ in range(ROUNDS - 1):
        names = sided.select("node", "side", half.alias("half")).distinct()
        halves = node_sums(sided.select(half.alias("node"), "bits"), parts).withColumnRenamed("node", "half").join(names, "half")
        total = lambda second: F.max(F.when(F.col("side") == second, F.col("total")))
        centres = cut(halves.groupBy("node").agg(F.sum("n").alias("n"), total(False).alias("c0"), total(True).alias("c1")))
        after = cut(_with_sums(sided, centres, n_loose).select("id", "node", "bits", "side", "n", "c0", "c1").mapInArrow(near_centre, schema + ", old boolean"))
        # where all went to one side, the farthest member leaves alone, so that every round makes two nodes
        stuck = cut(after.groupBy("node").agg(F.min("side").alias("low"), F.max("side").alias("high")).filter("low = high").join(loose.select("node", "far"), "node").select("node", "far"))
        if stuck.head(1):
            away = F.when(F.col("far").isNotNull(), F.col("id") == F.col("far")).otherwise(F.col("side"))
            after = cut(after.join(F.broadcast(stuck) if n_loose <= FEW_NODES else stuck, "node", "left").select("id", "node", "bits", away.alias("side"), "old"))
        moved = after.filter("old <> side").head(1)
        old, sided = sided, after.select("id", "node", "bits", "side")
        discard(old)
        if not moved:
            break
    new = cut(sided.select("id", half.alias("node"), "bits"))
    return cut(leaves.select("id", "cluster", "closeness")), new


def _settle(leaves: DataFrame, g: Graph, tau: float) -> DataFrame:
    """(id, cluster, closeness) from ``leaves`` (id, leaf) of parts split over the cluster.

    The second half of :func:`bisect`: all leaves of a part meet, in blocks;
    leaves that nothing links by a mean of ``tau`` do not affect each other, so
    what is linked is joined in one task; then all members meet all leaves.
    """
    spark = leaves.sparkSession
    leaves = cut(leaves)
    parts = parts_for(spark, leaves.count(), 20_000)
    names = leaves.groupBy("leaf").agg(F.min("id").alias("node"))
    rows = cut(leaves.join(names, "leaf").join(g.parts, "id").join(g.sketches.select("id", "bits"), "id").select("id", "root", "node", "bits"))
    root_of = cut(rows.select("node", "root").distinct())
    sums = cut(leaf_sums(rows, parts))

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, block, total = t["node"].to_numpy(), t["n"].to_numpy().astype(float), t["block"].to_numpy(), _totals(t["total"])
        for r in _runs_by(t["task"].to_numpy(), node):
            low = block[r] == block[r].min()
            a, b = r[low], r if low.all() else r[~low]
            i, j, _ = close_leaves(total[a].astype(float), n[a], total[b].astype(float), n[b], tau)
            yield pa.RecordBatch.from_arrays([pa.array(node[a[i]]), pa.array(node[b[j]])], names=["a", "b"])

    per_root = cut(root_of.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / LEAF_BLOCK).cast("int").alias("blocks")))
    cells = sums.join(root_of.join(per_root, "root"), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", "n", "total", "block", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    close = cut(per_partition(cells, "task", meet, "a long, b long", parts).filter("a <> b"))

    def unite(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, total = t["node"].to_numpy(), t["n"].to_numpy().copy(), _totals(t["total"]).copy()
        head = node.copy()
        for r in _runs_by(t["top"].to_numpy(), node):
            if len(r) > 1:
                own, size = total[r].astype(float), n[r].astype(float)
                at = join_leaves(own, size, tau)
                head[r], n[r], total[r] = node[r[at]], size, own
        for b, s in zip(_sums_out(node, n, total), range(0, len(node), 1024)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head[s : s + 1024])], names=["node", "n", "total", "head"])

    tops = components(close, sums.select(F.col("node").alias("id"))).select(F.col("id").alias("node"), F.col("root").alias("top"))
    united = cut(per_partition(sums.join(tops, "node").select("node", "n", "total", "top"), "top", unite, _NODE_SUMS + ", head long", parts))
    heads = united.filter("node = head").select("node", "n", "total").join(root_of, "node")
    size = heads.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / LEAF_BLOCK).cast("int").alias("leaf_blocks"), F.ceil(F.sum("n") / ROW_BLOCK).cast("int").alias("row_blocks"))
    size = cut(size)

    def nearest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_leaf = t["total"].is_valid().to_numpy(zero_copy_only=False)
        leaf, row = t.filter(pa.array(is_leaf)), t.filter(pa.array(~is_leaf))
        if not leaf.num_rows or not row.num_rows:
            return
        node, n, total = leaf["id"].to_numpy(), leaf["n"].to_numpy().astype(float), _totals(leaf["total"])
        ids, at, raw = row["id"].to_numpy(), row["head"].to_numpy(), fixed_bytes(row["bits"], ALL_BITS // 8)
        given, asked = leaf["task"].to_numpy(), row["task"].to_numpy()
        of = {given[r[0]]: r for r in _runs_by(given, node)}
        for r in _runs_by(asked, ids):
            mine = of.get(asked[r[0]])
            if mine is None:
                continue
            there, sums_ = node[mine], total[mine].astype(float)
            for s in range(0, len(r), 1024):
                q = r[s : s + 1024]
                k = np.minimum(np.searchsorted(there, at[q]), len(there) - 1)
                best, mean = nearest_leaf(signs(raw[q]), np.where(there[k] == at[q], k, -1), sums_, n[mine], tau)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(there[best]), pa.array(mean)], names=["id", "node", "mean"])

    task = F.xxhash64("root", "row_block", "leaf_block").alias("task")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = rows.join(united.select("node", "head"), "node").join(size, "root")
    asks = asks.withColumn("row_block", F.pmod(F.xxhash64("id"), "row_blocks").cast("int")).withColumn("leaf_block", upto("leaf_blocks"))
    gives = heads.join(size, "root").withColumn("leaf_block", F.pmod(F.xxhash64("node"), "leaf_blocks").cast("int")).withColumn("row_block", upto("row_blocks"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mixed = asks.select(task, "id", "head", "bits", none("long", "n"), none("binary", "total")).unionByName(
        gives.select(task, F.col("node").alias("id"), none("long", "head"), none("binary", "bits"), "n", "total")
    )
    moved = per_partition(mixed, "task", nearest, "id long, node long, mean double", parts)
    moved = moved.groupBy("id").agg(F.max_by("node", F.struct("mean", F.negative("node"))).alias("node"))
    rows = cut(moved.join(rows.select("id", "bits"), "id"))
    sums = cut(leaf_sums(rows, parts))
    return cut(_closeness(rows, sums, sums.count()).select("id", F.col("node").alias("cluster"), "closeness"))


def _runs_by(group: np.ndarray, then: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the rows of each ``group``, in the order of ``then``."""
    first = np.argsort(then, kind="stable")
    order, ends = runs(group[first])
    yield from np.split(first[order], ends[:-1])


def _finish(rows: DataFrame, tau: float, parts: int, label: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Nodes small enough for a task as ``label`` divides them."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, ids = t["node"].to_numpy(), t["id"].to_numpy()
        raw = fixed_bytes(t["bits"], ALL_BITS // 8)
        i_out, c_out, s_out = [], [], []
        for r in _runs_by(node, ids):
            if len(r) == 1:
                i_out.append(ids[r]), c_out.append(ids[r]), s_out.append(np.ones(1))
                continue
            b = signs(raw[r])
            leaf = label(b, tau)
            for h in np.unique(leaf):
                m = leaf == h
                x = b[m]
                i_out.append(ids[r[m]])
                c_out.append(np.full(m.sum(), ids[r[m]].min()))
                s_out.append(mean_agreement(x, x.sum(0), len(x)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(i_out)), pa.array(np.concatenate(c_out)), pa.array(np.concatenate(s_out).astype(np.float64))], names=["id", "cluster", "closeness"]
        )

    return per_partition(rows.select("id", "node", "bits"), "node", run, "id long, cluster long, closeness double", parts)


def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all usable faces, with production parameters."""
    return clusters(faces(spark, sf_dir), "id", "embedding", FACE_DIM, tables=TABLES)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable faces whose stored ``cluster_id`` disagrees with their cluster."""
    stored = (
        table(spark, sf_dir, "face_occurrences").filter("id is not null").groupBy("id").agg(F.max("cluster_id").alias("stored"))
    )
    rows = cut(face_clusters(spark, sf_dir).select("id", "cluster").join(stored, "id"))
    n = rows.groupBy("cluster", "stored").agg(F.count(F.lit(1)).alias("n"))
    per_cluster = n.groupBy("cluster").agg(
        F.sum("n").alias("all_n"), F.max(F.when(F.col("stored").isNotNull(), F.struct("n", "stored"))).alias("top")
    )
    majority = per_cluster.filter(F.col("top.n") * 2 > F.col("all_n")).select("cluster", F.col("top.stored").alias("right_id"))
    per_id = n.filter("stored is not null").groupBy("stored").agg(F.sum("n").alias("all_n"), F.max(F.struct("n", "cluster")).alias("top"))
    home = per_id.filter(F.col("top.n") * 2 > F.col("all_n")).select("stored", F.col("top.cluster").alias("home"))
    wrong_a = F.col("right_id").isNotNull() & (F.col("stored").isNull() | (F.col("stored") != F.col("right_id")))
    wrong_b = F.col("home").isNotNull() & (F.col("home") != F.col("cluster"))
    # both facts hang on (cluster, stored), so they are decided there and joined to the faces once
    wrong = (
        n.select("cluster", "stored").join(majority, "cluster", "left").join(home, "stored", "left")
        .filter(F.coalesce(wrong_a, F.lit(False)) | F.coalesce(wrong_b, F.lit(False)))
        .select("cluster", "stored")
    )
    on = (rows["cluster"] == wrong["cluster"]) & rows["stored"].eqNullSafe(wrong["stored"])
    return rows.join(wrong, on, "left_semi").select("id")


def p2_clusters(spark: SparkSession, sf_dir: str, typical: int = 5) -> DataFrame:
    """Each cluster of faces with its size and its most typical members."""
    from lumora.llm.topn import top_n_per_group

    rows = cut(face_clusters(spark, sf_dir))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    top = top_n_per_group(rows, "cluster", "closeness", "id", typical)
    members = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("typical"))
    return sizes.join(members, "cluster")


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
ORACLES: dict[str, str] = {}
