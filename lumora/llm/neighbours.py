"""Most similar vectors for every vector: an approximate k-nearest-neighbour graph.

NN-descent refines a neighbour graph by joining the neighbours of each node with
one another until nothing new is met. Laid out for a shuffle:

* A vector is reduced to sign sketches: the angle between two vectors is the
  share of random directions on which their signs differ. The search ships
  ``CODE`` bits a vector; the first ``BITS`` choose candidates, the others,
  unseen by that choice, confirm them.
* The first graph comes from cross-polytope buckets (the direction of largest
  absolute projection). Each vector enters the buckets of its ``probes`` largest
  directions in each rotation, and rotations are added as the collection grows,
  so that similar vectors keep meeting. Directions in which much of the
  collection is crowded are found on a bounded sample and taken out of the
  vectors near them first, so a crowd spreads over buckets like any other part.
* Joining neighbours of neighbours again and again ends at the connected parts
  of the graph. Links between the best neighbours of the first graph, confirmed
  by bits that the search did not use, give these parts, and inside a part
  the join is carried to its end at once: all members meet, as whole vectors in
  8 bits a number. Parts above ``BLOCK`` members meet in blocks; in parts above
  ``HUBS`` members a row meets its own block and the ``HUBS`` members nearest to
  the centre, which are the likeliest neighbours of all others.
* What leads from part to part, and parts above ``HUBS``, are refined by rounds
  of NN-descent (:func:`descend`) until few edges change.

Equal vectors are searched once and given back at the end (:func:`give_back`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.session import cut, cut_by, discard, parallelism, parts_for, release
from lumora.tables import table

#: Sketch bits that choose candidates, bits shipped with a bucket copy, and all bits kept.
BITS, CODE, ALL_BITS = 256, 512, 1024
#: Rows of a bucket before it is split, and the size aimed at.
BUCKET, AIM = 3000, 700
#: Rows of the sample on which crowded directions are fitted, and the share that makes one.
SAMPLE, CROWD = 6000, 0.004
#: Split buckets held on the driver at most; beyond, they are joined.
MAX_SPLIT = 100_000
#: Rows of one block of a part, and members of a part up to which all meet all.
BLOCK, HUBS = 8192, 32_768
#: Links of each node that join up parts, and the similarity that confirms one.
LINKS, LINK = 3, 0.40
#: Links that one task may join up: some 30 MB.
ONE_TASK = 2_000_000
#: Numbers of a face embedding.
FACE_DIM = 512


def usable_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with exactly ``dim`` finite numbers, not all zero, and their unit vectors."""
    n = len(column)
    if n == 0:
        return np.empty(0, int), np.empty((0, dim), np.float32)
    lens = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lens == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    picked = column.take(pa.array(rows))
    flat = picked.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # a null number becomes NaN
    biggest = np.abs(x).max(1)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(x).all(1) & (biggest > 0)
    rows, x, biggest = rows[good], x[good], biggest[good]
    x = x / biggest[:, None]
    return rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """``tables`` blocks of random directions, at least enough for all sketch bits."""
    wide = max(tables, -(-ALL_BITS // dim))
    return np.random.default_rng(seed).standard_normal((dim, wide * dim), dtype=np.float32) / math.sqrt(dim)


def crowded_directions(x: np.ndarray, near: float = 0.5, share: float = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Directions with at least ``share`` of the rows nearer than ``near``, and those shares."""
    left = np.ones(len(x), bool)
    adj = (x @ x.T) >= near
    found, shares = [], []
    while left.any():
        n = adj[:, left].sum(1) * left
        top = int(np.argmax(n))
        if n[top] < max(share * len(x), 8):
            break
        mine = adj[top] & left
        c = x[mine].mean(0)
        c /= max(np.linalg.norm(c), 1e-9)
        mine = ((x @ c) >= near) & left
        mine[top] = True
        found.append(c)
        shares.append(mine.sum() / len(x))
        left &= ~mine
    return np.array(found, np.float32).reshape(-1, x.shape[1]), np.array(shares)


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary column of equal widths as rows of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.empty((0, width), np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, width)


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def signs(raw: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 from packed bits."""
    return np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1


def level(cosine: float, bits: int = BITS) -> float:
    """Sum of agreeing minus differing bits that a similarity amounts to."""
    return bits * (1 - 2 * math.acos(cosine) / math.pi)


def estimate(agree: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity that a sum of agreeing minus differing bits amounts to."""
    return np.cos(np.pi / 2 * (1 - agree / bits))


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing minus differing bits of rows of packed bits."""
    return 8 * x.shape[1] - 2 * np.bitwise_count(x ^ y).sum(1, dtype=np.int32)


def per_partition(df: DataFrame, by: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """``fn`` over each hash partition as one table; ``parts`` follows the rows (:func:`parts_for`).

    The hash of ``by`` is partitioned, not ``by``: a shuffle that repeats the one of a join below is
    dropped, and adaptive execution may then read that join's rows in another order and take the
    rows of one ``by`` apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from fn(pa.Table.from_batches(got).combine_chunks())

    return df.repartition(parts, F.xxhash64(by)).mapInArrow(run, schema)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``values``, and the ends of the runs of equal ones."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    ends = np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)) if len(v) else np.empty(0, int)
    return order, ends


def top_edges(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best distinct ``b`` of each ``a``; ties to the smaller ``b``."""
    o = np.lexsort((-s, b, a))
    first = np.ones(len(o), bool)
    first[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    o = o[first]
    o = o[np.lexsort((b[o], -s[o], a[o]))]
    start = np.ones(len(o), bool)
    start[1:] = a[o][1:] != a[o][:-1]
    at = np.flatnonzero(start)
    rank = np.arange(len(o)) - np.repeat(at, np.diff(np.append(at, len(o))))
    return o[rank < k]


_EDGE = "a long, b long, s float"


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], names=["a", "b", "s"])


def best_of(edges: DataFrame, k: int, parts: int) -> DataFrame:
    """The ``k`` best edges of each node."""

    def keep(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, s = (t[c].to_numpy() for c in ("a", "b", "s"))
        o = top_edges(a, b, s, k)
        yield _edges(a[o], b[o], s[o])

    return per_partition(edges.select("a", "b", "s"), "a", keep, _EDGE, parts)


# ---- equal vectors

def classes_of(raw: DataFrame) -> DataFrame:
    """(id, rep, n) of every id of the classes of equal vectors with several ids.

    ``raw`` has ``id`` and ``h``, a hash of 128 bits of the vector; ``rep`` is
    the smallest id of a class and ``n`` their number.
    """
    ids = raw.select("id", "h")
    many = ids.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.join(many, "h").select("id", "rep", "n")


def give_back(graph: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The graph of representatives as one of all ids: (a, b, s) for the ``k`` best of each id.

    ``classes`` (id, rep, n) holds the ids of classes of several equal vectors.
    Equal vectors are the first neighbours of each other (similarity 1), then
    come those of the representative, class by class; ties go to the smaller id.
    Only the first ``k + 1`` ids of a class can be neighbours of anybody, so
    lists stay short whatever the size of a class, and ids of a large class are
    salted.
    """
    from lumora.llm.topn import top_n_per_group

    first = top_n_per_group(classes.withColumn("score", F.lit(0.0)), "rep", "score", "id", k + 1)
    lists = cut(first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    out = graph.join(lists.withColumnRenamed("rep", "b").withColumnRenamed("ids", "bs"), "b", "left")
    to = out.select("a", "s", F.explode(F.coalesce("bs", F.array("b"))).alias("b"))
    own = lists.select(F.col("rep").alias("a"), F.lit(1.0).cast("float").alias("s"), F.explode("ids").alias("b"))
    rep_edges = to.select("a", "b", "s").unionByName(own.select("a", "b", "s"))
    reps = rep_edges.join(lists.select(F.col("rep").alias("a")), "a", "left_semi").filter("a <> b")
    single = rep_edges.join(lists.select(F.col("rep").alias("a")), "a", "left_anti")
    parts = parallelism(graph.sparkSession)
    # what members of a class may see: its own first ids and the k best beyond, a list of 2 k + 1 at most
    seen = reps.unionByName(lists.select(F.col("rep").alias("a"), F.element_at("ids", 1).alias("b"), F.lit(1.0).cast("float").alias("s")))
    view = best_of(seen, 2 * k + 1, parts).groupBy("a").agg(F.collect_list(F.struct("b", "s")).alias("view"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / 5000)).cast("long")
    salted = classes.select("id", "rep", F.pmod(F.xxhash64("id"), salts).alias("salt"))
    sizes = classes.groupBy(F.col("rep").alias("a")).agg(F.max("n").alias("n"))
    copies = view.join(sizes, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    members = salted.join(copies.select(F.col("a").alias("rep"), "salt", "view"), ["rep", "salt"]).select(F.col("id").alias("a"), F.explode("view").alias("e"))
    members = members.select("a", F.col("e.b").alias("b"), F.col("e.s").alias("s")).filter("a <> b")
    return best_of(single.select("a", "b", "s").unionByName(members), k, parts)


# ---- sketches and the bucket graph

def table_count(rows: int, base: int) -> int:
    """Rotations for a collection: one more each time it grows fourfold beyond 300,000 rows.

    From there on buckets take a second hash, and each further bit of it costs
    similar pairs a part of their meetings, which the added rotations make good.
    """
    return base + max(0, math.ceil(math.log(max(rows, 1) / 300_000, 4)))


def sketch_rows(df: DataFrame, key: str, vector: str, dim: int, tables: int, probes: int, n: int, seed: int = 5) -> DataFrame:
    """One pass over the vectors: ``id``, ``h``, ``bits``, ``keys``, ``sub`` and ``code`` of every usable row.

    ``h`` is a hash of 128 bits of the vector, ``code`` the vector in 8 bits a
    number; similarities from codes err by some 0.001.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    part = min(1.0, 1.3 * SAMPLE / max(n, 1))
    chance = F.xxhash64(F.col("id"), F.lit(seed)).bitwiseAND((1 << 30) - 1)
    pick = rows.filter(chance < int(part * (1 << 30))).orderBy(chance, "id").limit(SAMPLE)
    sample = usable_matrix(pick.select("v").toArrow()["v"].combine_chunks(), dim)[1]
    centres, shares = crowded_directions(sample) if len(sample) else (np.empty((0, dim), np.float32), np.empty(0))
    rest = max(1.0 - shares.sum(), 0.01)
    # directions of each group, so that buckets hold about AIM rows whatever the group's size, and the
    # width of a second hash where all directions are too few
    group_rows = np.concatenate([[rest * n], shares * n])
    used = np.clip(np.ceil(group_rows * probes / (2 * AIM)), 1, dim).astype(int)
    used[group_rows <= AIM] = 0
    full_rows = group_rows * probes / (2 * dim)
    extra = np.where(full_rows <= 1.5 * AIM, 0, np.clip(2 ** np.ceil(np.log2(np.maximum(full_rows / AIM, 2))), 2, dim // 2)).astype(int)
    seconds = 2 if extra.any() else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rotations(dim, tables, seed)
        turned = centres @ r
        for b in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            rows_, x = usable_matrix(b["v"], dim)
            if not len(rows_):
                continue
            m = len(x)
            code = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8).view(np.uint8)
            flat = b["v"].take(pa.array(rows_)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(m, dim)
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v.data) for v in flat), np.uint8).reshape(m, 16)
            y = x @ r
            bits = np.packbits(y[:, :ALL_BITS] > 0, axis=1)
            sub = np.packbits(y[:, -64:] > 0, axis=1).view(np.int64).ravel()
            group = np.zeros(m, np.int64)
            if len(centres):
                s = x @ centres.T
                best = s.argmax(1)
                near = s[np.arange(m), best] >= 0.5
                group = np.where(near, best + 1, 0)
                y[near] -= s[near, best[near]][:, None] * turned[best[near]]
            width = used[group]
            keys = np.full((m, tables, probes, seconds), -1, np.int64)
            for t in range(tables):
                zt = y[:, t * dim : (t + 1) * dim]
                a = np.abs(zt)
                a[np.arange(dim)[None, :] >= width[:, None]] = -1.0
                idx = np.argpartition(a, -probes, axis=1)[:, -probes:]
                sign = np.take_along_axis(zt, idx, 1) > 0
                base = (((group * tables + t) * (2 * dim))[:, None] + 2 * idx + sign) * (2 * dim + 1)
                keys[:, t, :, 0] = base
                nxt = ((t + 1) % (y.shape[1] // dim)) * dim
                for g in np.flatnonzero(extra):
                    at = np.flatnonzero(group == g)
                    w = y[at, nxt : nxt + extra[g]]
                    j = np.argpartition(np.abs(w), -2, axis=1)[:, -2:]
                    second = 2 * j + (np.take_along_axis(w, j, 1) > 0) + 1
                    keys[at, t] = base[at][:, :, None] + second[:, None, :]
                # fewer directions than probes leave places empty; one bucket for all needs one key
                keys[:, t][np.take_along_axis(a, idx, 1) < 0] = -1
                if t == 0:
                    keys[width == 0, 0, 0, 0] = -2 - group[width == 0]
            keys = keys.reshape(m, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    b["id"].take(pa.array(rows_)),
                    binary(h),
                    binary(bits),
                    pa.ListArray.from_arrays(pa.array((np.arange(m + 1) * keys.shape[1]).astype(np.int32)), pa.array(keys.ravel())),
                    pa.array(sub),
                    binary(code),
                ],
                names=["id", "h", "bits", "keys", "sub", "code"],
            )

    return rows.mapInArrow(run, "id long, h binary, bits binary, keys array<long>, sub long, code binary")


def _close_pairs(m: np.ndarray, low: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Both directions of all pairs of rows of ``m`` that agree by ``low``; None where ``most`` are exceeded."""
    ii, jj, ss, got = [], [], [], 0
    for s0 in range(0, len(m), 128):
        s = m[s0 : s0 + 128] @ m[s0:].T
        s[np.tril_indices(len(s), 0, s.shape[1])] = -1e9
        i, j = np.nonzero(s >= low)
        got += len(i)
        if got > most:
            return None
        ii.append(i + s0), jj.append(j + s0), ss.append(s[i, j])
    i, j, v = np.concatenate(ii), np.concatenate(jj), np.concatenate(ss)
    return np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])


def _best_columns(m: np.ndarray, want: np.ndarray, low: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row in ``want`` that agree by ``low``."""
    ii, jj, ss = [], [], []
    for s0 in range(0, len(want), 512):
        rows = want[s0 : s0 + 512]
        s = m[rows] @ m.T
        r = np.arange(len(rows))
        s[r, rows] = -1e9
        if s.shape[1] > k:
            j = np.argpartition(s, -k, axis=1)[:, -k:].ravel()
            i = np.repeat(r, k)
        else:
            i, j = np.nonzero(s > -1e8)
        v = s[i, j]
        keep = v >= low
        ii.append(rows[i[keep]]), jj.append(j[keep]), ss.append(v[keep])
    return np.concatenate(ii), np.concatenate(jj), np.concatenate(ss)


def bucket_edges(raw: np.ndarray, k: int, floor: float, fill: bool, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best neighbours of each row among the rows of codes ``raw``, with estimated similarities.

    The first ``BITS`` bits choose those above ``floor``, all others must
    confirm it; ``fill`` keeps the ``k`` best whatever their similarity.
    """
    m = signs(raw[:, : BITS // 8])
    low = -BITS if fill else level(floor)
    # strangers for the most part: all pairs above the floor, each computed once; in a crowd, the best of each row
    found = None if fill or left is not None else _close_pairs(m, low, 15 * len(m))
    if found is None:
        found = _best_columns(m, np.arange(len(m)) if left is None else np.flatnonzero(left), low, k)
    i, j, v = found
    if not len(i):
        return i, j, v
    t = top_edges(i, j, v, k)
    i, j, v = i[t], j[t], v[t]
    rest = agreement(raw[i, BITS // 8 :], raw[j, BITS // 8 :])
    keep = slice(None) if fill else rest >= level(floor, CODE - BITS)
    return i[keep], j[keep], estimate((v + rest)[keep], CODE)


def first_edges(sketches: DataFrame, n: int, width: int, k: int, keep: int, floor: float, fill: bool = False, queries: int = 0) -> DataFrame:
    """Edges (a, b, s) of the bucket graph: ``k`` a row and bucket, ``keep`` a row and task.

    With ``queries`` only rows whose id it divides look for neighbours.
    """
    spark = sketches.sparkSession
    counts = sketches.select(F.explode("keys").alias("key")).filter("key <> -1").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BUCKET)
    big = counts.limit(MAX_SPLIT + 1).toPandas()
    code = F.substring("bits", 1, CODE // 8).alias("bits")
    if len(big) > MAX_SPLIT:
        split = sketches.select("id", code, "sub", F.posexplode("keys").alias("p", "key")).filter("key <> -1").join(counts, "key", "left")
        nb = F.ceil(F.log2(F.col("c") / AIM)).cast("int")
        cut_ = F.when(F.col("c").isNotNull(), F.pmod(F.shiftrightunsigned("sub", F.col("p") * 5), F.shiftleft(F.lit(1), nb))).otherwise(0)
        copies = split.select(F.xxhash64("key", cut_).alias("key"), "id", "bits")
    else:
        bits_of = {int(q): max(1, math.ceil(math.log2(c / AIM))) for q, c in zip(big["key"], big["c"])}

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = b.num_rows
                if not m:
                    continue
                key = b["keys"].flatten().to_numpy().reshape(m, width).copy()
                sub = b["sub"].to_numpy()
                if bits_of:
                    for i, j in np.argwhere(np.isin(key, np.fromiter(bits_of, np.int64))):
                        q = int(key[i, j])
                        part = (int(sub[i]) >> (j * 5 % 48)) & ((1 << bits_of[q]) - 1)
                        key[i, j] = q * 4099 + part + (1 << 50)
                raw = fixed_bytes(b["bits"], CODE // 8)
                there = key.ravel() != -1
                rep = np.repeat(np.arange(m), width)[there]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[there]), b["id"].take(pa.array(rep)), binary(raw[rep])], names=["key", "id", "bits"])

        copies = sketches.select("id", "keys", "sub", code).mapInArrow(spread, "key long, id long, bits binary")

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids = t["key"].to_numpy(), t["id"].to_numpy()
        raw = fixed_bytes(t["bits"], CODE // 8)
        order, ends = runs(key)
        a, b, s, start = [], [], [], 0
        for e in ends:
            rows = order[start:e]
            start = e
            left = ids[rows] % queries == 0 if queries else None
            if len(rows) < 2 or (queries and not left.any()):
                continue
            i, j, v = bucket_edges(raw[rows], k, floor, fill, left)
            if len(i):
                a.append(ids[rows[i]]), b.append(ids[rows[j]]), s.append(v)
        if a:
            aa, bb, ss = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            o = top_edges(aa, bb, ss, keep)  # what is not among a row's best here is not among its best
            yield _edges(aa[o], bb[o], ss[o])

    return per_partition(copies, "key", search, _EDGE, parts_for(spark, n * width, 250_000))


# ---- connected parts

def components(edges: DataFrame, nodes: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, root): the smallest id of each node's connected part.

    ``edges`` (a, b) are undirected. While more than ``one_task`` links are
    left, each node takes over its smallest neighbour and links are contracted
    to those between what remains, at most half of the nodes, so links shrink
    round by round. The remainder, whose size is checked, is joined up in one
    task.
    """
    ordered = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    links = cut(ordered(edges.select("a", "b")))
    labels = nodes.select("id", F.col("id").alias("root"))
    while links.count() > one_task:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        for _ in range(2):  # ids only fall, so chains end; each step halves them
            up = cut(up.join(up.select(F.col("id").alias("root"), F.col("root").alias("top")), "root").select("id", F.col("top").alias("root")))
        labels = cut(_relabel(labels, up))
        at = lambda c: up.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        old = links
        links = cut(ordered(links.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        discard(old)
    return _relabel(labels, links.coalesce(1).mapInArrow(_join_up, "id long, root long"))


def _relabel(labels: DataFrame, up: DataFrame) -> DataFrame:
    return labels.join(up.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest member of the part of each node of the links in this task."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    ids, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    i, j = at[: t.num_rows], at[t.num_rows :]
    root = np.arange(len(ids))
    while len(i):
        ri, rj = root[i], root[j]
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "root"])


def confirmed_links(graph: DataFrame, sketches: DataFrame, parts: int, links: int = LINKS, at_least: float = LINK) -> DataFrame:
    """Of each node's ``links`` best edges, those (a, b) that the bits unused so far put at ``at_least``."""
    rest = ALL_BITS - CODE
    best = best_of(graph, links, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tail = sketches.select("id", F.substring("bits", CODE // 8 + 1, rest // 8).alias("t"))
    p = best.join(tail.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(tail.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    low = level(at_least, rest)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(agreement(fixed_bytes(b["ta"], rest // 8), fixed_bytes(b["tb"], rest // 8)) >= low)
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return p.select("a", "b", "ta", "tb").mapInArrow(agree, "a long, b long")


# ---- whole vectors

def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.view(np.int8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_top(u: np.ndarray, v: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns ``v`` of each row of ``u``; ``own`` is the row's column, which does not count.

    Columns are taken in pieces, those nearest to the centre first, and only
    what beats a row's worst kept neighbour is looked at again.
    """
    step = 4096
    centre = v.sum(0)
    near = np.argsort(-(v @ centre), kind="stable")
    place = np.empty(len(v), np.int64)
    place[near] = np.arange(len(v))
    own = place[own]
    ii, jj, ss = [], [], []
    for r0 in range(0, len(u), 1024):
        x = u[r0 : r0 + 1024]
        n = len(x)
        worst = np.full(n, -2.0, np.float32)
        i_, j_, s_ = np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
        for c0 in range(0, len(v), step):
            cols = near[c0 : c0 + step]
            s = x @ v[cols].T
            mine = own[r0 : r0 + 1024] - c0
            at = np.flatnonzero((mine >= 0) & (mine < len(cols)))
            s[at, mine[at]] = -3.0
            if c0 == 0 and len(cols) > k:
                j = np.argpartition(s, -k, axis=1)[:, -k:].ravel()
                i = np.repeat(np.arange(n), k)
            else:
                i, j = np.nonzero(s > worst[:, None])
            w = s[i, j]
            keep = w > -2.5
            i_, j_, s_ = np.concatenate([i_, i[keep]]), np.concatenate([j_, cols[j[keep]]]), np.concatenate([s_, w[keep]])
            o = top_edges(i_, j_, s_, k)
            i_, j_, s_ = i_[o], j_[o], s_[o]
            have = np.bincount(i_, minlength=n)
            last = np.flatnonzero(np.append(i_[1:] != i_[:-1], True)) if len(i_) else np.empty(0, int)
            worst[:] = -2.0
            worst[i_[last]] = s_[last]
            worst[have < k] = -2.0
        ii.append(i_ + r0), jj.append(j_), ss.append(s_)
    return np.concatenate(ii), np.concatenate(jj), np.concatenate(ss)


def _hub_flags(placed: DataFrame, dim: int, hubs: int) -> DataFrame:
    """(id, hub): for members of parts above ``hubs`` rows, whether they are among the nearest to the centre."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            root = b["root"].to_numpy()
            u = _unit(fixed_bytes(b["code"], dim)) if b.num_rows else None
            order, ends = runs(root)
            start = 0
            for e in ends:
                r = order[start:e]
                start = e
                acc[int(root[r[0]])] = acc.get(int(root[r[0]]), 0) + u[r].sum(0, dtype=np.float64)
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([v.tolist() for v in acc.values()])], names=["root", "v"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = b["centre"].flatten().to_numpy().reshape(-1, dim)
                p = (_unit(fixed_bytes(b["code"], dim)) * c).sum(1)
                yield pa.RecordBatch.from_arrays([b["id"], b["root"], b["n"], pa.array(p)], names=["id", "root", "n", "p"])

    large = placed.filter(F.col("n") > hubs)
    at = large.select("root", "code").mapInArrow(sums, "root long, v array<double>").select("root", F.posexplode("v").alias("i", "v"))
    centres = at.groupBy("root", "i").agg(F.sum("v").alias("v")).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))
    scored = cut(large.join(centres, "root").select("id", "root", "n", "code", "centre").mapInArrow(score, "id long, root long, n long, p double"))
    # the bar at which ``hubs`` members are reached, from counts in 4,000 steps of the similarity
    step = F.floor(F.col("p") * 2000)
    n = scored.groupBy("root", step.alias("step")).agg(F.count(F.lit(1)).alias("c"))
    down = n.withColumn("above", F.sum("c").over(Window.partitionBy("root").orderBy(F.desc("step"))))
    bar = down.filter(F.col("above") >= hubs).groupBy("root").agg(F.max("step").alias("bar"))
    return scored.join(bar, "root").select("id", (step >= F.col("bar")).alias("hub"))


def part_edges(codes: DataFrame, dim: int, parts_of: DataFrame, n: int, k: int, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """Edges (a, b, s) to the ``k`` best members of each node's own part, from whole vectors.

    ``codes`` has ``id`` and ``code``; ``parts_of`` has ``id``, ``root`` and ``n`` (members of the part, above 1).
    Parts up to ``block`` members are one task's work; larger ones go out in
    blocks of rows, each with all columns of the part, or with its own and the
    ``hubs`` members nearest to the centre where the part is larger still.
    """
    spark = codes.sparkSession
    placed = codes.select("id", "code").join(parts_of, "id")
    nb = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    mine = F.pmod(F.xxhash64("id"), nb).cast("int")
    if parts_of.filter(F.col("n") > hubs).head(1):
        placed = placed.join(_hub_flags(placed, dim, hubs), "id", "left")
        every = F.coalesce("hub", F.lit(True))
    else:
        every = F.lit(True)
    cells = placed.withColumn("mine", mine).withColumn("cell", F.explode(F.when(every, F.sequence(F.lit(0), nb - 1)).otherwise(F.array("mine"))))
    cells = cells.select("id", "root", (F.col("cell") == F.col("mine")).alias("own"), "cell", "code", F.xxhash64("root", "cell").alias("task"))

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        root, cell, ids = t["root"].to_numpy(), t["cell"].to_numpy(), t["id"].to_numpy()
        own = t["own"].to_numpy(zero_copy_only=False)
        raw = fixed_bytes(t["code"], dim)
        o = np.lexsort((ids, cell, root))
        change = np.flatnonzero((root[o][1:] != root[o][:-1]) | (cell[o][1:] != cell[o][:-1])) + 1
        starts, ends = np.concatenate([[0], change]), np.append(change, len(o))
        sizes = ends - starts
        for d in np.unique(sizes[sizes > 1]):
            groups = starts[sizes == d]
            if d > 64:
                for g in groups:
                    rows = o[g : g + d]
                    u = _unit(raw[rows])
                    me = np.flatnonzero(own[rows])
                    i, j, s = block_top(u[me], u, me, k)
                    yield _edges(ids[rows[me[i]]], ids[rows[j]], s)
                continue
            step = max(1, 8192 // int(d))
            for g0 in range(0, len(groups), step):
                rows = o[groups[g0 : g0 + step][:, None] + np.arange(d)]
                u = _unit(raw[rows.ravel()]).reshape(len(rows), d, dim)
                s = u @ u.transpose(0, 2, 1)
                s[:, np.arange(d), np.arange(d)] = -3.0
                idr = ids[rows]
                if d - 1 > k:
                    j = np.argsort(-s, axis=2, kind="stable")[:, :, :k]  # ids ascend, so ties go to the smaller
                    a = np.broadcast_to(idr[:, :, None], j.shape).ravel()
                    yield _edges(a, np.take_along_axis(np.broadcast_to(idr[:, None, :], s.shape), j, 2).ravel(), np.take_along_axis(s, j, 2).ravel())
                else:
                    q, i, j = np.nonzero(s > -2.5)
                    yield _edges(idr[q, i], idr[q, j], s[q, i, j])

    return per_partition(cells, "task", search, _EDGE, parts_for(spark, n, 40_000))


def coded_pairs(codes: DataFrame, dim: int, pairs: DataFrame) -> DataFrame:
    """(a, b, s): the similarity, from 8 bits a number, of each of the distinct ``pairs`` (a, b)."""
    one = codes.select("id", "code")
    both = pairs.select("a", "b").join(one.select(F.col("id").alias("a"), F.col("code").alias("ca")), "a").join(one.select(F.col("id").alias("b"), F.col("code").alias("cb")), "b")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_unit(fixed_bytes(b["ca"], dim)) * _unit(fixed_bytes(b["cb"], dim))).sum(1)
                yield _edges(b["a"].to_numpy(), b["b"].to_numpy(), s)

    return both.select("a", "b", "ca", "cb").mapInArrow(cosine, _EDGE)


def exact_pairs(df: DataFrame, key: str, vector: str, dim: int, pairs: DataFrame) -> DataFrame:
    """(a, b, s double): the true similarity of each of the ``pairs`` (a, b) of usable vectors.

    The vectors are the bulk of the table, so those not wanted are left out first.
    """
    pairs = pairs.select("a", "b")
    vec = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vec = vec.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(vec.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(
        vec.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b"
    )

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b["va"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            y = b["vb"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            s = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(s)], names=["a", "b", "s"])

    return both.select("a", "b", "va", "vb").mapInArrow(cosine, "a long, b long, s double")


# ---- descent

def descend(graph: DataFrame, where: DataFrame, sketches: DataFrame, k: int, floor: float, reach: int, parts: int) -> DataFrame:
    """One NN-descent round: better edges met among the neighbours of the nodes of ``where`` (id).

    Each node takes part with up to ``reach`` best forward and ``reach`` reverse
    neighbours. A message carries the sender's code, its worst kept similarity
    and a small filter of its neighbours, so that only news is sent on.
    """
    both = graph.select(F.col("a").alias("id"), F.col("b").alias("o"), "s", F.lit(True).alias("fwd")).unionByName(
        graph.select(F.col("b").alias("id"), F.col("a").alias("o"), "s", F.lit(False).alias("fwd"))
    )
    senders = cut(both.join(where.select(F.col("id").alias("o")), "o", "left_semi").select("id").distinct())
    both = both.join(where.select(F.col("id").alias("o"), F.lit(True).alias("open")), "o", "left").join(senders, "id", "left_semi")
    code = F.substring("bits", 1, CODE // 8).alias("bits")
    facts = sketches.join(senders, "id", "left_semi").select(
        "id", F.lit(None).cast("long").alias("o"), F.lit(None).cast("float").alias("s"), F.lit(None).cast("boolean").alias("fwd"), F.lit(None).cast("boolean").alias("open"), code
    )
    mixed = both.select("id", "o", "s", "fwd", "open", F.lit(None).cast("binary").alias("bits")).unionByName(facts)

    def send(t: pa.Table) -> Iterator[pa.RecordBatch]:
        is_edge = t["o"].is_valid().to_numpy(zero_copy_only=False)
        e, f = t.filter(pa.array(is_edge)), t.filter(pa.array(~is_edge))
        if not e.num_rows or not f.num_rows:
            return
        fid = f["id"].to_numpy()
        raw = fixed_bytes(f["bits"], CODE // 8)
        fo = np.argsort(fid)
        fid, raw = fid[fo], raw[fo]
        a, o, s = e["id"].to_numpy(), e["o"].to_numpy(), e["s"].to_numpy()
        fwd = e["fwd"].to_numpy(zero_copy_only=False).astype(bool)
        opened = e["open"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        at = np.searchsorted(fid, a)
        n = len(fid)
        worst, have = np.full(n, 2.0, np.float32), np.bincount(at[fwd], minlength=n)
        np.minimum.at(worst, at[fwd], s[fwd])
        worst[have < k] = -2.0
        seen = np.zeros(n, np.uint64)
        np.bitwise_or.at(seen, at[fwd], np.left_shift(np.uint64(1), (o[fwd] * 0x9E3779B1 >> 7 & 63).astype(np.uint64)))
        kept = [top_edges(a[m], o[m], s[m], reach) for m in (fwd, ~fwd)]
        rows = np.concatenate([np.flatnonzero(m)[q] for m, q in zip((fwd, ~fwd), kept)])
        rows = rows[opened[rows]]
        if not len(rows):
            return
        _, first = np.unique(np.stack([a[rows], o[rows]], 1), axis=0, return_index=True)
        rows = rows[first]
        src = at[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(o[rows]), pa.array(a[rows]), binary(raw[src]), pa.array(worst[src]), pa.array(seen[src].view(np.int64))],
            names=["to", "id", "bits", "worst", "seen"],
        )

    msgs = per_partition(mixed, "id", send, "to long, id long, bits binary, worst float, seen long", parts)

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        to, ids = t["to"].to_numpy(), t["id"].to_numpy()
        raw = fixed_bytes(t["bits"], CODE // 8)
        worst, seen = t["worst"].to_numpy(), t["seen"].to_numpy().view(np.uint64)
        order, ends = runs(to)
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        for d in np.unique(sizes[sizes > 1]):
            groups = starts[sizes == d]
            step = max(1, 30_000 // int(d))
            for g0 in range(0, len(groups), step):
                rows = order[groups[g0 : g0 + step][:, None] + np.arange(d)]
                m = signs(raw[rows.ravel()]).reshape(len(rows), d, CODE)
                s = estimate(m @ m.transpose(0, 2, 1), CODE)
                s[:, np.arange(d), np.arange(d)] = -3.0
                idr = ids[rows]
                bit = np.left_shift(np.uint64(1), (idr * 0x9E3779B1 >> 7 & 63).astype(np.uint64))
                new = (s >= floor) & (s > worst[rows][:, :, None]) & ((seen[rows][:, :, None] & bit[:, None, :]) == 0)
                g, i, j = np.nonzero(new)
                if len(g):
                    yield _edges(idr[g, i], idr[g, j], s[g, i, j])

    return per_partition(msgs, "to", meet, _EDGE, parts)


class Graph:
    """A neighbour graph: its edges, and what it was made from.

    ``edges`` (a, b, s) lead from each distinct vector to its ``k`` most similar
    ones; ``sketches`` (id, bits, keys, sub) and ``parts`` (id, root) are by the
    smallest id of each distinct vector; ``classes`` (id, rep, n) holds the ids
    of equal vectors, or is None where all differ; ``codes`` (id, code) has the
    vectors in 8 bits a number. ``first`` (a, b, s) is the
    bucket graph, ``across`` what leads from part to part, of true similarity.
    """

    def __init__(self, edges: DataFrame | None, sketches: DataFrame, codes: DataFrame, parts: DataFrame, classes: DataFrame | None, n: int, width: int, first: DataFrame, across: DataFrame):
        self.edges, self.sketches, self.codes, self.parts, self.classes = edges, sketches, codes, parts, classes
        self.n, self.width, self.first, self.across = n, width, first, across


def linked_parts(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, tables: int = 4, probes: int = 3, noise: float = 0.35, per_bucket: int = 3, fill: bool = False) -> Graph:
    """The bucket graph of all usable vectors and its connected parts, without edges yet."""
    spark = df.sparkSession
    n = df.count()
    # one row an id, in buckets of ids: whatever is joined to it later moves, not the sketches and codes
    every = cut_by(sketch_rows(df, key, vector, dim, table_count(n, tables), probes, n), "id", parts_for(spark, n, 100_000))
    release(spark)
    members, sketches = cut(classes_of(every)), every
    if members.head(1):
        sketches = every.join(members.filter("id <> rep").select("id"), "id", "left_anti")
    else:
        members = None
    n = sketches.select("id").count()
    codes = sketches.select("id", "code")
    release(spark)
    head = sketches.select(F.size("keys").alias("w")).head(1)
    width = int(head[0].w) if head else 1
    parts = parts_for(spark, n * k, 1_000_000)
    # to make up the k whatever the similarity, each bucket has to offer as many
    first = cut(best_of(first_edges(sketches.select("id", "bits", "keys", "sub"), n, width, k if fill else per_bucket, k, noise, fill), k, parts))
    release(spark)
    links = cut(confirmed_links(first.filter(F.col("s") >= noise), sketches, parts))
    release(spark)
    roots = cut(components(links, sketches.select("id")))
    # close copies use up the links of a node, and weak ones fail the bits: every edge that still leads
    # from part to part is computed, and joins parts where it holds
    across = cut(coded_pairs(codes, dim, cut(_across(first.filter(F.col("s") >= noise), roots).select("a", "b"))))
    strong = cut(across.filter(F.col("s") >= LINK))
    if strong.head(1):
        at = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        heads = strong.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        top = components(heads, roots.select(F.col("root").alias("id")).distinct()).select(F.col("id").alias("root"), F.col("root").alias("top"))
        roots = cut(roots.join(top, "root").select("id", F.col("top").alias("root")))
    discard(links)
    return Graph(None, sketches, codes, roots, members, n, width, first, _across(across, roots))


def _across(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (a, b, s) whose ends lie in different parts."""
    at = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    return edges.join(at("a"), "a").join(at("b"), "b").filter("ra <> rb").select("a", "b", F.col("s").cast("float").alias("s"))


def neighbour_graph(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, noise: float = 0.35, fill: bool = False, reach: int = 6, until: float = 0.002, block: int = BLOCK, hubs: int = HUBS, **search) -> Graph:
    """Edges (a, b, s) from every distinct usable vector to its ``k`` most similar ones.

    ``s`` is the similarity from whole vectors in 8 bits a number.
    ``noise`` is the similarity below which an edge says nothing about where
    other neighbours are: only edges above it are followed. Edges below it are
    kept, to make up the ``k``, with ``fill``. Descent ends when fewer than
    ``until`` of the edges change. Vectors that are null, of another length, not
    finite or all zero take no part; an id counts once; an empty table gives an
    empty graph; other columns are ignored.
    """
    spark = df.sparkSession
    g = linked_parts(df, key, vector, dim, k=k, noise=noise, fill=fill, **search)
    parts = parts_for(spark, g.n * k, 1_000_000)
    sized = cut(g.parts.join(g.parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "root"))
    inside = cut(part_edges(g.codes, dim, sized, g.n, k, block, hubs))
    release(spark)
    across = g.across.filter(F.col("s") >= noise)
    edges = [inside, across]
    # parts that were not searched whole keep the edges of the buckets too
    large = cut(sized.filter(F.col("n") > hubs).select("id"))
    if large.head(1):
        own = g.first.filter(F.col("s") >= noise).join(large.withColumnRenamed("id", "a"), "a", "left_semi")
        edges.append(coded_pairs(g.codes, dim, own).filter(F.col("s") >= noise))
    graph = cut(best_of(_union(edges), k, parts))
    ends = lambda e: e.select(F.explode(F.array("a", "b")).alias("id"))
    where = cut(ends(across).unionByName(large).distinct())
    while where.head(1):  # each round replaces edges by better ones, so rounds end
        found = cut(descend(graph, where, g.sketches, k, noise, reach, parts).distinct())
        better = cut(coded_pairs(g.codes, dim, found).filter(F.col("s") >= noise))
        if not better.head(1):
            break
        # only nodes that were offered an edge are ranked anew
        nodes = cut(better.select("a").distinct())
        ranked = cut(best_of(graph.join(nodes, "a", "left_semi").unionByName(better), k, parts))
        fresh = cut(ranked.join(graph, ["a", "b"], "left_anti"))
        n_fresh = fresh.count()
        if n_fresh:
            graph = cut(graph.join(nodes, "a", "left_anti").unionByName(ranked))
            where = cut(ends(fresh).distinct())
        release(spark)
        if n_fresh <= until * max(graph.count(), 1):
            break
    if fill:
        low = g.first.filter(F.col("s") < noise).unionByName(g.across.filter(F.col("s") < noise))
        graph = cut(best_of(graph.unionByName(low), k, parts))
    g.edges = graph
    return g


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def everyones_neighbours(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, **graph) -> DataFrame:
    """(a, b, s): the ``k`` most similar vectors of every usable vector, equal ones included."""
    g = neighbour_graph(df, key, vector, dim, k=k, **graph)
    return g.edges if g.classes is None else give_back(g.edges, g.classes, k)


def graph_search(queries: DataFrame, graph: DataFrame, codes: DataFrame, dim: int, k: int = 10, beam: int = 24, hops: int = 8) -> DataFrame:
    """Greedy search: (q, b, s) for the ``k`` best nodes reached from each query.

    ``queries`` has ``q``, ``code`` (8 bits a number) and ``start`` (node ids to
    begin from). Each hop joins the unvisited nodes of all beams with the graph
    and their neighbours with the ``codes``, and keeps the ``beam`` best; search
    ends when no beam changes, or after ``hops``.
    """
    spark = queries.sparkSession
    parts = parallelism(spark)
    q = cut(queries.select("q", F.col("code").alias("qb"), "start"))
    nodes = codes.select(F.col("id").alias("b"), F.col("code").alias("nb"))
    links = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    def score(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    yield _edges(x["q"].to_numpy(), x["b"].to_numpy(), (_unit(fixed_bytes(x["qb"], dim)) * _unit(fixed_bytes(x["nb"], dim))).sum(1))

        return pairs.join(nodes, "b").join(q.select("q", "qb"), "q").select("q", "b", "qb", "nb").mapInArrow(run, _EDGE)

    beams = cut(best_of(score(q.select("q", F.explode("start").alias("b")).distinct()), beam, parts)).withColumn("done", F.lit(False))
    for _ in range(hops):
        todo = beams.filter("not done").select(F.col("a").alias("q"), F.col("b").alias("via"))
        steps = todo.join(links.withColumnRenamed("a", "via"), "via").select("q", "b").distinct()
        steps = steps.join(beams.select(F.col("a").alias("q"), "b"), ["q", "b"], "left_anti")
        merged = best_of(beams.select("a", "b", "s").unionByName(score(steps)), beam, parts)
        old = beams.select("a", "b", F.lit(True).alias("old"))
        beams = cut(merged.join(old, ["a", "b"], "left").withColumn("done", F.coalesce("old", F.lit(False))).drop("old"))
        if not beams.filter("not done").head(1):
            break
    return best_of(beams.select("a", "b", "s"), k, parts).withColumnRenamed("a", "q")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all faces."""
    return table(spark, sf_dir, "face_occurrences").select("id", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of faces with a similarity of at least 0.86 of which one is among the other's ten best.

    Edges below that similarity are of no use here, so the graph is not filled up.
    """
    df = faces(spark, sf_dir)
    near = cut(everyones_neighbours(df, "id", "embedding", FACE_DIM).filter(F.col("s") >= 0.858).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s"))
    pairs = near.groupBy("a", "b").agg(F.max("s").alias("s"))
    # what 8 bits a number leave open is decided by the vectors themselves
    close = cut(pairs.filter(F.col("s") < 0.862))
    sure = pairs.filter(F.col("s") >= 0.862).select("a", "b")
    if close.head(1):
        sure = sure.unionByName(exact_pairs(df, "id", "embedding", FACE_DIM, close).filter(F.col("s") >= 0.86).select("a", "b"))
    return sure.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar other faces of every usable face, best first, with the similarity."""
    got = everyones_neighbours(faces(spark, sf_dir), "id", "embedding", FACE_DIM, fill=True)
    return got.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), F.round(F.col("s").cast("double"), 3).alias("similarity"))


def p1_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Greedy graph search for every usable face whose id is divisible by 100, among all faces.

    A query enters the graph at the best members of its buckets, without the
    edges that lead from it.
    """
    df = faces(spark, sf_dir)
    g = neighbour_graph(df, "id", "embedding", FACE_DIM, fill=True)
    every = g.sketches.select("id").withColumn("rep", F.col("id"))
    if g.classes is not None:
        every = every.join(g.classes.select(F.col("rep").alias("id")), "id", "left_anti").unionByName(g.classes.select("id", "rep"))
    asked = cut(every.filter("id % 100 = 0"))
    seeds = first_edges(g.sketches.join(asked.select(F.col("rep").alias("id")).distinct().withColumn("ask", F.lit(True)), "id", "left").select(F.when(F.col("ask"), F.col("id") * 2).otherwise(F.col("id") * 2 + 1).alias("id"), "bits", "keys", "sub"), g.n, g.width, 8, 24, 0.0, True, 2)
    starts = seeds.groupBy("a").agg(F.collect_set(F.shiftright("b", 1)).alias("start")).select(F.shiftright("a", 1).alias("q"), "start")
    queries = starts.join(g.codes.withColumnRenamed("id", "q"), "q")
    others = g.edges.join(queries.select(F.col("q").alias("a")), "a", "left_anti")
    found = graph_search(queries, others, g.codes, FACE_DIM, k=k + 1).filter("q <> b").select(F.col("q").alias("a"), "b", "s")
    found = best_of(found, k, parallelism(spark))
    if g.classes is not None:
        found = give_back(found, g.classes, k)
    return found.filter("a % 100 = 0").select(F.col("a").alias("q"), F.col("b").alias("neighbour"), F.round(F.col("s").cast("double"), 3).alias("similarity"))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p1_neighbours": p1_neighbours}
ORACLES: dict[str, str] = {}
