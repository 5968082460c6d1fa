import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumora.llm import cluster, cooccur, encode, mix, neighbours, quality, topn

tokenizers = pytest.importorskip("tokenizers")


# ---- top N

def test_top_n(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), i, float(rng.integers(0, 5))) for i, g in enumerate(rng.choice([1, 1, 1, 2, 3, 4], 600))]
    rows += [(None, 1, 1.0), (9, None, 1.0), (9, 5, None), (9, 6, float("nan")), (9, 7, 2.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g0 long, it long, sc double, g string")
    got = {(r.g0, r.it, r.position) for r in topn.top_n_per_group(df, "g0", "sc", "it", 5).collect()}
    want = set()
    for g in (1, 2, 3, 4, 9):
        own = sorted([(-s, i) for q, i, s in rows if q == g and i is not None and s is not None and s == s])[:5]
        want |= {(g, i, p + 1) for p, (_, i) in enumerate(own)}
    assert got == want
    assert topn.top_n_per_group(df.filter("g0 = 77"), "g0", "sc", "it", 5).count() == 0


# ---- co-occurrence

def test_notations(spark):
    rows = ['["Sky ", "sea"]', "['sky', \"it's\"]", '"[\\"a\\", \\"caf\\u00e9\\"]"', "red door, Sky", '[{"label": "dog", "score": 0.5}]', '["car : 55%"]', "null", "[]", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", F.transform(cooccur.list_entries(F.col("t")), lambda x: cooccur.clean_item(x, True)).alias("x")).collect()}
    assert [got[i] for i in range(10)] == [["sky", "sea"], ["sky", "it's"], ["a", "café"], ["red door", "sky"], ["dog"], ["car"], [], [], [], []]


def test_pair_counts_and_surprise(spark):
    rng = np.random.default_rng(1)
    baskets = []
    for i in range(800):
        items = {f"i{j}" for j in rng.choice(12, rng.integers(1, 5), replace=False)}
        if i % 20 == 0:
            items |= {"x", "y"}
        baskets.append((i, sorted(items)))
    df = spark.createDataFrame(baskets, "basket long, items array<string>")
    got = {(r.item_a, r.item_b): r for r in cooccur.cooccurrence(df, 5).collect()}
    want = {}
    for _, items in baskets:
        for p in itertools.combinations(items, 2):
            want[p] = want.get(p, 0) + 1
    assert {p: r.n_ab for p, r in got.items()} == {p: c for p, c in want.items() if c >= 5}
    assert got["x", "y"].significant and got["x", "y"].log10_p < -10 and sum(r.significant for r in got.values()) < 5
    assert cooccur.cooccurrence(df.filter("basket < 0"), 5).count() == 0


def test_poisson_binomial_tail_is_near_exact():
    p, n = np.array([[0.02, 0.1]]), np.array([300.0, 50.0])
    dist = np.array([1.0])
    for q, m in zip(p[0], n):
        for _ in range(int(m)):
            dist = np.convolve(dist, [1 - q, q])
    for c in (15, 20, 30, 45):
        got = cooccur.poisson_binomial_log10_tail(np.array([c]), p, n)[0]
        assert got == pytest.approx(math.log10(dist[c:].sum()), abs=0.02)


def test_configuration_meets_degrees():
    sizes, size_n = np.array([1, 4, 6]), np.array([70.0, 45, 30])
    degrees, item_n = np.array([3, 10, 40]), np.array([50.0, 20, 2])
    assert (degrees * item_n).sum() == (sizes * size_n).sum()
    x, y = cooccur.fit_configuration(degrees, item_n, sizes, size_n)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * size_n).sum(1), degrees, rtol=1e-3)
    assert np.allclose((p * item_n[:, None]).sum(0), sizes, rtol=1e-3)
    with pytest.raises(ValueError):
        cooccur.fit_configuration(degrees, item_n, sizes, size_n + 1)


# ---- encoding

TEXTS = ["", None, "Hello world, it's 2024!", "  two  spaces\r\n\ttab", "aaaaaaaaaaaaaaaaaaaaaaaa" * 30, "<|endoftext|> is text", "日本語の文章です。🙂🙂", "é combining ﻿", "x" * 3001 + "Y" * 17, "\u0000\x7f", "naïve café – “quotes”"]


def reference():
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids if s else []


def test_encoding_and_round_trip(spark):
    ref = reference()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, "", 2), (None, "again again", 3)], "doc_id long, text string, ids int")
    out = encode.encode_corpus(df, "doc_id", "text")
    got = [(r.doc_id, list(r.ids)) for r in out.collect()]
    assert len(got) == len(TEXTS) + 2
    assert sorted(got, key=str) == sorted([(i, ref(t)) for i, t in enumerate(TEXTS)] + [(0, []), (None, ref("again again"))], key=str)
    back = {r.doc_id: r.text for r in encode.decode_corpus(out.filter("doc_id > 0"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS) if i)


def test_random_words_match():
    rng = np.random.default_rng(2)
    words = ["".join(chr(c) for c in rng.choice([97, 98, 99, 101, 116, 104, 233, 12354, 32], rng.integers(1, 40))) for _ in range(300)]
    ref = reference()
    import regex

    pieces = sorted({p for w in words for p in regex.findall(encode.PATTERN, w)})
    coded = encode.WordEncoder(f"{encode.TOKENIZERS}/{encode.VOCABULARY}").encode(pieces)
    assert all(list(c) == ref(p) for p, c in zip(pieces, coded))


# ---- mixing

def test_water_fill():
    x = mix.water_fill(np.array([0.5, 0.3, 0.2, 0.0]), np.array([10.0, 100, 100, 50]), 100)
    assert x == pytest.approx([10, 54, 36, 0])
    assert mix.water_fill(np.array([0.5, 0.5]), np.array([10.0, 20]), 100) == pytest.approx([10, 20])
    assert mix.water_fill(np.array([]), np.array([]), 10).sum() == 0


def test_mix_plan_and_draw(spark):
    docs = spark.createDataFrame([(i, "a" if i < 100 else "b") for i in range(2000)], "doc_id long, source string")
    sizes = spark.createDataFrame([("a", 100), ("b", 1900)], "source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("none", 0.2, 2), (None, 0.1, 1), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    plan = mix.mix_plan(sizes, targets)
    assert set(plan.loc[plan.misses, "source"]) == {"a", "none"}
    drawn = {r.source: r.c for r in mix.draw(docs, plan).groupBy("source").agg(F.sum("copies").alias("c")).collect()}
    assert drawn["a"] == 300 and abs(drawn["b"] - plan.set_index("source").planned_tokens["b"]) < 60
    again = mix.draw(docs, plan).select(F.bit_xor(F.xxhash64("doc_id", "copies"))).first()[0]
    assert again == mix.draw(docs.repartition(7), plan).select(F.bit_xor(F.xxhash64("doc_id", "copies"))).first()[0]


def test_token_counts(spark):
    ref = reference()
    df = spark.createDataFrame([(t,) for t in TEXTS if t is None or "\u0000" not in t], "text string")
    for r in mix.count_tokens(df, "text").collect():
        assert r.tokens == len(ref(r.text))


# ---- quality

def test_stats_edges():
    assert quality.text_stats(None) is None and quality.text_stats(" \n\t") is None
    s = dict(zip(quality._COLUMNS, quality.text_stats("It was late. We went home.")))
    assert s["n_words"] == 6 and s["end_punct_share"] == 1.0 and s["prose_share"] == 1.0
    assert dict(zip(quality._COLUMNS, quality.text_stats("folder dull\n" * 30)))["distinct_share"] < 0.2


def test_kinds_of_examples(spark):
    rows, kind = [], {}
    for k, texts in quality.EXAMPLES.items():
        for t in texts:
            for j in range(12):
                i = len(rows)
                words = t.split(" ")
                rows.append((i, " ".join(words[: max(4, len(words) - j % 3)])))
                kind[i] = k
    rows += [(9001, None), (9002, ""), (9003, "  ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    got = {r.doc_id: r.p_prose >= 0.5 for r in quality.classify(df, "doc_id", "text").collect()}
    assert set(got) == set(kind)
    assert np.mean([got[i] == (k == "prose") for i, k in kind.items()]) > 0.9
    assert quality.classify(df.filter("doc_id < 0"), "doc_id", "text").count() == 0


# ---- neighbours and clusters

def blobs(seed=0, dim=512):
    rng = np.random.default_rng(seed)
    rows, label, k = [], [], 0
    for c, n in enumerate([150, 40, 12, 5, 3, 2, 2, 1, 1] * 3):
        centre = rng.standard_normal(dim)
        for _ in range(n):
            rows.append((k, (rng.uniform(0.1, 30) * (centre + 0.7 * rng.standard_normal(dim))).astype(np.float32).tolist()))
            label.append(c)
            k += 1
    for i in (3, 151, 190):  # near copies
        rows.append((k, (np.array(rows[i][1]) + 0.02 * rng.standard_normal(dim)).tolist()))
        label.append(label[i])
        k += 1
    return rows, np.array(label)


BAD = [(9001, None), (9002, [1.0, 2.0]), (9003, [0.0] * 512), (9004, [float("nan")] + [1.0] * 511), (9005, [float("inf")] + [1.0] * 511), (9006, []), (None, [1.0] * 512)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows, label = blobs()
    extra = [(*r, "clash") for r in [*rows, *BAD, rows[0], rows[5]]]
    return spark.createDataFrame(extra, "id long, embedding array<float>, a string").repartition(6), rows, label


def near_ten(s):
    return {i: set(np.argsort(-s[i], kind="stable")[:10].tolist()) for i in range(len(s))}


def similarities(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return s


def recall(got, s, at_least):
    """Share of the true ten best of each row, of similarity ``at_least``, that are there."""
    want = {(i, j) for i, best in near_ten(s).items() for j in best if s[i, j] >= at_least}
    return len(want & got) / len(want)


def test_graph_recall(spark, vectors):
    df, rows, _ = vectors
    s = similarities(rows)
    g = neighbours.neighbour_graph(df, "id", "embedding", 512, fill=True)
    got = g.edges.collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(pairs) == len(got) and all(a != b for a, b in pairs)
    assert {r.a for r in got} == set(range(len(rows))) and max(pd.Series([r.a for r in got]).value_counts()) == 10
    assert recall(pairs, s, 0.35) > 0.95 and recall(pairs, s, 0.86) == 1
    inside = [(r.s, s[r.a, r.b]) for r in got if s[r.a, r.b] >= 0.5]
    assert np.max(np.abs(np.diff(inside, axis=1))) < 0.004
    exact = neighbours.exact_pairs(df, "id", "embedding", 512, g.edges.filter("s > 0.8")).collect()
    assert exact and all(abs(r.s - s[r.a, r.b]) < 1e-5 for r in exact)


def test_parts_in_blocks_and_descent(spark, vectors):
    """Blocks change nothing; above ``hubs`` members, hubs and descent keep most neighbours."""
    df, rows, _ = vectors
    s = similarities(rows)
    whole = {(r.a, r.b) for r in neighbours.neighbour_graph(df, "id", "embedding", 512).edges.collect()}
    blocks = {(r.a, r.b) for r in neighbours.neighbour_graph(df, "id", "embedding", 512, block=40).edges.collect()}
    assert whole == blocks
    hubs = {(r.a, r.b) for r in neighbours.neighbour_graph(df, "id", "embedding", 512, block=40, hubs=60).edges.collect()}
    assert recall(hubs, s, 0.35) > 0.8 and recall(hubs, s, 0.86) == 1


def test_equal_vectors(spark, vectors):
    """Copies are each other's first neighbours; all ids of a class get ten, however many there are."""
    df, rows, _ = vectors
    more = spark.createDataFrame([(5000 + i, rows[7][1], "x") for i in range(40)] + [(6000, rows[160][1], "x")], "id long, embedding array<float>, a string")
    got = neighbours.everyones_neighbours(df.unionByName(more), "id", "embedding", 512).collect()
    of = {}
    for r in got:
        of.setdefault(r.a, []).append((r.b, r.s))
    copies = [7, *range(5000, 5040)]
    for i in copies:
        assert sorted(b for b, _ in of[i]) == sorted([c for c in copies if c != i][:10]) and all(abs(v - 1) < 1e-6 for _, v in of[i])
    assert 6000 in {b for b, _ in of[160]} and 160 in {b for b, _ in of[6000]} and len(of[6000]) == 10
    assert all(a != b for a in of for b, _ in of[a]) and all(len({b for b, _ in v}) == len(v) <= 10 for v in of.values())
    c = {r.id: r.cluster for r in cluster.clusters(df.unionByName(more), "id", "embedding", 512).collect()}
    assert {c[i] for i in copies} == {c[7]} and c[6000] == c[160]


def test_search(spark, vectors, monkeypatch):
    df, rows, _ = vectors
    s = similarities(rows)
    monkeypatch.setattr(neighbours, "faces", lambda *_: df)
    hits = neighbours.p1_search(spark, "").collect()
    assert {h.q for h in hits} == {i for i in range(len(rows)) if i % 100 == 0}
    want = {(i, j) for i, best in near_ten(s).items() for j in best if i % 100 == 0 and s[i, j] >= 0.35}
    assert len(want & {(h.q, h.neighbour) for h in hits}) >= 0.9 * len(want)


def test_clusters(spark, vectors):
    df, rows, label = vectors
    got = {r.id: r.cluster for r in cluster.clusters(df, "id", "embedding", 512).collect()}
    assert len(got) == len(rows)
    t = pd.crosstab(pd.Series([got[i] for i in range(len(rows))]), label)
    assert t.shape[0] == len(set(label)) and (t > 0).sum().max() == 1


def test_large_nodes_are_split(spark, vectors):
    """Nodes above ``local`` come out as those that a task finishes."""
    df, rows, label = vectors
    got = {r.id: (r.cluster, r.closeness) for r in cluster.clusters(df, "id", "embedding", 512, local=20).collect()}
    t = pd.crosstab(pd.Series([got[i][0] for i in range(len(rows))]), label)
    assert t.shape[0] == len(set(label)) and (t > 0).sum().max() == 1


def test_many_groups_in_a_large_node(spark, monkeypatch):
    rng = np.random.default_rng(1)
    label = np.repeat(np.arange(12), 25)
    x = rng.standard_normal((12, 512))[label] + 0.6 * rng.standard_normal((300, 512))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    linked = cluster.linked_parts

    def chained(*a, **k):
        g = linked(*a, **k)
        g.parts = g.parts.withColumn("root", F.lit(0).cast("long"))
        return g

    monkeypatch.setattr(cluster, "linked_parts", chained)
    got = {r.id: (r.cluster, r.closeness) for r in cluster.clusters(df, "id", "embedding", 512, local=60).collect()}
    assert len(got) == 300
    t = pd.crosstab(pd.Series([got[i][0] for i in range(300)]), label)
    assert t.shape == (12, 12) and (t > 0).sum(axis=1).max() == 1 and min(c for _, c in got.values()) > 0


def test_local_does_not_change_clusters(spark, monkeypatch):
    """Noisy groups, some of which overlap, in one root: the same rows whatever a task may finish."""
    rng = np.random.default_rng(5)
    label = np.repeat(np.arange(4), [35, 25, 15, 10])
    centres = rng.standard_normal((4, 512))
    centres[1] += 0.9 * centres[0]
    centres[3] += 0.9 * centres[2]
    x = centres[label] + rng.uniform(1.0, 1.3, (len(label), 1)) * rng.standard_normal((len(label), 512))
    bits = np.packbits(x @ rng.standard_normal((512, neighbours.ALL_BITS)) > 0, axis=1)
    sketches = spark.createDataFrame([(int(i), v.tobytes()) for i, v in zip(rng.permutation(len(label)), bits)], "id long, bits binary").repartition(5)
    sketches = neighbours.cut(sketches)
    parts = sketches.select("id", F.lit(0).cast("long").alias("root"))
    first = sketches.select(F.col("id").alias("a")).crossJoin(sketches.select(F.col("id").alias("b"))).filter("a < b")
    monkeypatch.setattr(cluster, "linked_parts", lambda *a, **k: neighbours.Graph(None, sketches, None, parts, None, len(label), 1, first, None))
    rows = lambda local: sorted(tuple(r) for r in cluster.clusters(sketches, "id", "bits", 512, local=local).collect())
    whole = rows(cluster.LOCAL)
    assert len(whole) == len(label) and 4 < len({c for _, c, _ in whole}) < 14
    # small blocks take the leaves and rows of the root apart
    monkeypatch.setattr(cluster, "ROW_BLOCK", 50)
    monkeypatch.setattr(cluster, "LEAF_BLOCK", 4)
    monkeypatch.setattr(cluster, "HOT", 5)
    assert rows(40) == whole


def test_partitions_keep_groups_after_a_join(spark):
    rows = neighbours.cut(spark.range(4000).select((F.col("id") % 200).alias("node"), "id").repartition(6))
    none = neighbours.cut(spark.range(1000, 1001).select(F.col("id").alias("node")))
    sizes = lambda t: iter(t.group_by("node").aggregate([("id", "count")]).select(["node", "id_count"]).to_batches())
    parts = neighbours.parallelism(spark)
    got = neighbours.per_partition(rows.join(none, "node", "left_anti"), "node", sizes, "node long, n long", parts).collect()
    assert len(got) == 200 and all(r.n == 20 for r in got)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (101, 50)], "a long, b long")
    n = spark.createDataFrame([(i,) for i in [*range(41), 50, 100, 101, 200]], "id long")
    for limit in (0, 5, 1000):
        got = {r.id: r.root for r in neighbours.components(e, n, limit).collect()}
        check_roots(got)
    empty = e.filter("a < 0")
    assert all(r.id == r.root for r in neighbours.components(empty, n).collect())


def check_roots(got):
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (50, 100, 101)} == {50} and got[200] == 200


def test_empty_vectors(spark, vectors):
    df = vectors[0].filter("id = -1")
    assert neighbours.everyones_neighbours(df, "id", "embedding", 512).count() == 0
    assert cluster.clusters(df, "id", "embedding", 512).count() == 0


def test_bisect_keeps_groups():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, neighbours.ALL_BITS))
    lab = np.repeat(np.arange(5), [40, 10, 5, 2, 1])
    b = np.sign(base[lab] + 0.7 * rng.standard_normal((len(lab), neighbours.ALL_BITS))).astype(np.float32)
    leaf = cluster.bisect(b, 0.25)
    assert len(set(zip(leaf, lab))) == 5 and len(set(leaf)) == 5
