"""Hybrid retrieval: postings, BM25 channels, vector tiers and rank fusion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.vec import cosine
from lumora.registry import query
from lumora.tables import table
from lumora.views import SQL_CAP, SQL_FACE, captions, faces

RRF_K = 60
#: BM25 constants and the weights of the indexed fields.
K1, B = 1.2, 0.75
WEIGHTS = {"description": 3.8, "main_subject": 3.2, "keywords": 2.2, "face_identities": 2.6, "ocr_text": 0.6}
#: Channels as (name, weight, pool multiplier).
CHANNELS = (("strict", 1.0, 1), ("phrase", 1.2, 1), ("trigram", 0.8, 2), ("soft", 0.45, 2))
#: Weights of image and description ranks by semantic profile.
PROFILES = {"image_dominant": (1.0, 0.10), "balanced": (1.0, 0.25), "description_dominant": (0.6, 1.0)}
_TOKEN = r"[\p{L}\p{N}_]+"


def rrf(rank: Column) -> Column:
    """Reciprocal-rank score of a zero-based rank."""
    return 1.0 / (rank + 1 + RRF_K)


def tokens(text: Column) -> Column:
    """Lower-case word tokens of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_TOKEN})"), F.lit(1))


def query_tokens(q: str) -> list[str]:
    """Word tokens of a query, in order, repeats kept."""
    return re.findall(r"\w+", q.lower())


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, term, tf, length) of the named text fields."""
    per = docs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields])).alias("x"))
    per = per.select(key, "x.field", F.explode("x.t").alias("term"), F.size("x.t").alias("length"))
    return per.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """(key, term, score) for documents with a query term, fields weighted as in a multi-column full-text index.

    Term frequency and length are sums over fields, the frequency weighted;
    idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Only the query's terms
    are expanded, so postings of other words are never shuffled.
    """
    fields = list(weights)
    terms = list(dict.fromkeys(terms))
    tok = docs.select(key, *[tokens(F.col(f)).alias(f) for f in fields])
    length = reduce(lambda a, b: a + b, [F.size(f) for f in fields])
    stats = tok.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("avg_len"))

    def times(field: str, term: str) -> Column:
        return F.size(F.filter(F.col(field), lambda x: x == term))

    tfs = [
        F.struct(F.lit(t).alias("term"), reduce(lambda a, b: a + b, [times(f, t) * F.lit(w) for f, w in weights.items()]).alias("wtf"))
        for t in terms
    ]
    hits = tok.select(key, length.alias("len"), F.explode(F.array(*tfs)).alias("h")).select(key, "len", "h.*").filter("wtf > 0")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of statistics, and one per query term
    h = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    s = idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return h.select(key, "term", s.alias("score"))


def ranked(df: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """The ``limit`` best rows with a zero-based ``rank``; ties by key. The limit comes first, so the window is bounded."""
    top = df.orderBy(F.desc(score), F.asc(key)).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))) - 1)


def lexical(docs: DataFrame, key: str, q: str, limit: int = 40) -> DataFrame:
    """(key, score, channel): the four lexical channels fused by weighted reciprocal ranks."""
    terms = query_tokens(q)
    if not terms:
        return docs.select(key).withColumns({"score": F.lit(0.0), "channel": F.lit("")}).filter(F.lit(False))
    per = bm25(docs, key, WEIGHTS, terms)
    total = per.groupBy(key).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("hits"))
    blob = F.concat(F.lit(" "), F.concat_ws("  ", *[F.array_join(tokens(F.col(f)), " ") for f in WEIGHTS]), F.lit(" "))
    text = docs.select(key, blob.alias("blob"))
    grams = [" ".join(terms[i : i + 3]) for i in range(max(len(terms) - 2, 0))][:8]
    contains = lambda p: F.contains("blob", F.lit(f" {p} "))
    found = {"strict": total.filter(F.col("hits") == len(set(terms)))}
    if len(terms) > 1:
        found["phrase"] = total.join(text.filter(contains(" ".join(terms))).select(key), key, "left_semi")
    if len(grams) > 1:
        found["trigram"] = total.join(text.filter(reduce(lambda a, b: a | b, [contains(g) for g in grams])).select(key), key, "left_semi")
    if len(terms) > 1:
        found["soft"] = total
    parts = []
    for i, (name, weight, mult) in enumerate(CHANNELS):
        if name in found:
            r = ranked(found[name].select(key, "score"), key, "score", min(max(limit, 40) * mult, 5000))
            parts.append(r.select(key, (F.lit(weight) * rrf(F.col("rank"))).alias("part"), F.lit(i).alias("priority"), F.lit(name).alias("channel")))
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy(key).agg(F.sum("part").alias("score"), F.min_by("channel", "priority").alias("channel"))


def guard(docs: DataFrame, key: str, results: DataFrame, q: str) -> DataFrame:
    """Results that share enough of the query's words as substrings: all of up to two, two of three, else one."""
    need_of = query_tokens(q)
    if len(need_of) < 2:
        return results
    need = {2: 2, 3: 2}.get(len(need_of), 1)
    blob = F.lower(F.concat_ws(" ", *WEIGHTS))
    hits = reduce(lambda a, b: a + b, [F.contains(blob, F.lit(t)).cast("int") for t in need_of])
    return results.join(docs.filter(hits >= need).select(key), key, "left_semi")


_TOK = "regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_BM = f"""WITH {SQL_CAP},
  tok AS (SELECT image_id, {', '.join(_TOK.format(f=f) + ' AS ' + f for f in WEIGHTS)} FROM cap),
  l AS (SELECT *, {' + '.join(f'len({f})' for f in WEIGHTS)} AS length FROM tok),
  st AS (SELECT count(*) AS n_docs, avg(length) AS avg_len FROM l),
  h AS (SELECT image_id, length, term, {' + '.join(f'len(list_filter({f}, lambda x: x = term)) * {w}::DOUBLE' for f, w in WEIGHTS.items())} AS wtf FROM l, (SELECT unnest({{terms}}) AS term)),
  p AS (SELECT * FROM h WHERE wtf > 0), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  per_term AS (SELECT image_id, term, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (1 - 0.75 + 0.75 * length / avg_len)) AS score FROM p JOIN d USING (term), st),
  tot AS (SELECT image_id, sum(score) AS score, count(*) AS hits FROM per_term GROUP BY 1)"""
_Q = "old market"
_BLOB = "' ' || concat_ws('  ', " + ", ".join(f"array_to_string({f}, ' ')" for f in WEIGHTS) + ") || ' '"


@query("bm25_scores", _BM.replace("{terms}", "['market', 'bridge']") + " SELECT image_id, round(score, 6) AS score FROM tot")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    """R2: BM25 of every caption that has one of two words."""
    return bm25(captions(spark, d), "image_id", WEIGHTS, ["market", "bridge"]).groupBy("image_id").agg(F.round(F.sum("score"), 6).alias("score"))


def _channel_sql(where: str, limit: int) -> str:
    return f"SELECT image_id, row_number() OVER (ORDER BY round(score, 9) DESC, image_id) - 1 AS rank FROM ({where}) ORDER BY round(score, 9) DESC, image_id LIMIT {limit}"


@query(
    "fts_blend",
    _BM.replace("{terms}", "['old', 'market']")
    + f""", b AS (SELECT image_id, {_BLOB} AS blob FROM l),
      c1 AS ({_channel_sql('SELECT * FROM tot WHERE hits = 2', 40)}),
      c2 AS ({_channel_sql("SELECT tot.* FROM tot JOIN b USING (image_id) WHERE contains(blob, ' old market ')", 40)}),
      c4 AS ({_channel_sql('SELECT * FROM tot', 80)}),
      u AS (SELECT image_id, 1.0::DOUBLE / (rank + 61) AS part, 0 AS pr, 'strict' AS ch FROM c1 UNION ALL SELECT image_id, 1.2::DOUBLE / (rank + 61), 1, 'phrase' FROM c2
            UNION ALL SELECT image_id, 0.45::DOUBLE / (rank + 61), 3, 'soft' FROM c4)
      SELECT image_id, round(sum(part), 6) AS score, arg_min(ch, pr) AS channel FROM u GROUP BY 1""",
)
def fts_blend(spark: SparkSession, d: str) -> DataFrame:
    """The lexical channels of a query, fused."""
    c = captions(spark, d)
    return lexical(c, "image_id", _Q).select("image_id", F.round("score", 6).alias("score"), "channel")


@query("guard_overlap", f"WITH {SQL_CAP} SELECT image_id FROM cap WHERE contains(b, 'old') AND contains(b, 'market') ".replace("FROM cap", "FROM (SELECT image_id, lower(concat_ws(' ', " + ", ".join(WEIGHTS) + ")) AS b FROM cap)"))
def guard_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Captions that pass the consistency guard of a two-word query."""
    c = captions(spark, d)
    return guard(c, "image_id", c.select("image_id"), _Q)


@query("token_postings", f"WITH {SQL_CAP}, t AS (SELECT image_id, unnest({_TOK.format(f='description')}) AS term FROM cap) SELECT term, count(DISTINCT image_id) AS docs, count(*) AS occurrences FROM t GROUP BY 1")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of the index with document and term counts."""
    p = postings(captions(spark, d), "image_id", ["description"])
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"))


@query("search_text", f"WITH {SQL_CAP}, {SQL_FACE}, n AS (SELECT image_id, string_agg(DISTINCT identity_name, ' ' ORDER BY identity_name) AS names FROM face WHERE identity_name IS NOT NULL GROUP BY 1) SELECT image_id, concat_ws(' ', nullif(trim(description), ''), nullif(trim(main_subject), ''), nullif(trim(ocr_text), ''), names) AS text FROM cap LEFT JOIN n USING (image_id)")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    """The text indexed for each image, with the names on it."""
    n = faces(spark, d, "image_id", "identity_name").filter("identity_name is not null").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("identity_name")), " ").alias("names"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return captions(spark, d).join(n, "image_id", "left").select("image_id", F.concat_ws(" ", full("description"), full("main_subject"), full("ocr_text"), "names").alias("text"))


def seed_similar(vectors: DataFrame, key: str, vector: str, seed: int, k: int) -> DataFrame:
    """The ``k`` vectors most similar to that of one key, itself excluded."""
    one = vectors.filter(F.col(key) == seed).select(F.col(vector).alias("_seed")).limit(1)
    s = vectors.filter(F.col(key) != seed).join(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("_seed")), 6).alias("similarity"))
    return s.orderBy(F.desc("similarity"), key).limit(k)


def cosine_sql(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


@query("knn_similar", f"SELECT e.vec_id, {cosine_sql('e.embedding', 's.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) s WHERE e.vec_id <> 7 ORDER BY similarity DESC, e.vec_id LIMIT 20")
def knn_similar(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors to a seed."""
    return seed_similar(table(spark, d, "embeddings"), "vec_id", "embedding", 7, 20)


_SIM = f"s AS (SELECT e.vec_id, label, {cosine_sql('e.embedding', 'q.embedding')} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


def _seed_sims(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(one)).select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@query("zscore_gate", f"WITH {_SIM} SELECT vec_id, round((sim - m) / sd, 6) AS z FROM s, (SELECT avg(sim) AS m, stddev_pop(sim) AS sd FROM s) WHERE (sim - m) / sd >= 1.5")
def zscore_gate(spark: SparkSession, d: str) -> DataFrame:
    """G-A19 R9: vectors whose similarity stands out of the population."""
    s = _seed_sims(spark, d)
    st = s.agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("sd"))
    z = (F.col("sim") - F.col("m")) / F.col("sd")
    return s.join(F.broadcast(st)).filter(z >= 1.5).select("vec_id", F.round(z, 6).alias("z"))


_PROF = """i AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS r FROM (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 160)),
  dd AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS r FROM (SELECT * FROM s WHERE label < 5 ORDER BY sim DESC, vec_id LIMIT 160))"""


@query("semantic_two_tier", f"WITH {_SIM}, {_PROF} SELECT i.vec_id, round(1.0::DOUBLE / (i.r + 61) + coalesce(0.25::DOUBLE / (dd.r + 61), 0), 6) AS score FROM i LEFT JOIN dd USING (vec_id)")
def semantic_two_tier(spark: SparkSession, d: str) -> DataFrame:
    """Image ranks with description ranks added, balanced profile."""
    s = _seed_sims(spark, d)
    wi, wd = PROFILES["balanced"]
    i = ranked(s, "vec_id", "sim", 160).select("vec_id", F.col("rank").alias("ri"))
    t = ranked(s.filter("label < 5"), "vec_id", "sim", 160).select("vec_id", F.col("rank").alias("rd"))
    score = wi * rrf(F.col("ri")) + F.coalesce(wd * rrf(F.col("rd")), F.lit(0.0))
    return i.join(t, "vec_id", "left").select("vec_id", F.round(score, 6).alias("score"))


def hybrid(text: DataFrame, semantic: DataFrame, key: str, weight: float, limit: int) -> DataFrame:
    """Rank fusion of two scored lists; from a weight of 0.5 on, few purely lexical candidates are let in."""
    pool = min(4 * limit, 5000)
    t = ranked(text, key, "score", pool).select(key, F.col("rank").alias("rt"))
    s = ranked(semantic, key, "score", pool).select(key, F.col("rank").alias("rs"))
    both = t.join(s, key, "full_outer")
    if weight >= 0.5:
        both = both.filter(F.col("rs").isNotNull() | (F.col("rt") < max(limit, min(pool // 3, 200))))
    score = (1 - weight) * F.coalesce(rrf(F.col("rt")), F.lit(0.0)) + weight * F.coalesce(rrf(F.col("rs")), F.lit(0.0))
    return both.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


@query(
    "hybrid_fusion",
    f"""WITH {_SIM}, t AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS rt FROM (SELECT * FROM embeddings ORDER BY label, vec_id LIMIT 160)),
      i AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS rs FROM (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 160)),
      f AS (SELECT vec_id, 0.4::DOUBLE * coalesce(1.0::DOUBLE / (rt + 61), 0) + 0.6::DOUBLE * coalesce(1.0::DOUBLE / (rs + 61), 0) AS x FROM t FULL JOIN i USING (vec_id) WHERE rs IS NOT NULL OR rt < 53)
      SELECT vec_id, round(x, 6) AS score FROM f ORDER BY round(x, 6) DESC, vec_id LIMIT 40""",
)
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and semantic ranks fused at weight 0.6."""
    e = table(spark, d, "embeddings").select("vec_id", (-F.col("label")).cast("double").alias("score"))
    return hybrid(e, _seed_sims(spark, d).select("vec_id", F.col("sim").alias("score")), "vec_id", 0.6, 40)


def name_score(name: Column, q: str) -> Column:
    """0 equal, 1 a token, 2 a token's start (three letters on), 3 inside; null otherwise."""
    n, s = F.lower(F.trim(name)), q.strip().lower()
    toks = F.split(n, r"\s+")
    out = F.when(n == s, 0).when(F.array_contains(toks, s), 1)
    if len(s) >= 3:
        out = out.when(F.exists(toks, lambda t: F.startswith(t, F.lit(s))), 2)
    return out.when(F.contains(n, F.lit(s)), 3)


@query(
    "name_match",
    """WITH m AS (SELECT id, name, CASE WHEN lower(trim(name)) = 'tis' THEN 0 WHEN list_contains(string_split(lower(trim(name)), ' '), 'tis') THEN 1
      WHEN len(list_filter(string_split(lower(trim(name)), ' '), lambda t: starts_with(t, 'tis'))) > 0 THEN 2 WHEN contains(lower(name), 'tis') THEN 3 END AS score FROM face_persons)
      SELECT id, name, score FROM m WHERE score = (SELECT min(score) FROM m)""",
)
def name_match(spark: SparkSession, d: str) -> DataFrame:
    """Persons that match a name best."""
    m = table(spark, d, "face_persons").select("id", "name", name_score(F.col("name"), "tis").alias("score")).filter("score is not null")
    return m.join(F.broadcast(m.agg(F.min("score").alias("score"))), "score")


_RES = f"""{SQL_FACE}, r AS (SELECT image_id, 1 AS pr FROM face JOIN face_persons p ON p.id = person_id WHERE lower(p.name) = 'elnyka phoim'
  UNION ALL SELECT image_id, 2 FROM face JOIN face_cluster_labels USING (cluster_id) WHERE lower(display_name) = 'elnyka phoim'
  UNION ALL SELECT image_id, 3 FROM face WHERE lower(identity_name) = 'elnyka phoim')"""


@query("alias_resolution", f"WITH {_RES} SELECT image_id, min(pr) AS source FROM r GROUP BY 1")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Images of a name, by person, cluster label or identity, in that order."""
    return resolve_face(spark, d, "Elnyka Phoim")


def resolve_face(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(image_id, source) of a name: 1 person, 2 cluster label, 3 identity."""
    f, low = faces(spark, d, "image_id", "person_id", "cluster_id", "identity_name"), name.lower()
    p = table(spark, d, "face_persons").filter(F.lower("name") == low).select(F.col("id").alias("person_id"))
    c = table(spark, d, "face_cluster_labels").filter(F.lower("display_name") == low).select("cluster_id")
    parts = [
        f.join(p, "person_id", "left_semi").select("image_id", F.lit(1).alias("source")),
        f.join(c, "cluster_id", "left_semi").select("image_id", F.lit(2).alias("source")),
        f.filter(F.lower("identity_name") == low).select("image_id", F.lit(3).alias("source")),
    ]
    return reduce(DataFrame.union, parts).groupBy("image_id").agg(F.min("source").alias("source"))


@query("multi_entity_all", "SELECT image_id FROM face_occurrences WHERE person_id IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT person_id) >= 2")
def multi_entity_all(spark: SparkSession, d: str) -> DataFrame:
    """Images that show at least two of three persons."""
    f = table(spark, d, "face_occurrences").filter(F.col("person_id").isin(1, 2, 3))
    return f.groupBy("image_id").agg(F.count_distinct("person_id").alias("n")).filter("n >= 2").select("image_id")


@query("multi_entity_any", "SELECT image_id, count(DISTINCT person_id)::DOUBLE AS score FROM face_occurrences WHERE person_id IN (1, 2, 3) GROUP BY 1")
def multi_entity_any(spark: SparkSession, d: str) -> DataFrame:
    """Images that show any of three persons, with their score."""
    f = table(spark, d, "face_occurrences").filter(F.col("person_id").isin(1, 2, 3))
    return f.groupBy("image_id").agg(F.count_distinct("person_id").cast("double").alias("score"))


_MULTI = ("market", "bridge", "lantern")


@query(
    "rrf_multi_term",
    "WITH " + SQL_CAP + ", " + ", ".join(f"t{i} AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS r FROM (SELECT image_id FROM cap WHERE contains(lower(description), '{w}') ORDER BY image_id LIMIT 200))" for i, w in enumerate(_MULTI))
    + " SELECT image_id, round(sum(1.0::DOUBLE / (61 + r)), 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(3)) + ") GROUP BY 1",
)
def rrf_multi_term(spark: SparkSession, d: str) -> DataFrame:
    """Several terms fused by their ranks."""
    c = captions(spark, d).select("image_id", F.lower("description").alias("t"))
    parts = [ranked(c.filter(F.contains("t", F.lit(w))).withColumn("s", F.lit(0)), "image_id", "s", 200).select("image_id", rrf(F.col("rank")).alias("p")) for w in _MULTI]
    return reduce(DataFrame.union, parts).groupBy("image_id").agg(F.round(F.sum("p"), 6).alias("score"))


@query("rich_set", f"WITH {SQL_CAP} SELECT image_id, max(length(description) + length(coalesce(ocr_text, ''))) AS richness FROM cap WHERE description IS NOT NULL GROUP BY 1 HAVING max(length(description) + length(coalesce(ocr_text, ''))) >= 100")
def rich_set(spark: SparkSession, d: str) -> DataFrame:
    """G-A16: images with much to read."""
    n = (F.length("description") + F.length(F.coalesce("ocr_text", F.lit("")))).alias("richness")
    return captions(spark, d).filter("description is not null").select("image_id", n).filter("richness >= 100")

