"""One search from request to page: terms, candidates, filters, order, page, enrichment.

The index is a table of five text columns an image (:func:`search_documents`),
built once and stored by :func:`store_index`; a search reads the columns it
needs and never builds the index again when it is given the stored one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.dates import day_part
from lumora.functions.vec import cosine
from lumora.operators.search import B, CHANNELS, K1, PROFILES, RRF_K, ranked, resolve_face, rrf, tokens
from lumora.plans.request import SearchRequest
from lumora.registry import query
from lumora.session import cut
from lumora.tables import table
from lumora.views import SQL_CAP, SQL_FACE, SQL_IMG, SQL_META, SQL_PER, captions, faces, images, metadata, perception

#: BM25 weights of the index columns, and bounds on pools and terms.
COLUMNS = {"description": 3.8, "subjects": 3.2, "keywords": 2.2, "names": 2.6, "exif": 0.6}
POOL, TERMS, GRAMS, SOFT, Z_MIN, RICH = 5000, 8, 8, 16, 1.5, 100
_PARTS = {
    "subjects": ("main_subject", "scene_type", "mood", "lighting"),
    "keywords": ("keywords", "detected_objects"),
    "exif": ("camera_make", "camera_model", "lens_model", "location_city", "location_state", "location_country"),
}
#: What a range filter of a request may name.
RANGES = ("iso", "f_number", "focal_length", "gps_altitude", "perception_iaa", "perception_iqa", "perception_ista", "face_count")


# ---- terms of a query

def quoted_phrases(q: str) -> list[str]:
    """Phrases in double or single quotes, blanks normalised, each once whatever its case."""
    found = (" ".join((a or b).split()) for a, b in re.findall(r"\"([^\"]+)\"|'([^']+)'", q))
    return list({p.casefold(): p for p in reversed([p for p in found if p])}.values())[::-1]


def words_of(q: str) -> list[str]:
    """Word tokens of a query in lower case, without underscores around them; repeats stay."""
    return [w for w in (t.strip("_") for t in re.findall(r"\w+", q.lower())) if w]


def safe_match(q: str) -> str:
    """A query as an AND of quoted words, without any operator of a full-text language."""
    return " AND ".join(f'"{w}"' for w in words_of(q))


def channels_of(q: str) -> dict[str, list[list[str]]]:
    """The word sequences that each lexical channel looks for; one equal to an earlier one is left out."""
    words = words_of(q)
    grams = list(dict.fromkeys(tuple(words[i : i + 3]) for i in range(len(words) - 2)))[:GRAMS]
    soft = list(dict.fromkeys([w for w in words if len(w) >= 4] or words))[:SOFT]
    wanted = {
        "strict": [[w] for w in dict.fromkeys(words)],
        "phrase": [p for p in (words_of(x) for x in quoted_phrases(q)) if p],
        "trigram": [list(g) for g in grams],
        "soft": [[w] for w in soft],
    }
    out: dict[str, list[list[str]]] = {}
    for name, seqs in wanted.items():
        one_word = name in ("strict", "soft") and len(seqs) == 1 and any(v == seqs for k, v in out.items() if k == "strict")
        if seqs and not one_word:
            out[name] = seqs
    return out


# ---- the index

def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five text columns of each image with a caption or metadata: names once each, in order."""
    f = faces(spark, d, "image_id", "identity_name", "person_id")
    p = table(spark, d, "face_persons").select(F.col("id").alias("person_id"), "name")
    named = f.join(p, "person_id", "left").select("image_id", F.explode(F.array("identity_name", "name")).alias("n")).filter("trim(n) <> ''")
    names = named.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("n")), " ").alias("names"))
    m = metadata(spark, d).select("image_id", *_PARTS["exif"])
    c = captions(spark, d).select("image_id", "description", *_PARTS["subjects"], *_PARTS["keywords"])
    joined = c.join(m, "image_id", "full_outer").join(names, "image_id", "left")
    full = lambda x: F.nullif(F.trim(F.col(x)), F.lit(""))
    parts = {k: F.concat_ws(" ", *[full(x) for x in v]) for k, v in _PARTS.items()}
    return joined.select("image_id", F.coalesce("description", F.lit("")).alias("description"), parts["subjects"].alias("subjects"), parts["keywords"].alias("keywords"), F.coalesce("names", F.lit("")).alias("names"), parts["exif"].alias("exif"))


def store_index(spark: SparkSession, d: str, path: str) -> DataFrame:
    """Write the index to ``path`` and read it back; searches take the result as ``docs``."""
    search_documents(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- candidates

def _blob(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def text_candidates(docs: DataFrame, q: str, limit: int = POOL) -> DataFrame:
    """(image_id, score, channel) of the lexical channels fused by rank, then guarded.

    A document's score in a channel is the BM25 of the words the channel looks
    for. Ranks are given before the guard, so what it removes leaves gaps.
    """
    channels = channels_of(q)
    if not channels:
        return docs.select("image_id", F.lit(0.0).alias("score"), F.lit("").alias("channel")).filter(F.lit(False))
    words = list(dict.fromkeys(w for seqs in channels.values() for s in seqs for w in s))
    tok = docs.select("image_id", *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    length = reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS])
    times = lambda w: reduce(lambda a, b: a + b, [F.size(F.filter(F.col(c), lambda x: x == w)) * F.lit(k) for c, k in COLUMNS.items()])
    has = lambda s: reduce(lambda a, b: a | b, [F.contains(_blob(F.col(c)), F.lit(f" {' '.join(s)} ")) for c in COLUMNS])
    flags = {n: reduce(lambda a, b: a | b, [has(s) for s in channels[n]]) for n in ("phrase", "trigram") if n in channels}
    flat = tok.select("image_id", length.alias("len"), *[times(w).alias(f"w{i}") for i, w in enumerate(words)], *[v.alias(n) for n, v in flags.items()])
    # one pass over the texts: a few numbers for each document, from which statistics and channels are read
    flat = cut(flat)
    # one row of statistics: documents, mean length, documents of each word
    stats = flat.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    hit = flat.filter(reduce(lambda a, b: a | b, [F.col(f"w{i}") > 0 for i in range(len(words))])).join(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    score = {}
    for i, w in enumerate(words):
        idf = F.greatest(F.log((F.col("n_docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-6))
        score[w] = idf * F.col(f"w{i}") * (K1 + 1) / (F.col(f"w{i}") + norm)
    parts = []
    for priority, (name, weight, mult) in enumerate(CHANNELS):
        if name not in channels:
            continue
        own = list(dict.fromkeys(w for s in channels[name] for w in s))
        at = [F.col(f"w{words.index(w)}") > 0 for w in own]
        match = reduce(lambda a, b: a & b, at) if name == "strict" else reduce(lambda a, b: a | b, at) if name == "soft" else F.col(name)
        total = F.round(reduce(lambda a, b: a + b, [score[w] for w in own]), 9).alias("score")
        r = ranked(hit.filter(match).select("image_id", total), "image_id", "score", min(max(limit, 40) * mult, POOL))
        parts.append(r.select("image_id", (F.lit(weight) * rrf(F.col("rank"))).alias("part"), F.lit(priority).alias("priority"), F.lit(name).alias("channel")))
    fused = reduce(DataFrame.unionByName, parts).groupBy("image_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min_by("channel", "priority").alias("channel"))
    need = words_of(q)
    if len(need) < 2:
        return fused
    low = F.lower(F.concat_ws(" ", *COLUMNS))
    overlap = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in need])
    return fused.join(docs.filter(overlap >= {2: 2, 3: 2}.get(len(need), 1)).select("image_id"), "image_id", "left_semi")


def semantic_candidates(vectors: DataFrame, wanted: list[float], limit: int = POOL, profile: str = "balanced") -> DataFrame:
    """(image_id, tier, score) from image and description vectors.

    ``vectors`` has ``image_id``, ``kind`` ('image' or 'description') and ``v``.
    Tier 1 are the nearest images, with the ranks of their descriptions added;
    tier 2 are images known by description alone that stand out of all
    descriptions by ``Z_MIN`` standard deviations, by plain similarity.
    """
    wi, wd = PROFILES.get((profile or "balanced").strip().lower().replace("-", "_"), PROFILES["balanced"])
    q = F.array(*[F.lit(float(x)) for x in wanted])
    sims = vectors.select("image_id", "kind", F.round(cosine(F.col("v"), q), 9).alias("sim"))
    image, text = sims.filter("kind = 'image'").select("image_id", "sim"), sims.filter("kind = 'description'").select("image_id", "sim")
    i = ranked(image, "image_id", "sim", limit).select("image_id", F.col("rank").alias("ri"))
    t = ranked(text.join(image.select("image_id"), "image_id", "left_semi"), "image_id", "sim", limit).select("image_id", F.col("rank").alias("rd"))
    one = i.join(t, "image_id", "left").select("image_id", F.lit(1).alias("tier"), F.round(wi * rrf(F.col("ri")) + F.coalesce(wd * rrf(F.col("rd")), F.lit(0.0)), 9).alias("score"))
    st = text.agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("sd"))
    alone = text.join(image.select("image_id"), "image_id", "left_anti").join(F.broadcast(st)).filter(F.col("sim") >= F.col("m") + Z_MIN * F.col("sd"))
    return one.unionByName(alone.select("image_id", F.lit(2).alias("tier"), F.col("sim").alias("score")))


def _ranks(df: DataFrame, order: list[Column], limit: int, name: str) -> DataFrame:
    """(image_id, ``name``): zero-based ranks of the first ``limit`` rows."""
    from pyspark.sql import Window

    return df.orderBy(*order).limit(limit).select("image_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias(name))


def hybrid_candidates(text: DataFrame, semantic: DataFrame, weight: float, limit: int) -> DataFrame:
    """(image_id, score) of both lists fused by rank; from weight 0.5 on few purely lexical ones get in."""
    pool = min(4 * limit, POOL)
    t = _ranks(text, [F.desc("score"), F.asc("image_id")], pool, "rt")
    s = _ranks(semantic, [F.asc("tier"), F.desc("score"), F.asc("image_id")], pool, "rs")
    both = t.join(s, "image_id", "full_outer")
    if weight >= 0.5:
        both = both.filter(F.col("rs").isNotNull() | (F.col("rt") < max(limit, min(pool // 3, 200))))
    score = (1 - weight) * F.coalesce(rrf(F.col("rt")), F.lit(0.0)) + weight * F.coalesce(rrf(F.col("rs")), F.lit(0.0))
    return both.select("image_id", F.round(score, 9).alias("score"))


def face_candidates(spark: SparkSession, d: str, names: tuple[str, ...], match: str = "all") -> DataFrame:
    """(image_id, score) of the images that show all or any of the names, one point a name."""
    names = tuple({n.strip().casefold(): n.strip() for n in names if n.strip()}.values())
    hits = reduce(DataFrame.unionByName, [resolve_face(spark, d, n).select("image_id", F.lit(n).alias("name")) for n in names])
    need = len(names) if match == "all" else 1
    return hits.groupBy("image_id").agg(F.count_distinct("name").cast("double").alias("score")).filter(F.col("score") >= need)


def candidates(spark: SparkSession, d: str, req: SearchRequest, docs: DataFrame, vectors: DataFrame | None, wanted: dict[str, list[float]]) -> DataFrame | None:
    """(image_id, score) for what the request asks; None where it asks for nothing but filters."""
    if req.similar_to is not None:
        seed = vectors.filter(F.col("image_id") == req.similar_to).orderBy(F.desc("kind")).select("kind", "v").head(1)
        if not seed:
            return images(spark, d).select("image_id", F.lit(0.0).alias("score")).filter(F.lit(False))
        own = vectors.filter((F.col("kind") == seed[0].kind) & (F.col("image_id") != req.similar_to))
        return own.select("image_id", F.round(cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in seed[0].v])), 9).alias("score"))
    terms = req.terms() if req.mode != "browse" else []
    people = face_candidates(spark, d, req.faces, req.face_match) if req.faces else None
    if not terms:
        return people
    if people is not None:  # the text is searched among the images of the faces only
        docs = docs.join(people.select("image_id"), "image_id", "left_semi")
        vectors = vectors.join(people.select("image_id"), "image_id", "left_semi") if vectors is not None else None

    def one(term: str) -> DataFrame:
        if req.mode == "text" or vectors is None or term not in wanted:
            return text_candidates(docs, term).select("image_id", "score")
        sem = semantic_candidates(vectors, wanted[term], profile=req.semantic_profile)
        if req.mode == "semantic":
            # tiers follow each other: the second continues below the first
            return _ranks(sem, [F.asc("tier"), F.desc("score"), F.asc("image_id")], POOL, "r").select("image_id", F.round(rrf(F.col("r")), 9).alias("score"))
        return hybrid_candidates(text_candidates(docs, term).select("image_id", "score"), sem, req.semantic_weight, req.offset + req.limit)

    if len(terms) == 1:
        return one(terms[0])
    lists = [_ranks(one(t), [F.desc("score"), F.asc("image_id")], POOL, "r").select("image_id", (1.0 / (RRF_K + 1 + F.col("r"))).alias("part")) for t in terms]
    return reduce(DataFrame.unionByName, lists).groupBy("image_id").agg(F.round(F.sum("part"), 9).alias("score"))


# ---- filters, order and page

def features(spark: SparkSession, d: str) -> DataFrame:
    """What filters and orders need of each image; unused columns are never read."""
    return images(spark, d).join(metadata(spark, d), "image_id", "left").join(captions(spark, d), "image_id", "left").join(perception(spark, d), "image_id", "left")


def filtered(f: DataFrame, req: SearchRequest) -> DataFrame:
    """Rows that pass the request's filters; a range never holds for a missing value."""
    for name, (low, high) in req.ranges.items():
        if name not in RANGES:
            raise ValueError(f"no range filter on {name}")
        f = f.filter(F.col(name) >= low) if low is not None else f
        f = f.filter(F.col(name) <= high) if high is not None else f
    if req.month_day:
        f = f.filter(F.date_format("taken", "MM-dd") == req.month_day)
    if req.time_of_day:
        f = f.filter(day_part(F.col("taken")) == req.time_of_day)
    if req.has_people is not None:
        f = f.filter(F.coalesce(F.col("has_people") == 1, F.lit(False)) == F.lit(req.has_people))
    return f


_BEST = "round(12 * coalesce(perception_iaa, 0) + 0.25 * coalesce(perception_iqa, 0) * 10 - 120 * coalesce((10 - perception_ista) / 100, 0), 6)"
_ORDERS = {
    "relevance": "score DESC NULLS LAST",
    "best": f"{_BEST} DESC",
    "aesthetic": "perception_iaa DESC NULLS LAST",
    "sharpness": "perception_iqa DESC NULLS LAST",
    "cleanest": "perception_ista ASC NULLS FIRST",
    "newest": "taken DESC NULLS LAST",
}


def search(
    spark: SparkSession, d: str, req: SearchRequest, docs: DataFrame | None = None, vectors: DataFrame | None = None, wanted: dict[str, list[float]] | None = None
) -> DataFrame:
    """One page of a search, best first: (image_id, position, score, face_clusters).

    ``docs`` is a stored index; ``wanted`` gives the vector of each term, made
    outside. Filters apply to the candidates of all terms; only images of the
    page are joined with their face clusters. Offsets from 5,000 on are empty.
    """
    from pyspark.sql import Window

    found = candidates(spark, d, req, search_documents(spark, d) if docs is None else docs, vectors, wanted or {})
    f = filtered(features(spark, d), req)
    f = f.join(found, "image_id") if found is not None else f.withColumn("score", F.lit(None).cast("double"))
    sort = "newest" if req.sort == "relevance" and found is None else req.sort
    order = [F.expr(_ORDERS[sort].split(" DESC")[0].split(" ASC")[0]).alias("_o"), "image_id", "score"]
    keyed = f.select(*order)
    by = [F.asc_nulls_first("_o")] if " ASC" in _ORDERS[sort] else [F.desc_nulls_last("_o")]
    by.append(F.asc("image_id"))
    if req.offset >= POOL:
        keyed = keyed.filter(F.lit(False))
    top = keyed.orderBy(*by).limit(req.offset + req.limit)
    page = top.select("image_id", "score", F.row_number().over(Window.orderBy(*by)).alias("position")).filter(F.col("position") > req.offset)
    own = faces(spark, d, "image_id", "cluster_id").filter("cluster_id is not null").join(F.broadcast(page.select("image_id")), "image_id", "left_semi")
    clusters = own.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("cluster_id")), lambda x: x.cast("string")), ",").alias("face_clusters"))
    return page.join(clusters, "image_id", "left").select("image_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"), "face_clusters")


# ---- registered searches and their twins

_T = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_DOCS = f"""{SQL_IMG}, {SQL_META}, {SQL_CAP}, {SQL_PER}, {SQL_FACE},
  nm AS (SELECT image_id, string_agg(n, ' ' ORDER BY n) AS names FROM (SELECT DISTINCT image_id, n FROM (SELECT image_id, unnest([identity_name, name]) AS n FROM face LEFT JOIN face_persons p ON p.id = person_id) WHERE trim(n) <> '') GROUP BY 1),
  docs AS (SELECT coalesce(cap.image_id, meta.image_id) AS image_id, coalesce(description, '') AS description, {', '.join("concat_ws(' ', " + ', '.join(f"nullif(trim({c}), '')" for c in v) + f') AS {k}' for k, v in _PARTS.items())}, coalesce(names, '') AS names
    FROM cap FULL JOIN meta USING (image_id) LEFT JOIN nm ON nm.image_id = coalesce(cap.image_id, meta.image_id)),
  feat AS (SELECT * FROM img LEFT JOIN meta USING (image_id) LEFT JOIN cap USING (image_id) LEFT JOIN per USING (image_id))"""


def _text_sql(tag: str, q: str, limit: int = POOL, docs: str = "docs") -> str:
    """Common table expressions that end in ``{tag}`` (image_id, score) for one term."""
    channels = channels_of(q)
    words = list(dict.fromkeys(w for seqs in channels.values() for s in seqs for w in s))
    tf = lambda w: " + ".join(f"len(list_filter({c}, lambda x: x = '{w}')) * {k}::DOUBLE" for c, k in COLUMNS.items())
    has = lambda s: " OR ".join(f"contains(' ' || array_to_string({c}, ' ') || ' ', ' {' '.join(s)} ')" for c in COLUMNS)
    cols = [f"({tf(w)}) AS w{i}" for i, w in enumerate(words)]
    cols += [f"({' OR '.join('(' + has(s) + ')' for s in channels[n])}) AS {n}" for n in ("phrase", "trigram") if n in channels]
    score = lambda i: f"greatest(ln((n_docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * w{i} * 2.2 / (w{i} + 1.2 * (1 - 0.75 + 0.75 * length / avg_len))"
    out = [
        f"{tag}_k AS (SELECT image_id, {', '.join(_T.format(c) + ' AS ' + c for c in COLUMNS)} FROM {docs})",
        f"{tag}_f AS (SELECT image_id, {' + '.join(f'len({c})' for c in COLUMNS)} AS length, {', '.join(cols)} FROM {tag}_k)",
        f"{tag}_s AS (SELECT count(*) AS n_docs, avg(length) AS avg_len, {', '.join(f'count(*) FILTER (w{i} > 0) AS d{i}' for i in range(len(words)))} FROM {tag}_f)",
    ]
    unions = []
    for priority, (name, weight, mult) in enumerate(CHANNELS):
        if name not in channels:
            continue
        own = [words.index(w) for w in dict.fromkeys(w for s in channels[name] for w in s)]
        match = {"strict": " AND ".join(f"w{i} > 0" for i in own), "soft": " OR ".join(f"w{i} > 0" for i in own)}.get(name, name)
        some = " OR ".join(f"w{i} > 0" for i in range(len(words)))
        out.append(f"{tag}_{name} AS (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id) - 1 AS r FROM (SELECT image_id, round({' + '.join(score(i) for i in own)}, 9) AS score FROM {tag}_f, {tag}_s WHERE ({match}) AND ({some})) ORDER BY score DESC, image_id LIMIT {min(max(limit, 40) * mult, POOL)})")
        unions.append(f"SELECT image_id, {weight}::DOUBLE / (r + 61) AS part FROM {tag}_{name}")
    need = words_of(q)
    low = "lower(concat_ws(' ', " + ", ".join(COLUMNS) + "))"
    guard = "" if len(need) < 2 else f" WHERE image_id IN (SELECT image_id FROM {docs} WHERE {' + '.join(f'contains({low}, {chr(39)}{w}{chr(39)})::INT' for w in need)} >= {({2: 2, 3: 2}).get(len(need), 1)})"
    out.append(f"{tag} AS (SELECT * FROM (SELECT image_id, round(sum(part), 9) AS score FROM ({' UNION ALL '.join(unions)}) GROUP BY 1){guard})")
    return ",\n  ".join(out)


def _page_sql(found: str | None, where: str = "true", sort: str = "relevance", limit: int = 50, offset: int = 0) -> str:
    src = f"feat JOIN {found} USING (image_id)" if found else "(SELECT *, NULL::DOUBLE AS score FROM feat)"
    return f""", pg AS (SELECT image_id, score, row_number() OVER (ORDER BY {_ORDERS[sort]}, image_id) AS position FROM {src} WHERE {where}),
  fc AS (SELECT image_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) AS face_clusters FROM (SELECT DISTINCT image_id, cluster_id FROM face WHERE cluster_id IS NOT NULL) GROUP BY 1)
  SELECT image_id, position, round(score, 6) AS score, face_clusters FROM pg LEFT JOIN fc USING (image_id) WHERE position > {offset} AND position <= {offset + limit}"""


_VEC = "vectors AS (SELECT vec_id AS image_id, 'image' AS kind, embedding AS v FROM embeddings WHERE label >= 2 UNION ALL SELECT vec_id, 'description', embedding FROM embeddings WHERE label < 6)"
_SEM = f"""{_VEC}, sims AS (SELECT image_id, kind, round(list_cosine_similarity(v::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 9) AS sim FROM vectors),
  si AS (SELECT image_id, row_number() OVER (ORDER BY sim DESC, image_id) - 1 AS r FROM sims WHERE kind = 'image' ORDER BY sim DESC, image_id LIMIT 5000),
  sd AS (SELECT image_id, row_number() OVER (ORDER BY sim DESC, image_id) - 1 AS r FROM sims WHERE kind = 'description' AND image_id IN (SELECT image_id FROM sims WHERE kind = 'image') ORDER BY sim DESC, image_id LIMIT 5000),
  st AS (SELECT avg(sim) AS m, stddev_pop(sim) AS s FROM sims WHERE kind = 'description'),
  sem AS (SELECT si.image_id, 1 AS tier, round(1.0::DOUBLE / (si.r + 61) + coalesce(0.25::DOUBLE / (sd.r + 61), 0), 9) AS score FROM si LEFT JOIN sd USING (image_id)
    UNION ALL SELECT image_id, 2, sim FROM sims, st WHERE kind = 'description' AND image_id NOT IN (SELECT image_id FROM sims WHERE kind = 'image') AND sim >= m + 1.5 * s),
  semr AS (SELECT image_id, row_number() OVER (ORDER BY tier, score DESC, image_id) - 1 AS r FROM sem)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings")
    image = e.filter("label >= 2").select(F.col("vec_id").alias("image_id"), F.lit("image").alias("kind"), F.col("embedding").alias("v"))
    text = e.filter("label < 6").select(F.col("vec_id").alias("image_id"), F.lit("description").alias("kind"), F.col("embedding").alias("v"))
    return image.unionByName(text), list(e.filter("vec_id = 7").head(1)[0].embedding)


_TEXT = {"query": 'old "stone bridge" market', "mode": "text", "limit": 60}


@query("search_page_text", f"WITH {_DOCS}, {_text_sql('t', _TEXT['query'])} {_page_sql('t', limit=60)}")
def search_page_text(spark: SparkSession, d: str) -> DataFrame:
    """A text search with a quoted phrase, guarded, as a page."""
    return search(spark, d, SearchRequest.parse(_TEXT))


@query("search_page_terms", f"WITH {_DOCS}, {_text_sql('t0', 'market')}, {_text_sql('t1', 'old bridge')}, {_text_sql('t2', 'lantern')}, " + ", ".join(f"r{i} AS (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id) - 1 AS r FROM t{i})" for i in range(3))
       + ", u AS (SELECT image_id, round(sum(1.0::DOUBLE / (61 + r)), 9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(3)) + f") GROUP BY 1) {_page_sql('u', 'has_people = 1', limit=40, offset=10)}")
def search_page_terms(spark: SparkSession, d: str) -> DataFrame:
    """Required, free and optional terms fused by rank, people only, second page."""
    return search(spark, d, SearchRequest.parse({"query": "old bridge", "must": ["market"], "should": ["lantern"], "mode": "text", "limit": 40, "offset": 10, "has_people": True}))


@query("search_page_browse", f"WITH {_DOCS} {_page_sql(None, 'iso >= 100 AND iso <= 800 AND perception_iaa >= 5 AND hour(taken) BETWEEN 5 AND 11', 'best', 40)}")
def search_page_browse(spark: SparkSession, d: str) -> DataFrame:
    """Browsing by filters alone, the best first."""
    return search(spark, d, SearchRequest.parse({"mode": "browse", "sort": "best", "limit": 40, "time_of_day": "morning", "ranges": {"iso": (100, 800), "perception_iaa": (5, None)}}))


@query("search_page_semantic", f"WITH {_DOCS}, {_SEM}, s AS (SELECT image_id, round(1.0::DOUBLE / (r + 61), 9) AS score FROM semr WHERE r < 5000) {_page_sql('s', limit=80)}")
def search_page_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Image and description vectors in two tiers, as a page."""
    v, q = _vectors(spark, d)
    return search(spark, d, SearchRequest.parse({"query": "market", "mode": "semantic", "limit": 80}), vectors=v, wanted={"market": q})


@query("search_page_hybrid", f"""WITH {_DOCS}, {_SEM}, {_text_sql('t', 'old market')},
  tr AS (SELECT image_id, row_number() OVER (ORDER BY score DESC, image_id) - 1 AS r FROM t),
  h AS (SELECT image_id, round(0.4::DOUBLE * coalesce(1.0::DOUBLE / (tr.r + 61), 0) + 0.6::DOUBLE * coalesce(1.0::DOUBLE / (x.r + 61), 0), 9) AS score
    FROM (SELECT * FROM tr WHERE r < 200) tr FULL JOIN (SELECT * FROM semr WHERE r < 200) x USING (image_id) WHERE x.r IS NOT NULL OR tr.r < 66) {_page_sql('h', limit=50)}""")
def search_page_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and semantic lists fused at weight 0.6, as a page."""
    v, q = _vectors(spark, d)
    return search(spark, d, SearchRequest.parse({"query": "old market", "mode": "hybrid", "semantic_weight": 0.6, "limit": 50}), vectors=v, wanted={"old market": q})


_WHO = """fr AS (SELECT DISTINCT image_id FROM (SELECT image_id FROM face JOIN face_persons p ON p.id = person_id WHERE lower(p.name) = lower('{n}')
  UNION ALL SELECT image_id FROM face JOIN face_cluster_labels USING (cluster_id) WHERE lower(display_name) = lower('{n}') UNION ALL SELECT image_id FROM face WHERE lower(identity_name) = lower('{n}')))"""


@query("search_page_faces", f"WITH {_DOCS}, {_WHO.format(n='Sulwenluze Brigarorbri')}, fdocs AS (SELECT * FROM docs WHERE image_id IN (SELECT image_id FROM fr)), {_text_sql('t', 'picture of the album', docs='fdocs')} {_page_sql('t', limit=30)}")
def search_page_faces(spark: SparkSession, d: str) -> DataFrame:
    """Text searched among the images of a face only."""
    return search(spark, d, SearchRequest.parse({"query": "picture of the album", "faces": ["Sulwenluze Brigarorbri"], "mode": "text", "limit": 30}))


@query("search_page_similar", f"WITH {_DOCS}, {_VEC}, s AS (SELECT image_id, round(list_cosine_similarity(v::DOUBLE[], (SELECT v::DOUBLE[] FROM vectors WHERE image_id = 7 ORDER BY kind DESC LIMIT 1)), 9) AS score FROM vectors WHERE image_id <> 7 AND kind = (SELECT max(kind) FROM vectors WHERE image_id = 7)) {_page_sql('s', sort='newest', limit=50)}")
def search_page_similar(spark: SparkSession, d: str) -> DataFrame:
    """Images like one image, ordered by date."""
    v, _ = _vectors(spark, d)
    return search(spark, d, SearchRequest.parse({"similar_to": 7, "sort": "newest", "limit": 50}), vectors=v)
