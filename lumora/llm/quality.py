"""Per-document text quality statistics, and a mixture that tells prose from the rest.

Statistics are one Arrow-batched pass over whole texts. A Gaussian mixture is
fitted to the standardised statistics by expectation-maximisation over all
documents: every iteration is one pass in which each partition sends back only
the sums of its components. Components get their meaning from inspected
examples: each is named after the kind of the examples it explains best.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.session import cut
from lumora.tables import table

#: Frequent function words of English, German, French and Spanish.
COMMON = frozenset(
    """a about after all almost an and are as at be because but by can could did do down each for from had has have
    he her his how i if in is it its just like more my no nor not of on one only or our out she so some than that the
    their them then there they this to too two until up was we were what when which while who why will with would yet you
    aber alle als am an auch auf aus bei bis das dass dem den der des die doch ein eine einen einer er es für hat hatte
    ich im ist kann man mehr mit nach nicht noch nur ob oder sich sie sind so und uns unter vom von vor war wir wie zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus
    pour qu que qui sa se ses si son sont sous sur toujours un une vous y
    al como con cuando de del donde el ella en era es esta este esto fue ha hay la las lo los más me muy no nos para pero
    por porque que se sin sobre su sus todo un una y ya""".split()
)
#: The statistics that the mixture sees, in order.
STATS = (
    "common_share",
    "prose_share",
    "symbol_ratio",
    "digit_ratio",
    "log_word_length",
    "distinct_share",
    "vowel_ratio",
    "words_per_line",
    "end_punct_share",
)
_COLUMNS = ("n_words", "n_lines", "mean_word_length", *STATS)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_KANA = re.compile(r"[぀-ゟ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SPLIT = re.compile(r"(?<=[.!?。！？…])\s*|[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
_END = (".", "!", "?", "。", "！", "？", "…", ".\"", "”", "\"", "»", ":", ";", ")")
_VOWEL = re.compile("[aeiouyàáâäãåèéêëìíîïòóôöõùúûüœæ]+")
_DIGIT = re.compile(r"\d+")
_NO_LETTER = re.compile(r"[\d'’]+")
_SYMBOL = re.compile(r"(?:_|[^\w\s.,!?'\"’“”„«»:;\-–—()…¿¡。、！？「」・ー])+")
_SCRIPT = re.compile(r"[぀-ヿ㐀-鿿]")


def _covered(pattern: re.Pattern[str], text: str) -> int:
    """Characters of ``text`` in matches of ``pattern``."""
    return len("".join(pattern.findall(text)))


def _segment(s: str) -> tuple[int, int, list[str], int, int, bool, int, float]:
    """Words, spaceless script, lowered words and whether a stripped segment reads like prose."""
    words = _WORD.findall(s.lower().replace("’", "'"))
    kana = cjk = 0
    latin = words
    if not s.isascii() and (cjk := len(_CJK.findall(s))):
        kana = len(_KANA.findall(s))
        latin = [w for w in words if not _SCRIPT.search(w)]
    hit = sum(map(COMMON.__contains__, latin)) + 0.9 * kana / 2
    if "'" in s or "’" in s:
        hit += sum(w.split("'")[-1] in COMMON or w.split("'")[0] in COMMON for w in latin if "'" in w)
    n = len(latin) + cjk / 2
    bad = _covered(_SYMBOL, s)
    return len(words), kana, latin, cjk, len(s), n >= 2 and hit >= 0.12 * n and bad <= 0.08 * len(s), bad, hit


def text_stats(text: str | None) -> tuple | None:
    """Statistics of one text; None for null, empty and blank ones.

    Words are runs of letters or of digits. In scripts without spaces each
    character counts as half a word and hiragana as the common words. A
    segment is read once however often it is repeated.
    """
    if text is None:
        return None
    tokens = text.split()
    if not tokens:
        return None
    lines = [x for x in text.splitlines() if not x.isspace() and x]
    chars = sum(map(len, tokens))
    low: list[str] = []
    n_words = all_words = cjk = symbols = prose = whole = 0
    common = 0.0
    seen: dict[str, tuple] = {}
    for seg in _SPLIT.split(text):
        s = seg.strip()
        if not s:
            continue
        known = seen.get(s)
        if known is None:
            known = seen[s] = _segment(s)
            # a segment said again and again counts once as prose, and always in the whole
            prose += known[4] * known[5]
        all_words += known[0]
        low += known[2]
        cjk += known[3]
        whole += known[4]
        symbols += known[6]
        common += known[7]
    n_words = len(low) + cjk / 2
    symbols += text.count("\ufffd")
    run = _NO_LETTER.sub("", "".join(low))
    if cjk > len(low):
        chain = "".join(_CJK.findall(text))
        grams = {chain[i : i + 6] for i in range(max(len(chain) - 5, 1))}
        n_grams = max(len(chain) - 5, 1)
    elif len(low) > 2:
        grams, n_grams = set(zip(low, low[1:], low[2:])), len(low) - 2
    else:
        grams, n_grams = set(low), len(low)
    mean_len = (chars - cjk) / len(tokens) if cjk <= len(low) else 5.0
    return (
        all_words,
        len(lines),
        float(mean_len),
        min(common / max(n_words, 1), 1.0),
        prose / max(whole, 1),
        symbols / max(chars, 1),
        _covered(_DIGIT, text) / max(chars, 1),
        math.log(max(mean_len, 1.0)),
        (len(grams) + 1) / (n_grams + 1),
        _covered(_VOWEL, run) / len(run) if run and cjk <= len(run) else 0.4,
        math.log1p(n_words / max(len(lines), 1)),
        sum(x.strip().endswith(_END) for x in lines) / max(len(lines), 1),
    )


def document_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of each document; null, empty and blank texts give none."""

    schema = f"key {dict(df.select(key).dtypes)[key]}, " + ", ".join(
        f"{c} {'long' if c.startswith('n_') else 'double'}" for c in _COLUMNS
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_stats(t) for t in b["_text"].to_pylist()]
            there = [i for i, s in enumerate(got) if s is not None]
            cols = zip(*[got[i] for i in there]) if there else [()] * len(_COLUMNS)
            arrays = [pa.array(c, pa.int64() if n.startswith("n_") else pa.float64()) for n, c in zip(_COLUMNS, cols)]
            yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(there, pa.int64())), *arrays], names=["key", *_COLUMNS])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


#: Inspected examples by kind, written for this purpose; only to name components.
EXAMPLES: dict[str, tuple[str, ...]] = {
    "prose": (
        "We walked along the river until the light was gone, and nobody said a word about the photo.",
        "The album shows the next picture instead. If it is too dark, you can open it again and change the colour.",
        "What a quiet evening!",
        "she asked for one more picture\nand we stood on the bridge\nwhile the train was passing by",
        "THE CAMERA WAS LEFT ON THE TABLE, AND WE HAD TO GO BACK FOR IT IN THE RAIN.",
        "Nach dem Regen war die Luft klar, und wir gingen noch einmal zum Hafen, um das Licht zu sehen.",
        "Après la pluie, nous sommes restés sur le pont et la lumière était belle dans la rue.",
        "La mañana era fría, pero la luz sobre el puerto nos gustó mucho y nos quedamos hasta el final.",
        "雨のあと、私たちは港の近くで光を待っていました。写真は少し暗いですが、色がとても好きです。",
        "Notes\n\nWe found three more photos of the same scene. They were made on the last day of the trip.",
        "A " + "short walk in the old town ended at the market, where the guide told us about the bell tower. " * 2
        + "It was late, so we took the bus home and looked at the pictures.",
    ),
    "list": (
        "- red hat\n- old boat\n- stone bridge\n- glass door\n- soft light",
        "* green kite\n* paper lantern\n* wooden bench\n* harbour photo 12",
        "• warm horizon\n• faded sky\n• small basket\n• iron gate",
        "blue ladder\nold fence\npainted sign\nquiet mood\nharsh grain",
        "[ ] broken boat\n[ ] stone sign\n[ ] blue basket\n[ ] dull contrast",
        "red hat / old boat / stone bridge / glass door / soft light / small dog",
        "1. red hat\n2. old boat\n3. stone bridge\n4. glass door",
        "red hat, old boat, stone bridge, glass door, soft light, small dog, iron gate",
    ),
    "table": (
        "| iso | width | lens |\n| --- | --- | --- |\n| 200 | 4032 | n/a |\n| 400 | 3024 | 50.0 |",
        "iso,width,height,lens\n200,4032,3024.0,Alpha\n400,1920.5,n/a,Beta\n100,,812.25,Gamma",
        "camera_make    sharpness      iso\nn/a            Alpha          1664.7\n2858.12        Beta           1534.74",
        "iso = 200\nlens = n/a\nwidth\t4032.0\nf_number = 2.8\nexposure\t1/125",
        "2020-01-02 03:04:05 INFO worker-1 caption image=1234 ms=56\n2020-01-02 03:04:09 WARN worker-2 faces image=99 ms=1207",
        '{"iso": 200, "lens": null, "width": 4032}\n{"iso": 400, "lens": "Alpha", "width": 3024}',
    ),
    "junk": (
        "(;{ =~|/\\ ^^_e \"<I }{ ;:>l =+o ]~` {-_ |a\\ ,!I =;> )[(n ~^ .;'",
        "Ã© Ð¤Ðalpha Â°ro Ã©Ã¼ â€œbeta ï¿½mi â€™el Ã¼ny Â° ¿½x Ð¤Ðra â€œka",
        "xgT7Qm2Zb9LwKp4RfVn8Jc3HsYd6XtAeUi5OoWqPzMyNlBkGhFjDcSvRtEwQaZx1x2C3v4B5n6M7",
        "xvbk qwrtz mnbvc plkjhg zxcvbn trwq sdfgh lkjhg wrtpl bvcxz mnbv qwrt",
        "Home | Albums | Tour | Log out\n" * 8,
        "folder dull\n" * 12,
        "ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha",
        "Please open the album again. " * 20,
    ),
}


class Mixture:
    """A Gaussian mixture with full covariances over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.mu, self.cov = mean, scale, weights, mu, cov
        self.chol = np.linalg.cholesky(np.linalg.inv(cov))
        self.const = np.log(np.maximum(weights, 1e-300)) + np.log(np.diagonal(self.chol, axis1=1, axis2=2)).sum(1) - mu.shape[1] / 2 * math.log(2 * math.pi)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, rows by components, of raw statistics."""
        z = (x - self.mean) / self.scale
        return np.stack([c - 0.5 * (((z - m) @ ch) ** 2).sum(1) for c, m, ch in zip(self.const, self.mu, self.chol)], axis=1)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        lj = self.log_joint(x)
        p = np.exp(lj - lj.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_mixture(stats: DataFrame, components: int = 14, iterations: int = 12, floor: float = 0.02, start_rows: int = 4000, still: float = 0.02) -> Mixture | None:
    """EM over all rows of ``stats``; None if it has none.

    Means start from a k-means++ choice among at most ``start_rows`` rows taken
    by hash; each of at most ``iterations`` runs over all documents, and they
    end when the mean log-likelihood rises by less than ``still``. ``floor`` is
    added to the variances, in standardised units, so that a statistic that is
    constant in a component keeps a width.
    """
    d = len(STATS)
    cols = [F.col(c) for c in STATS]
    row = stats.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not row[0]:
        return None
    mean, scale = np.array(row[1 : d + 1], float), np.maximum(np.array(row[d + 1 :], float), 1e-3)
    start = stats.select(*STATS).orderBy(F.xxhash64(*STATS)).limit(start_rows).toPandas().to_numpy(float)
    z = (start - mean) / scale
    rng = np.random.default_rng(7)
    centres = [z[0]]
    for _ in range(min(components, len(z)) - 1):
        d2 = np.min([((z - c) ** 2).sum(1) for c in centres], axis=0)
        if d2.sum() <= 0:
            break
        centres.append(z[rng.choice(len(z), p=d2 / d2.sum())])
    mu = np.array(centres)
    for _ in range(15):
        near = np.argmin(((z[:, None, :] - mu[None]) ** 2).sum(-1), axis=1)
        mu = np.array([z[near == k].mean(0) if (near == k).any() else mu[k] for k in range(len(mu))])
    k = len(mu)
    model = Mixture(mean, scale, np.full(k, 1.0 / k), mu, np.tile(np.eye(d) * 0.5, (k, 1, 1)))
    size = k * (1 + d + d * d) + 1
    before = -math.inf
    for _ in range(iterations):

        def sums(batches: Iterator[pd.DataFrame], m: Mixture = model) -> Iterator[pd.DataFrame]:
            acc = np.zeros(size)
            for b in batches:
                x = b.to_numpy(float)
                if not len(x):
                    continue
                lj = m.log_joint(x)
                top = lj.max(1, keepdims=True)
                p = np.exp(lj - top)
                tot = p.sum(1, keepdims=True)
                p /= tot
                zz = (x - m.mean) / m.scale
                acc[0] += (np.log(tot) + top).sum()
                acc[1 : 1 + k] += p.sum(0)
                acc[1 + k : 1 + k + k * d] += (p.T @ zz).ravel()
                acc[1 + k + k * d :] += np.einsum("nk,ni,nj->kij", p, zz, zz, optimize=True).ravel()
            yield pd.DataFrame({"v": [acc.tolist()]})

        # one vector of fixed length a partition, added up in the cluster element by element
        parts = stats.select(*STATS).mapInPandas(sums, "v array<double>")
        got = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        acc = np.zeros(size)
        acc[got["i"].to_numpy()] = got["x"].to_numpy()
        n = np.maximum(acc[1 : 1 + k], 1e-6)
        mu = acc[1 + k : 1 + k + k * d].reshape(k, d) / n[:, None]
        cov = acc[1 + k + k * d :].reshape(k, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", mu, mu)
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + np.eye(d) * floor
        ev, vec = np.linalg.eigh(cov)
        cov = np.einsum("kij,kj,klj->kil", vec, np.maximum(ev, floor / 2), vec)
        model = Mixture(mean, scale, n / n.sum(), mu, cov)
        if acc[0] / row[0] - before < still:
            break
        before = acc[0] / row[0]
    return model


def name_components(model: Mixture) -> list[str]:
    """The kind of each component: that of the example it is nearest to.

    An example speaks for a component in proportion to its posterior; one that
    no example favours takes the kind of the example nearest to its mean.
    """
    kinds = [(kind, np.array(text_stats(t)[3:], float)) for kind, texts in EXAMPLES.items() for t in texts]
    x = np.array([v for _, v in kinds])
    post = model.posterior(x)
    z = (x - model.mean) / model.scale
    out = []
    for c in range(len(model.weights)):
        votes: dict[str, float] = {}
        for (kind, _), p in zip(kinds, post[:, c]):
            votes[kind] = votes.get(kind, 0.0) + p
        best = max(votes, key=lambda q: votes[q])
        if votes[best] < 0.3:
            diff = z - model.mu[c]
            inv = np.linalg.inv(model.cov[c] + np.eye(len(STATS)) * 0.3)
            best = kinds[int(np.argmin(np.einsum("ni,ij,nj->n", diff, inv, diff)))][0]
        out.append(best)
    return out


def classify(df: DataFrame, key: str, text: str, components: int = 14, iterations: int = 12) -> DataFrame:
    """``key``, the statistics, ``kind`` and ``p_prose`` of each document with words.

    Null, empty and blank texts give no row; repeated keys give one row each.
    """
    stats = cut(document_stats(df, key, text))
    model = fit_mixture(stats, components, iterations)
    if model is None:
        return stats.withColumn("kind", F.lit(None).cast("string")).withColumn("p_prose", F.lit(None).cast("double"))
    names = name_components(model)
    kinds = sorted(EXAMPLES)
    of = np.array([[n == k for k in kinds] for n in names], float)

    @F.pandas_udf("kind string, p_prose double")
    def decide(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in cols:
            p = model.posterior(np.stack([c.to_numpy(float) for c in batch], axis=1)) @ of
            yield pd.DataFrame({"kind": [kinds[i] for i in p.argmax(1)], "p_prose": p[:, kinds.index("prose")]})

    got = stats.withColumn("_d", decide(*[F.col(c) for c in STATS]))
    return got.withColumn("kind", F.col("_d.kind")).withColumn("p_prose", F.col("_d.p_prose")).drop("_d")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return classify(table(spark, sf_dir, "documents"), "doc_id", "text").filter("p_prose < 0.5").select("doc_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the kind of each document."""
    return classify(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
ORACLES: dict[str, str] = {}
