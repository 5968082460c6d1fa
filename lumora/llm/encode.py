"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. Within a task each
distinct word is encoded once, by recursive DuckDB queries: its bytes are
token-position rows that join the merge table; every step contracts, from the
left, the occurrences of each word's pair of minimum rank, until no pair of any
word is in the table. A pair made by a merge has a higher rank than the merge,
so contracting all occurrences of the minimum at once equals contracting the
leftmost again and again, in fewer steps. Ordered aggregation gives the ids.

Documents never leave their partition: the operator is one narrow pass.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.tables import table

#: Where the vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("LUMORA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Steps of one recursive query; unfinished words go on in the next.
_STEPS = 24
#: Characters encoded together, and words remembered by a task.
_CHUNK_CHARS, _MEMORY = 4_000_000, 400_000


def byte_letters() -> dict[str, int]:
    """Byte of each letter that vocabulary files of this kind write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge table, byte ids and token bytes of a vocabulary file."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]  # noqa: SIM115
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


_CONTRACT = f"""
WITH RECURSIVE step(k, w, pos, tok, last) AS (
  SELECT 0, w, pos, tok, false FROM todo
  UNION ALL
  SELECT k + 1, w, pos, coalesce(made, tok), best IS NULL
  FROM (
    SELECT *, lag(hit) OVER (PARTITION BY w ORDER BY pos) AS taken
    FROM (
      -- in a run of overlapping occurrences every other one is contracted, from the left
      SELECT k, w, pos, tok, best, CASE WHEN same AND run % 2 = 1 THEN made END AS made, same AND run % 2 = 1 AS hit
      FROM (
        SELECT *, row_number() OVER (PARTITION BY w, same, n - r ORDER BY pos) AS run
        FROM (
          SELECT *, row_number() OVER (PARTITION BY w, same ORDER BY pos) AS r
          FROM (
            SELECT *, coalesce(rank = best, false) AS same
            FROM (
              SELECT s.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY s.w) AS best
              FROM (
                SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                       row_number() OVER (PARTITION BY w ORDER BY pos) AS n
                FROM step WHERE NOT last AND k < {_STEPS}
              ) s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt
            )
          )
        )
      )
    )
  )
  WHERE NOT coalesce(taken, false)
)
SELECT w, pos, tok, last FROM step WHERE last OR k = {_STEPS}
"""


class WordEncoder:
    """Encodes sets of words with recursive DuckDB queries."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.vocab = v = vocabulary(path)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute("SET temp_directory = ''")  # what does not fit is an error, not a file of the machine
        self.con.execute("SET memory_limit = '700MB'")
        merges = pa.table({"l": v.left, "r": v.right, "rank": np.arange(len(v.left), dtype=np.int32), "made": v.made})
        self.con.register("merges_arrow", merges)
        self.con.execute("CREATE TEMP TABLE merges AS SELECT * FROM merges_arrow")

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        if not words:
            return []
        raw = [w.encode("utf-8") for w in words]
        lens = np.array([len(b) for b in raw])
        todo = pa.table(
            {
                "w": np.repeat(np.arange(len(raw), dtype=np.int32), lens),
                "pos": np.arange(lens.sum(), dtype=np.int32) - np.repeat(np.cumsum(lens) - lens, lens).astype(np.int32),
                "tok": self.vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)],
            }
        )
        con = self.con
        con.execute("CREATE OR REPLACE TEMP TABLE done(w INTEGER, pos INTEGER, tok INTEGER)")
        while todo.num_rows:
            con.register("todo", todo)
            got = con.sql(_CONTRACT).to_arrow_table()
            last = got["last"].combine_chunks()
            ready = got.filter(last).select(["w", "pos", "tok"])
            con.register("ready", ready)
            con.execute("INSERT INTO done SELECT * FROM ready")
            todo = got.filter(pc.invert(last)).select(["w", "pos", "tok"])
        rows = con.sql("SELECT w, list(tok ORDER BY pos) AS ids FROM done GROUP BY w ORDER BY w").to_arrow_table()
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        ids = rows["ids"].combine_chunks()
        flat, off = ids.values.to_numpy(), ids.offsets.to_numpy()
        for i, w in enumerate(rows["w"].to_pylist()):
            out[w] = flat[off[i] : off[i + 1]]
        return out


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(``key``, ``ids`` array<int>) for every row, without special tokens.

    Null and empty texts give an empty list; strings that look like special
    tokens are plain text. Rows are kept as they are, repeated keys and null
    keys included; other columns are dropped. Texts are encoded whole.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words_of = regex.compile(PATTERN).findall
        coder: WordEncoder | None = None
        known: dict[str, int] = {}
        # ids of all known words, one after the other, with the start and length of each
        pool, start_of, length_of = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

        def flush(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            nonlocal coder, pool, start_of, length_of
            cut = [words_of(t) if t else [] for t in texts]
            new = {w for words in cut for w in words if w not in known}
            if new:
                coder = coder or WordEncoder(path)
                todo = list(new)
                coded = coder.encode(todo)
                known.update(zip(todo, range(len(known), len(known) + len(todo))))
                size = np.array([len(c) for c in coded], np.int64)
                start_of = np.concatenate([start_of, len(pool) + np.cumsum(size) - size])
                length_of = np.concatenate([length_of, size])
                pool = np.concatenate([pool, *coded]).astype(np.int32)
            words_in = np.array([len(words) for words in cut], np.int64)
            at = np.fromiter((known[w] for words in cut for w in words), np.int64, int(words_in.sum()))
            size = length_of[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = pool[np.repeat(start_of[at] - ends[:-1], size) + np.arange(ends[-1])]
            offsets = ends[np.concatenate([[0], np.cumsum(words_in)])].astype(np.int32)
            if len(known) > _MEMORY:
                known.clear()
                pool, start_of, length_of = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

        for b in batches:
            texts = b["_text"].to_pylist()
            start, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars > _CHUNK_CHARS or i == len(texts) - 1:
                    yield flush(b["_key"].slice(start, i + 1 - start), texts[start : i + 1])
                    start, chars = i + 1, 0

    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['_key']}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(``key``, ``text``): the inverse of :func:`encode_corpus`; a null list gives null."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    @F.pandas_udf("string")
    def join(col):  # noqa: ANN001, ANN202
        of = vocabulary(path).bytes_of
        return col.map(lambda x: None if x is None else b"".join(of[int(i)] for i in x).decode("utf-8", "replace"))

    return df.select(F.col(key), join(F.col(ids)).alias("text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
