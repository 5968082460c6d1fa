"""Folder scans, face databases, sidecars and story pages."""

from __future__ import annotations

import html
import json
import os
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.library import SUFFIXES


def scan_folder(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Image files below a folder (S1): path, length, modification time, fingerprint (S3), each path once.

    Suffixes count in any case. ``content`` adds a SHA-256 of the bytes; without
    it the bytes are not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    f = f.filter(suffix.isin(*SUFFIXES))
    cols: list[Column] = [F.col("path"), F.col("length"), F.col("modificationTime")]
    cols.append(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("fingerprint"))
    if content:
        cols.append(F.sha2("content", 256).alias("digest"))
    return f.select(*cols).dropDuplicates(["path"])


def load_face_db(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) of a JSON face database (S8): ``{name: {"embeddings": [[...]]}}``."""
    text = spark.read.text(path, wholetext=True)
    people = F.from_json("value", "map<string,struct<embeddings:array<array<float>>>>")
    return text.select(F.explode(people).alias("name", "v")).select("name", F.explode("v.embeddings").alias("embedding"))


def save_face_db(rows: list[tuple[str, list[float]]], path: str) -> None:
    """Write a JSON face database, replacing the file in one step."""
    people: dict[str, dict] = {}
    for name, e in rows:
        people.setdefault(name, {"embeddings": []})["embeddings"].append(list(e))
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(people, f)
    os.replace(tmp, path)


def dms(value: float, positive: str, negative: str) -> str:
    """Degrees and decimal minutes of a coordinate, as sidecars write them."""
    v = abs(value)
    d = int(v)
    return f"{d},{(v - d) * 60:.6f}{positive if value >= 0 else negative}"


def xmp_sidecar(row: dict) -> str:
    """An RDF/XML sidecar (S14) of an image: description, keywords, rating and position."""
    bag = "".join(f"<rdf:li>{escape(str(k))}</rdf:li>" for k in row.get("keywords") or [])
    out = ['<?xpacket begin="" id="lumora"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">']
    out.append('<rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:xmp="http://ns.adobe.com/xap/1.0/">')
    if row.get("description"):
        out.append(f'<dc:description><rdf:Alt><rdf:li xml:lang="x-default">{escape(row["description"])}</rdf:li></rdf:Alt></dc:description>')
    if bag:
        out.append(f"<dc:subject><rdf:Bag>{bag}</rdf:Bag></dc:subject>")
    if row.get("rating") is not None:
        out.append(f"<xmp:Rating>{int(row['rating'])}</xmp:Rating>")
    if row.get("lat") is not None and row.get("lng") is not None:
        out.append(f"<exif:GPSLatitude>{dms(row['lat'], 'N', 'S')}</exif:GPSLatitude><exif:GPSLongitude>{dms(row['lng'], 'E', 'W')}</exif:GPSLongitude>")
    out.append("</rdf:Description></rdf:RDF></x:xmpmeta>")
    return "".join(out)


def story_page(title: str, chapters: list[dict], heroes: int = 6) -> str:
    """A stand-alone page of a story (S15), everything escaped, at most ``heroes`` images a chapter."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for c in chapters:
        parts.append(f"<section><h2>{html.escape(str(c['title']))}</h2><ul>")
        parts += [f"<li>{html.escape(str(h))}</li>" for h in list(c.get("heroes") or [])[:heroes]]
        parts.append("</ul></section>")
    return "".join(parts)


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Sink (S13): json, csv or parquet, the folder replaced."""
    w = df.write.mode("overwrite")
    {"json": w.json, "csv": lambda p: w.option("header", "true").csv(p), "parquet": w.parquet}[kind](path)
