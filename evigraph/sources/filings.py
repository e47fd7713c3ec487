"""Filing metadata and texts as DataFrames; fetching is a plug-in, so that it works offline."""

from __future__ import annotations

import time
import urllib.request
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.text import filing_date, section_parts, signature, squeeze

ITEMS = ("1", "1A")
LEAST_CAP = 4000


def fetch(url: str, agent: str, timeout: float = 30.0, pause: float = 0.2) -> bytes:
    """One polite request; raises on any status but success (A1)."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
        body = answer.read()
    time.sleep(pause)
    return body


def read_through(spark: SparkSession, path: str, url: str, get: Callable[[str], bytes]) -> str:
    """The text kept at ``path``, fetched from ``url`` and put there if it isn't yet (A4).

    The file appears whole, by a rename, so a reader never sees a part of it.
    """
    jvm = spark._jvm
    at, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(part)
        out.write(bytearray(get(url)))
        out.close()
        if not fs.rename(part, at):  # another was faster
            fs.delete(part, False)
    return spark.read.text(path, wholetext=True).first()["value"]


def ticker_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) of a JSON object of rows (A2)."""
    row = "map<string, struct<cik_str: long, ticker: string, title: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", row))).alias("r"))
    return raw.select("r.ticker", F.col("r.cik_str").alias("cik"), "r.title")


def ticker_to_id(table: DataFrame, ticker: str) -> int:
    """The id of a ticker, case aside; LookupError if there is none (A2)."""
    row = table.where(F.upper("ticker") == ticker.upper()).orderBy("cik").first()
    if row is None:
        raise LookupError(f"unknown ticker {ticker!r}")
    return row["cik"]


def latest_of_form(filings: DataFrame, key: str, form: str, forms: str = "form", accessions: str = "accessionNumber", documents: str = "primaryDocument") -> DataFrame:
    """(key, accession, document) of each key's first filing of a form, from parallel arrays (A3)."""
    each = filings.select(key, F.posexplode(F.arrays_zip(F.col(forms).alias("form"), F.col(accessions).alias("accession"), F.col(documents).alias("document"))).alias("pos", "f"))
    best = each.where(F.col("f.form") == form).groupBy(key).agg(F.min_by("f", "pos").alias("f"))
    return best.select(key, F.regexp_replace("f.accession", "-", "").alias("accession"), F.col("f.document").alias("document"))


def filing_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files (A4)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def longest_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, item, body): the longest section of each item, the first of equals."""
    parts = docs.select(F.col(id_col), F.explode(section_parts(text_col)).alias("p")).select(id_col, "p.item", "p.pos", F.trim("p.body").alias("body"))
    return parts.groupBy(id_col, "item").agg(F.max_by("body", F.struct(F.length("body"), -F.col("pos"))).alias("body"))


def narrative(sections: DataFrame, most_chars: int, items: Sequence[str] = ITEMS, id_col: str = "doc_id") -> DataFrame:
    """(doc, text): the wanted items in order, each cut at its share of the limit."""
    cap = max(LEAST_CAP, most_chars // len(items))
    order = F.array_position(F.array(*[F.lit(i) for i in items]), F.col("item"))
    picked = sections.withColumn("ord", order).where("ord > 0").select(id_col, F.struct("ord", F.substring("body", 1, cap).alias("body")).alias("s"))
    return picked.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["body"]), "\n\n").alias("text"))


def filing_text(docs: DataFrame, most_chars: int, items: Sequence[str] = ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text): the narrative, or the raw beginning where no section was found (A4)."""
    told = narrative(longest_sections(docs, id_col, text_col), most_chars, items, id_col).withColumnRenamed("text", "told")
    return docs.join(told, id_col, "left").select(id_col, F.coalesce("told", F.substring(text_col, 1, most_chars)).alias("text"))


def section_of_chunks(chunks: DataFrame, sections: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(chunk_id, item): the first item whose text holds the chunk's signature, else 'other' (B11, D13)."""
    c = chunks.select("chunk_id", doc_col, signature("text").alias("sign"))
    s = sections.select(doc_col, "item", squeeze("body").alias("body"))
    hit = c.join(s, doc_col).where(F.col("body").contains(F.col("sign"))).groupBy("chunk_id").agg(F.min("item").alias("item"))
    return chunks.select("chunk_id").join(hit, "chunk_id", "left").select("chunk_id", F.coalesce("item", F.lit("other")).alias("item"))


def with_filing_date(docs: DataFrame, name_col: str) -> DataFrame:
    return docs.withColumn("filing_date", filing_date(name_col))
