"""BM25 full-text search over a postings table.

``bm25_build`` publishes two Parquet tables of an index folder together: postings (term, doc_id, tf, len)
sorted by term and document, so that a frequent term spans files, and one row of corpus statistics. A
search reads only the row groups of its terms; nothing else of the corpus is read or joined.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter
from tidemill.operators.change_feed import current_version, publish, read_current
from tidemill.operators.stemmer import stem
from tidemill.session import cut

K1, B = 1.2, 0.75
MAX_TOKEN_BYTES = 40
# The English stop words of the common search libraries.
STOP_WORDS = set("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def analyze(text: str) -> list[str]:
    """Words of letters and digits, without tokens over 40 bytes, lower-cased, without stop words, stemmed, in that order."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", text) if len(w.encode()) <= MAX_TOKEN_BYTES]
    return [stem(w) for w in words if w not in STOP_WORDS]


def analyze_places(text: str) -> list[str]:
    """The words as ``analyze`` has them, with an empty string in the place of each word left out."""
    words = [w.lower() if len(w.encode()) <= MAX_TOKEN_BYTES else "" for w in re.findall(r"[^\W_]+", text)]
    return ["" if w in STOP_WORDS or not w else stem(w) for w in words]


def analyzed(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else analyze(t))

    return run(text)


def plain_terms(text: Column) -> Column:
    """The analyzer-free form: lower-case runs of ASCII letters, digits and underscores, all JVM-side."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), " "), lambda w: w != "")


def sanitize(query: str) -> str:
    """Lower case, ASCII letters, digits and underscores kept, everything else (letters outside ASCII too) a blank."""
    return re.sub(r"[^a-z0-9_]+", " ", query.lower()).strip()


def analyzed_docs(df: DataFrame, id_col: str, text_col: str, stemmed: bool) -> DataFrame:
    """(doc_id, terms); documents with a null text or id are not indexed."""
    docs = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return docs.select("doc_id", (analyzed(F.col("t")) if stemmed else plain_terms(F.col("t"))).alias("terms"))


def statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))


def score(hits: DataFrame, docs: int, avg_len: float | None, terms: list[str], k: int) -> DataFrame:
    """(id, score) of the k best documents holding any of the terms; a term asked twice counts twice, ties by id.

    ``hits`` are the postings (term, doc_id, tf, len) of the terms and are read once to count documents a
    term, one row a query term.
    """
    if k <= 0:
        raise InvalidParameter("k must be positive")
    df_of = {r.term: r.n for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()} if terms else {}
    idf = {t: terms.count(t) * math.log(1 + (docs - n + 0.5) / (n + 0.5)) for t, n in df_of.items()}
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in idf.items()], F.lit(0.0))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len or 1.0))
    return hits.groupBy(F.col("doc_id").alias("id")).agg(F.sum(weight * F.col("tf") * (K1 + 1) / norm).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)


def bm25_scan(df: DataFrame, id_col: str, text_col: str, query: str, k: int, stemmed: bool = True) -> DataFrame:
    """The same ranking without an index: one pass over the texts keeps each length and the query words' counts, nothing else."""
    if k <= 0:
        raise InvalidParameter("k must be positive")
    wanted = analyze(sanitize(query)) if stemmed else sanitize(query).split()
    words = sorted(set(wanted))
    terms = analyzed_docs(df, id_col, text_col, stemmed)
    held = F.filter("terms", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
    seen = cut(terms.select("doc_id", F.size("terms").alias("len"), held.alias("held")))
    hits = seen.select("doc_id", "len", F.explode("held").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    total = statistics(seen).first()
    return score(hits, total.docs, total.avg_len, wanted, k)


def bm25_build(df: DataFrame, id_col: str, text_col: str, folder: str, stemmed: bool = True) -> int:
    """(Re)build an index under ``folder``; returns the documents indexed. Readers see the old index until the new one is complete."""
    terms = analyzed_docs(df, id_col, text_col, stemmed)
    counted = terms.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    postings = counted.select("term", "doc_id", "tf", "len").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    publish({"postings": postings, "statistics": statistics(terms.select(F.size("terms").alias("len"))).coalesce(1)}, folder)
    return read_current(df.sparkSession, folder, "statistics").first().docs


class Opened(dict):
    """Opened indexes of this driver: folder to (version, postings, documents, average length); executors get none of them."""

    def __reduce__(self):
        return Opened, ()


_open: dict[str, tuple[str, DataFrame, int, float | None]] = Opened()


def bm25_open(spark: SparkSession, folder: str) -> tuple[DataFrame, int, float | None]:
    """The current version of an index; file listing and statistics are read once a version."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no index under {folder}")
    if folder not in _open or _open[folder][0] != version or _open[folder][1].sparkSession is not spark:
        total = spark.read.parquet(f"{folder}/{version}/statistics").first()
        _open[folder] = (version, spark.read.parquet(f"{folder}/{version}/postings"), total.docs, total.avg_len)
    return _open[folder][1:]


def bm25_search(spark: SparkSession, folder: str, query: str, k: int, stemmed: bool = True) -> DataFrame:
    """(id, score); an index that was never built is an error, an empty query gives no rows."""
    terms = analyze(sanitize(query)) if stemmed else sanitize(query).split()
    postings, docs, avg_len = bm25_open(spark, folder)
    return score(postings.where(F.col("term").isin(sorted(set(terms)))), docs, avg_len, terms, k)
