"""Weighted reciprocal-rank fusion of a vector leg and a text leg."""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter, raw_filter, structured_filter
from tidemill.functions.vectors import cosine_distance, lit_vector
from tidemill.operators.lexical import analyze, analyze_places, plain_terms, sanitize


def rank_leg(scored: DataFrame, order: Column, limit: int, name: str) -> DataFrame:
    """RANK of the best ``limit`` rows; the rows are cut by a distributed top-k before the window sees them."""
    best = scored.orderBy(order, F.asc("id")).limit(limit)
    return best.select("id", F.rank().over(Window.orderBy(order)).alias(name))


def text_match(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """Documents holding every query word, scored by the number of their occurrences."""
    words = sorted(set(sanitize(query).split()))
    terms = plain_terms(F.col(text_col))
    scored = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), terms.alias("terms"))
    if not words:
        return scored.select("id", F.lit(0).alias("s")).limit(0)
    wanted = F.array(*map(F.lit, words))
    return scored.where(F.size(F.array_except(wanted, F.col("terms"))) == 0).select("id", F.size(F.filter("terms", lambda t: F.array_contains(wanted, t))).alias("s"))


def covers(places: list[list[int]]) -> list[tuple[int, int, int]]:
    """The shortest stretches that hold a place of every list, as (first, last, places of any list inside)."""
    if not places or not all(places):
        return []
    every = sorted((p, i) for i, own in enumerate(places) for p in own)
    out, inside, a = [], [0] * len(places), 0
    missing = len(places)
    for b, (_, i) in enumerate(every):
        missing -= inside[i] == 0
        inside[i] += 1
        if missing:
            continue
        while inside[every[a][1]] > 1:
            inside[every[a][1]] -= 1
            a += 1
        out.append((every[a][0], every[b][0], b - a + 1))
        inside[every[a][1]] -= 1  # the next cover starts behind this one's first place
        missing += 1
        a += 1
    return out


def cover_density(terms: list[str] | None, query: list[str]) -> float:
    """Rank of a text by how close together the query's words stand: a tenth for each cover, divided by one more than the other words in it; 0 unless all occur."""
    places: dict[str, list[int]] = {w: [] for w in query}
    for n, t in enumerate(terms or []):
        if t in places:
            places[t].append(n)
    return float(sum(0.1 / (1 + (last - first) - (held - 1)) for first, last, held in covers(list(places.values()))))


def cover_density_udf():
    """(text, query) to the cover density of their analyzed words."""
    @F.pandas_udf("double")
    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        asked = {q: sorted(set(analyze(sanitize(q or "")))) for q in set(query)}
        return pd.Series([None if t is None else cover_density(analyze_places(t), asked[q]) for t, q in zip(text, query)], dtype="float64")

    return run


def text_cover(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """Documents holding every analyzed query word, scored by cover density."""
    scored = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), cover_density_udf()(F.col(text_col), F.lit(query)).alias("s"))
    return scored.where("s > 0")


def weight(value: float, name: str) -> float:
    if not math.isfinite(value) or value < 0:
        raise InvalidParameter(f"{name} must be finite and not negative")
    return value + 0.0


ENGINES = {"cover_density": text_cover, "count": text_match}


def hybrid_search_rrf(
    df: DataFrame, id_col: str, text_col: str, vec_col: str, query_text: str | None, query_vector: list[float] | None, k: int = 60, per_leg_limit: int = 20, result_limit: int = 5,
    vector_weight: float = 1.0, text_weight: float = 1.0, filter: list[dict] | None = None, filter_sql: str | None = None, text_leg: DataFrame | None = None, embed=None, engine: str = "cover_density",
) -> DataFrame:
    """(id, score): w_v/(k+rank_v) + w_t/(k+rank_t) in single precision, ordered by score, then by the id as text.

    The vector leg ranks by cosine distance without null vectors; the text leg needs every query word and
    ranks by the ``engine`` cover_density (English analyzer) or count (plain words), or is ``text_leg``
    (id, s), as a BM25 search gives it. A missing leg adds nothing. With a text only, ``embed`` makes the vector.
    """
    if engine not in ENGINES:
        raise InvalidParameter(f"unknown engine {engine!r}")
    if min(k, per_leg_limit, result_limit) <= 0:
        raise InvalidParameter("k and the limits must be positive")
    wv, wt = weight(vector_weight, "vector_weight"), weight(text_weight, "text_weight")
    if query_text is None and query_vector is None:
        raise InvalidParameter("a query text or a query vector is required")
    if filter is not None and filter_sql is not None:
        raise InvalidParameter("only one kind of filter")
    rows = df if filter is None else df.where(structured_filter(filter))
    rows = rows if filter_sql is None else rows.where(raw_filter(filter_sql))
    if query_vector is None and embed is not None:
        query_vector = embed(query_text)
    legs = []
    if query_vector is not None:
        near = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), cosine_distance(vec_col, lit_vector(query_vector)).alias("s"))
        legs.append((rank_leg(near, F.asc("s"), per_leg_limit, "rv"), "rv", wv))
    if query_text is not None:
        words = text_leg if text_leg is not None else ENGINES[engine](rows, id_col, text_col, query_text)
        legs.append((rank_leg(words, F.desc("s"), per_leg_limit, "rt"), "rt", wt))
    out = legs[0][0]
    for leg, _, _ in legs[1:]:
        out = out.join(leg, "id", "full")
    total = sum((F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(r)), F.lit(0.0)) for _, r, w in legs), F.lit(0.0))
    return out.select("id", total.cast("float").alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(result_limit)


def hybrid_search(df: DataFrame, config: dict[str, Any], embed=None) -> DataFrame:
    """The same from a configuration object with id_col, text_col, vec_col, query_text, query_vector, weights, limits and filter."""
    known = {"id_col", "text_col", "vec_col", "query_text", "query_vector", "k", "per_leg_limit", "result_limit", "vector_weight", "text_weight", "filter", "filter_sql", "engine"}
    if unknown := set(config) - known:
        raise InvalidParameter(f"unknown keys: {sorted(unknown)}")
    return hybrid_search_rrf(df, **({"query_text": None, "query_vector": None} | config), embed=embed)
