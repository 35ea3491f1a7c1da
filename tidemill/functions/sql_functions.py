"""The scalar functions as SQL functions of a session, and the functions that give tables by name.

Distances and checks are SQL expressions that the optimizer inlines; functions that need Python work on Arrow
batches. Functions that give tables start jobs of their own, so SQL cannot call them from a row; ``TABLES``
holds them by name, and ``table_function`` makes the result of one a view of the session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import vectors
from tidemill.operators import ai, extract, graph, hybrid, knn, lexical, nl
from tidemill.operators.chunk import chunk
from tidemill.sources import lakehouse

VECTOR = "array<float>"
FOLD = "aggregate(zip_with({}, {}, (x, y) -> {}), CAST(0 AS FLOAT), (s, x) -> CAST(s + x AS FLOAT))"
DOT, AA, BB = FOLD.format("a", "b", "x * y"), FOLD.format("a", "a", "x * y"), FOLD.format("b", "b", "x * y")
COSINE = f"CAST({DOT} AS DOUBLE) / (sqrt(CAST({AA} AS DOUBLE)) * sqrt(CAST({BB} AS DOUBLE)))"
SAME = "CASE WHEN size(a) <> size(b) THEN raise_error('different vector dimensions') ELSE {} END"
NEG = f"-CAST({DOT} AS DOUBLE)"
DISTANCE = f"CASE WHEN {AA} = 0 OR {BB} = 0 THEN double('NaN') ELSE 1 - greatest(-1D, least(1D, {COSINE})) END"
FINITE = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('Infinity'))"
TWO = f"a {VECTOR}, b {VECTOR}"
#: Name to (parameters, result type, body); the bodies are inlined by the optimizer.
SCALARS = {
    "inner_product": (TWO, "double", SAME.format(f"CAST({DOT} AS DOUBLE)")),
    "negative_inner_product": (TWO, "double", SAME.format(NEG)),
    "l2_distance": (TWO, "double", SAME.format(f"sqrt(CAST({FOLD.format('a', 'b', '(x - y) * (x - y)')} AS DOUBLE))")),
    "cosine_distance": (TWO, "double", SAME.format(DISTANCE)),
    "vector_eq": (TWO, "boolean", "a = b"),
    "vector_ne": (TWO, "boolean", "a <> b"),
    "vector_lt": (TWO, "boolean", "a < b"),
    "vector_le": (TWO, "boolean", "a <= b"),
    "vector_gt": (TWO, "boolean", "a > b"),
    "vector_ge": (TWO, "boolean", "a >= b"),
    "vector_cmp": (TWO, "int", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "vector_in": ("t string", VECTOR, f"(SELECT CASE WHEN size(v) BETWEEN 1 AND {vectors.MAX_DIMS} AND {FINITE} THEN v END FROM (SELECT from_json(trim(t), '{VECTOR}') AS v))"),
    "vector_out": (f"v {VECTOR}", "string", "concat('[', array_join(transform(v, x -> CAST(x AS STRING)), ','), ']')"),
    "vector_coerce": (f"v {VECTOR}, dims int", VECTOR, "CASE WHEN size(v) <> dims THEN raise_error('different vector dimensions') ELSE v END"),
    "vector_from_double": ("d array<double>", VECTOR, f"CAST(d AS {VECTOR})"),
    "vector_dims": (f"v {VECTOR}", "int", "size(v)"),
    "label_overlap": ("a array<smallint>, b array<smallint>", "boolean", "coalesce(arrays_overlap(array_compact(a), array_compact(b)), false)"),
    "sbq_bytes_per_vector": ("dims int, bits int", "int", "CAST(ceil(dims * bits / 64) * 8 AS INT)"),
    "sanitize_query": ("q string", "string", "trim(regexp_replace(lower(q), '[^a-z0-9_]+', ' '))"),
    "vectorizer_backoff": ("attempts int", "double", "least(pow(2D, least(attempts, 12)), 300D)"),
}
#: Name to what makes the table.
TABLES = {
    "read_parquet": lakehouse.read_parquet, "min_max_count": lakehouse.min_max_count, "olap": lakehouse.olap, "row_groups": lakehouse.row_groups,
    "knn": knn.knn, "knn_batch": knn.knn_batch, "knn_labels": knn.knn_labels, "hnsw_knn": knn.hnsw_knn, "ivfflat_knn": knn.ivfflat_knn, "sbq_knn": knn.sbq_knn, "pq_knn": knn.pq_knn, "sq8_knn": knn.sq8_knn, "rabitq_knn": knn.rabitq_knn,
    "vindex_assign": knn.vindex_assign, "vindex_decode_bytes": knn.decoded_bytes, "scan_stats": knn.scan_stats, "explain_scan": knn.explain_scan, "similarity_join": knn.similarity_join, "threshold_join": knn.threshold_join,
    "bm25_search": lexical.bm25_search, "hybrid_search_rrf": hybrid.hybrid_search_rrf, "hybrid_search": hybrid.hybrid_search, "nl_query": nl.nl_query, "agg_summarize": ai.agg_summarize,
    "graph_expand": graph.expand, "graph_expand_multi": graph.expand_multi, "graph_ppr": graph.ppr, "pgq_match": graph.pgq_match, "graph_rag_search": graph.graph_rag_search,
    "extract_entities_of": extract.extract_entities, "extract_graph_of": extract.extract_graph, "graph_embed_nodes": extract.embed_nodes,
}


def table_function(name: str, view: str, *args, **options) -> DataFrame:
    """The result of a function of ``TABLES``, which SQL can read as ``view`` from then on."""
    df = TABLES[name](*args, **options)
    df.createOrReplaceTempView(view)
    return df


def register(spark: SparkSession, model: ai.Model = ai.parity, embed=None) -> list[str]:
    """Create the scalar functions in the session and return their names; ``model`` and ``embed`` serve those that ask one."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    embed = embed or ai.hashed_embedding()

    @F.pandas_udf("array<string>")
    def chunk_text(text: pd.Series, strategy: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([chunk(*row) for row in zip(text, strategy, size, overlap)])

    @F.pandas_udf(extract.ENTITY)
    def extract_entities(text: pd.Series) -> pd.Series:
        names = ("name", "normalized_name", "entity_type", "mention_count")
        return text.map(lambda t: [dict(zip(names, e)) for e in extract.entities(t)])

    @F.pandas_udf(extract.RELATION)
    def extract_graph(text: pd.Series) -> pd.Series:
        names = ("src", "dst", "weight", "description")
        return text.map(lambda t: [dict(zip(names, r)) for r in extract.relations([e[1] for e in extract.entities(t)])])

    @F.pandas_udf("array<string>")
    def analyze(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else lexical.analyze(t))

    @F.pandas_udf("boolean")
    def ai_if_batch(condition: pd.Series, value: pd.Series) -> pd.Series:
        out = [None] * len(value)
        for c in dict.fromkeys(condition):
            at = [i for i, x in enumerate(condition) if x == c]
            for i, b in zip(at, ai.answers(c, [value.iloc[i] for i in at], model)):
                out[i] = b
        return pd.Series(out, dtype=object)

    def asked(kind: str, parse, prefix: str = ""):
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return ai.replies(s, model, parse, prefix)

        return run

    def embedding(s: pd.Series) -> pd.Series:
        return ai.embedded(s, embed)

    functions = {
        "chunk_text": chunk_text, "extract_entities": extract_entities, "extract_graph": extract_graph, "analyze_text": analyze, "ai_if_batch": ai_if_batch, "cover_density": hybrid.cover_density_udf(), "vector_send": vectors.send_udf(), "vector_recv": vectors.receive_udf(),
        "ai_generate": asked("string", str), "ai_chat": asked("string", str), "ai_summarize": asked("string", str, ai.SUMMARIZE + "\n"), "ai_if": asked("boolean", ai.parse_bool), "ai_if_costly": asked("boolean", ai.parse_bool),
        "ai_analyze_sentiment": asked("string", ai.parse_sentiment), "ai_rank": asked("float", ai.parse_number), "embed": F.pandas_udf(embedding, "array<float>"),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    return [*SCALARS, *functions]
