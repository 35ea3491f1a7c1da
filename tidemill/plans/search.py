"""Vector, lexical, hybrid, graph, chunking, model-backed and pipeline queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import vectors as V
from tidemill.operators import ai, chunk, extract, graph, hybrid, knn, lexical, nl
from tidemill.session import cut, scratch_path, spread, table
from tidemill.sources.lakehouse import SnapshotCatalog, parse_vectors
from tidemill.streaming import vectorizer as vz

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def every_hundredth(s: SparkSession, d: str) -> list[tuple[int, list[float]]]:
    """The stated query set: the vectors whose id is divisible by 100."""
    return [(r.vec_id, list(r.embedding)) for r in emb(s, d).where("vec_id % 100 = 0").orderBy("vec_id").collect()]


def first_vector(s: SparkSession, d: str) -> list[float]:
    return every_hundredth(s, d)[0][1]


def with_ids(found: DataFrame, ids: list[int]) -> DataFrame:
    return found.select(F.element_at(F.array(*map(F.lit, ids)), F.col("query_idx") + 1).alias("query_id"), "id", "distance")


def batch_sql(f: str, where: str = "TRUE") -> str:
    return f"""SELECT query_id, id FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {f.format(a='q.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, b.vec_id) AS r
    FROM embeddings b, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE {where}) WHERE r <= 10"""


Q1 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id % 100 = 0 ORDER BY vec_id LIMIT 1)"


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {Q1}), 4) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {Q1}), vec_id LIMIT 10")
def c1_knn_l2(s, d):
    return knn.knn(emb(s, d), "vec_id", "embedding", first_vector(s, d), 10).withColumn("distance", F.round("distance", 4))


@query(f"SELECT vec_id AS id, round(-list_inner_product(embedding::DOUBLE[], {Q1}), 4) AS distance FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {Q1}), vec_id LIMIT 10")
def c1_knn_inner_product(s, d):
    return knn.knn(emb(s, d), "vec_id", "embedding", first_vector(s, d), 10, "ip").withColumn("distance", F.round("distance", 4))


@query(f"SELECT vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], {Q1}), 4) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {Q1}), vec_id LIMIT 10")
def c1_knn_cosine(s, d):
    return knn.knn(emb(s, d), "vec_id", "embedding", first_vector(s, d), 10, "cosine").withColumn("distance", F.round("distance", 4))


@query(batch_sql("list_distance({a}, {b})"))
def c2_knn_batch(s, d):
    q = every_hundredth(s, d)
    return with_ids(knn.knn_batch(emb(s, d), "vec_id", "embedding", [v for _, v in q]), [i for i, _ in q]).select("query_id", "id")


@query(f"SELECT vec_id AS id FROM embeddings WHERE label >= 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], {Q1}), vec_id LIMIT 10")
def c3_filtered_knn(s, d):
    return knn.knn(emb(s, d), "vec_id", "embedding", first_vector(s, d), 10, "cosine", F.col("label") >= 3).select("id")


@query(f"SELECT vec_id AS id FROM embeddings WHERE label IN (2, 5) ORDER BY list_distance(embedding::DOUBLE[], {Q1}), vec_id LIMIT 10")
def c5_labelled_knn(s, d):
    rows = emb(s, d).withColumn("labels", F.array(F.col("label").cast("short")))
    return knn.knn_labels(rows, "vec_id", "embedding", "labels", first_vector(s, d), [2, 5], 10).select("id")


@query(batch_sql("list_cosine_distance({a}, {b})", "b.vec_id <> q.vec_id").replace("r <= 10", "r <= 5").replace("query_id", "left_id"))
def a3_similarity_join(s, d):
    left = emb(s, d).where("vec_id % 100 = 0")
    found = knn.similarity_join(left, emb(s, d), "vec_id", "embedding", 6, "cosine").where("left_id <> id")
    return knn.top_per(found, "left_id", 5).select("left_id", "id")


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.9")
def a3_threshold_join(s, d):
    return knn.threshold_join(emb(s, d), "vec_id", "embedding", 0.9).select("id_a", "id_b")


@query(batch_sql("list_distance({a}, {b})"))
def d1_hnsw_surface(s, d):
    q = every_hundredth(s, d)
    return with_ids(knn.hnsw_knn(emb(s, d), "vec_id", "embedding", [v for _, v in q]), [i for i, _ in q]).select("query_id", "id")


def full_probe(s: SparkSession, d: str, metric: str, soar: float = 0.0) -> DataFrame:
    q = every_hundredth(s, d)
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16, metric, soar)
    return with_ids(index.probe([v for _, v in q], 10), [i for i, _ in q]).select("query_id", "id")


@query(batch_sql("list_distance({a}, {b})"))
def d2_ivf_full_probe(s, d):
    return full_probe(s, d, "l2")


@query(batch_sql("list_cosine_distance({a}, {b})"))
def d2_ivf_cosine_full_probe(s, d):
    return full_probe(s, d, "cosine")


def ivf_probed(s: SparkSession, d: str) -> DataFrame:
    q = every_hundredth(s, d)
    return with_ids(knn.ivfflat_knn(emb(s, d), "vec_id", "embedding", [v for _, v in q], 10, 16, 12), [i for i, _ in q])


def reaches(s: SparkSession, d: str, cases: dict[str, DataFrame]) -> DataFrame:
    """One row for each index: the queries and whether at least nine tenths of their exact nearest ten were found."""
    q = every_hundredth(s, d)
    exact = cut(knn.knn_batch(emb(s, d), "vec_id", "embedding", [v for _, v in q], 10))
    return s.createDataFrame([(name, len(q), bool(knn.recall_at(found, exact) >= 0.9)) for name, found in cases.items()], "index string, queries long, reaches boolean")


def reached_sql(names: list[str]) -> str:
    return f"SELECT index, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS queries, true AS reaches FROM (VALUES {', '.join(f'({n!r})' for n in names)}) t(index)"


@query(reached_sql(["ivf"]))
def d2_ivf_probed(s, d):
    """Twelve of 16 lists."""
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16)
    return reaches(s, d, {"ivf": index.probe([v for _, v in every_hundredth(s, d)], 10, 12)})


@query(reached_sql(["soar"]))
def d9_soar_probed(s, d):
    """Nine of 16 lists with spill."""
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16, soar_lambda=1.0)
    return reaches(s, d, {"soar": index.probe([v for _, v in every_hundredth(s, d)], 10, 9)})


@query(batch_sql("list_distance({a}, {b})"))
def d9_soar_full_probe(s, d):
    return full_probe(s, d, "l2", 1.0)


@query(batch_sql("list_distance({a}, {b})", "b.label <> 4"))
def d12_labelled_ivf(s, d):
    q = every_hundredth(s, d)
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16, keep=["label"])
    return with_ids(index.probe([v for _, v in q], 10, where=F.col("label") != 4), [i for i, _ in q]).select("query_id", "id")


#: Over-fetch of each quantiser at MEASURED rows, where recall at 10 is at least 0.9; more rows get more in proportion.
OVER_FETCH = {"sbq": 32, "pq": 24, "sq8": 8, "aq": 16, "rabitq": 8}
MEASURED = 2_000


def quantised(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        q = every_hundredth(s, d)
        f = {"sbq": knn.sbq_knn, "pq": lambda *a, **k: knn.pq_knn(*a, m=8, centroids=64, **k), "sq8": knn.sq8_knn, "aq": lambda *a, **k: knn.pq_knn(*a, m=16, centroids=16, eta=4.0, **k), "rabitq": knn.rabitq_knn}[kind]
        over_fetch = max(OVER_FETCH[kind], -(-OVER_FETCH[kind] * emb(s, d).count() // MEASURED))
        return with_ids(f(emb(s, d), "vec_id", "embedding", [v for _, v in q], 10, over_fetch=over_fetch), [i for i, _ in q])

    return run


def quantised_recall(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        at = s.createDataFrame([(i, n) for n, (i, _) in enumerate(every_hundredth(s, d))], "query_id long, query_idx int")
        return reaches(s, d, {kind: quantised(kind)(s, d).join(F.broadcast(at), "query_id")})

    return run


for _name, _kind in (("d3_sbq_knn", "sbq"), ("d5_pq_knn", "pq"), ("d6_sq8_knn", "sq8"), ("d7_anisotropic_pq_knn", "aq"), ("d8_rabitq_knn", "rabitq")):
    QUERIES[_name] = quantised_recall(_kind)
    SQL[_name] = reached_sql([_kind])


@query("SELECT label, 8 AS one_bit, 16 AS two_bits, count(*) AS n FROM embeddings GROUP BY 1")
def d4_code_size(s, d):
    return emb(s, d).groupBy("label").agg(F.lit(V.sbq_bytes_per_vector(64, 1)).alias("one_bit"), F.lit(V.sbq_bytes_per_vector(64, 2)).alias("two_bits"), F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, len(embedding) AS dims, true AS valid FROM embeddings")
def b_vector_text_round_trip(s, d):
    back = V.parse_vector(V.vector_text("embedding"))
    return emb(s, d).select("vec_id", F.size(back).alias("dims"), (back == F.col("embedding")).alias("valid"))


@query(
    """SELECT CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS query_idx, p AS lists_probed, p = 16 AS every_row, true AS as_stored
    FROM embeddings, (VALUES (CAST(3 AS BIGINT)), (16)) t(p) WHERE vec_id % 100 = 0"""
)
def d16_scan_stats(s, d):
    """Whether 3 and 16 of 16 lists read every row, and whether the figures are those of the lists as assigned anew."""
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16)
    q, total = [v for _, v in every_hundredth(s, d)], emb(s, d).count()
    sizes = {r.list: r.n for r in knn.vindex_assign(index, emb(s, d), "vec_id", "embedding").groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = index.ranked_lists(np.array(q))
    parts = []
    for p in (3, 16):
        want = s.createDataFrame([(i, sum(sizes.get(int(x), 0) for x in row[:p])) for i, row in enumerate(near)], "query_idx int, want long")
        parts.append(knn.scan_stats(index, q, p).join(F.broadcast(want), "query_idx").select("query_idx", "lists_probed", (F.col("rows_scanned") == total).alias("every_row"), (F.col("rows_scanned") == F.col("want")).alias("as_stored")))
    return parts[0].unionByName(parts[1])


@query("SELECT true AS in_range, true AS enough, true AS least")
def d15_recommended_probes(s, d):
    """Whether the recommended probes reach the target and one fewer does not."""
    q = [v for _, v in every_hundredth(s, d)]
    index = knn.ivf_build(emb(s, d), "vec_id", "embedding", 16)
    exact = cut(knn.knn_batch(emb(s, d), "vec_id", "embedding", q))
    p = knn.recommend_probes(index, exact, q, 10, 0.95)
    enough, fewer = (knn.recall_at(index.probe(q, 10, n), exact) >= 0.95 if n else False for n in (p, p - 1))
    return s.createDataFrame([(1 <= p <= 16, enough, not fewer)], "in_range boolean, enough boolean, least boolean")


# --- lexical and hybrid -----------------------------------------------------------------------------------

TERMS = "SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: w <> '')) AS term FROM documents WHERE text IS NOT NULL"
BM25 = f"""WITH t AS ({TERMS}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT d.doc_id, count(t.term) AS len FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM len),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('vector', 'index', 'latency') GROUP BY 1)
SELECT tf.doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1 ORDER BY score DESC, id LIMIT 20"""


@query(BM25)
def f2_bm25_plain(s, d):
    return lexical.bm25_scan(spread(table(s, d, "documents")), "doc_id", "text", "vector index latency", 20, stemmed=False).withColumn("score", F.round("score", 6))


STEMMED = rf"""WITH k AS (SELECT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE strlen(w) <= 40),
t AS (SELECT doc_id, CASE WHEN regexp_full_match(w, 'index(es|ed|ing|s|ly)?') THEN 'index' WHEN regexp_full_match(w, 'vector(s|ed|ing)?') THEN 'vector' WHEN w IN ('latency', 'latencies') THEN 'latenc' END AS term FROM k WHERE w NOT IN ({', '.join(f"'{w}'" for w in sorted(lexical.STOP_WORDS))})),
len AS (SELECT d.doc_id, count(t.doc_id) AS len FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IS NOT NULL GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT tf.doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1 ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) DESC, id LIMIT 20"""


@query(STEMMED)
def f2_bm25_stemmed(s, d):
    folder = scratch_path(s, "bm25")
    lexical.bm25_build(spread(table(s, d, "documents")), "doc_id", "text", folder)
    return lexical.bm25_search(s, folder, "indexing vectors and latencies", 20).withColumn("score", F.round("score", 6))


@query(BM25)
def f1_bm25_index(s, d):
    folder = scratch_path(s, "bm25")
    lexical.bm25_build(spread(table(s, d, "documents")), "doc_id", "text", folder, stemmed=False)
    return lexical.bm25_search(s, folder, "vector index latency", 20, stemmed=False).withColumn("score", F.round("score", 6))


HYB = "SELECT DISTINCT doc_id, body, embedding FROM hybw"
HQ = "(SELECT query_vector::DOUBLE[] FROM hybq ORDER BY query_id LIMIT 1)"
RRF = f"""WITH h AS ({HYB}), w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM h WHERE body IS NOT NULL),
v AS (SELECT doc_id, list_cosine_distance(embedding::DOUBLE[], {HQ}) AS s FROM h WHERE embedding IS NOT NULL ORDER BY s, doc_id LIMIT 20), vr AS (SELECT doc_id, rank() OVER (ORDER BY s) AS rv FROM v),
x AS (SELECT doc_id, len(list_filter(t, lambda z: z IN ('index', 'vector'))) AS s FROM w WHERE list_has_all(t, ['index', 'vector']) ORDER BY s DESC, doc_id LIMIT 20), xr AS (SELECT doc_id, rank() OVER (ORDER BY s DESC) AS rt FROM x)
SELECT coalesce(vr.doc_id, xr.doc_id) AS id, round(coalesce(2.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rt), 0), 5) AS score FROM vr FULL JOIN xr ON vr.doc_id = xr.doc_id ORDER BY coalesce(2.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rt), 0) DESC, id LIMIT 10"""


@query(RRF)
def e_hybrid_rrf(s, d):
    docs = table(s, d, "hybw").select("doc_id", "body", "embedding").distinct()
    q = table(s, d, "hybq").orderBy("query_id").select("query_vector").first()[0]
    found = hybrid.hybrid_search_rrf(docs, "doc_id", "body", "embedding", "index vector", list(q), vector_weight=2.0, result_limit=10, engine="count")
    return found.select("id", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(
    r"""SELECT doc_id AS id, round(0.1 * n, 6) AS score FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: regexp_full_match(lower(w), 'vector(s|ed|ing)?'))) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0"""
)
def e_cover_density(s, d):
    """With one word every place is a cover."""
    return hybrid.text_cover(spread(table(s, d, "documents")), "doc_id", "text", "vectors").select(F.col("id").cast("long").alias("id"), F.round("s", 6).alias("score"))


# --- graph ------------------------------------------------------------------------------------------------

ADJ = "adj AS (SELECT src_id AS src, dst_id AS dst FROM graph_edges WHERE src_id IS NOT NULL AND dst_id IS NOT NULL UNION ALL SELECT dst_id, src_id FROM graph_edges WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"


def within(hops: int, name: str, sets: bool = False) -> str:
    """CTEs of the nodes within some hops of the seeds, one a hop."""
    key = "set_id, " if sets else ""
    out = [f"{name}0 AS (SELECT DISTINCT {'id AS set_id, ' if sets else ''}id AS node FROM graph_nodes WHERE id % 100 = 0 AND id <= (SELECT max(src) FROM adj))"]
    out += [f"{name}{h} AS (SELECT {key}node FROM {name}{h - 1} UNION SELECT {key}adj.dst FROM {name}{h - 1} JOIN adj ON adj.src = node)" for h in range(1, hops + 1)]
    return ", ".join(out)


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_edges")


def seeds(s: SparkSession, d: str) -> list[int]:
    return [r.id for r in table(s, d, "graph_nodes").where("id % 100 = 0").select("id").collect()]


def adj(s: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(edges(s, d), "src_id", "dst_id")


@query(f"WITH {ADJ} SELECT src, dst, count(*) AS n FROM adj GROUP BY 1, 2")
def g1_adjacency(s, d):
    folder = scratch_path(s, "graph")
    graph.graph_build(edges(s, d), "src_id", "dst_id", folder)
    return graph.load(s, folder).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ADJ}, {within(1, 'w')} SELECT node FROM w1")
def g3_expand(s, d):
    return graph.expand(adj(s, d), seeds(s, d), 1)


@query(f"WITH {ADJ}, {within(2, 'w', True)} SELECT set_id, node FROM w2")
def g5_expand_multi(s, d):
    start = table(s, d, "graph_nodes").where("id % 100 = 0").select(F.col("id").alias("set_id"), F.col("id").alias("node"))
    return graph.expand_multi(adj(s, d), start, 2)


@query(f"WITH {ADJ}, {within(1, 'w', True)} SELECT set_id, count(*) AS n FROM w1 GROUP BY 1")
def g4_expand_cardinality(s, d):
    start = table(s, d, "graph_nodes").where("id % 100 = 0").select(F.col("id").alias("set_id"), F.col("id").alias("node"))
    return graph.expand_multi(adj(s, d), start, 1).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


def ppr_sql(iterations: int, damping: float) -> str:
    parts = [
        ADJ, "deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY 1)", "arcs AS (SELECT adj.src, dst, count(*)::DOUBLE / any_value(deg) AS p FROM adj JOIN deg ON adj.src = deg.src GROUP BY 1, 2)",
        "r AS (SELECT id AS node, 1.0 / count(*) OVER () AS r FROM graph_nodes WHERE id % 100 = 0 AND id <= (SELECT max(src) FROM adj))", "p0 AS (SELECT node, r AS score FROM r)",
    ]
    for i in range(1, iterations + 1):
        parts.append(f"s{i} AS (SELECT dst AS node, {damping} * sum(score * p) AS s FROM p{i - 1} JOIN arcs ON arcs.src = node GROUP BY 1), p{i} AS (SELECT coalesce(s{i}.node, r.node) AS node, coalesce(s, 0) + {1 - damping} * coalesce(r, 0) AS score FROM s{i} FULL JOIN r ON s{i}.node = r.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(score, 8) AS score FROM p{iterations} WHERE score > 1e-12"


@query(ppr_sql(6, 0.5))
def g6_ppr(s, d):
    return graph.ppr(adj(s, d), seeds(s, d), 0.5, 6).select("node", F.round("score", 8).alias("score"))


@query(f"WITH {ADJ}, {within(2, 'w')} SELECT node FROM w2 EXCEPT SELECT node FROM w1")
def g7_path_match(s, d):
    return graph.pgq_match(adj(s, d), seeds(s, d), "-[e*2..2]-")


def entity_ctes(source: str, key: str, text: str, p: str) -> str:
    """CTEs {p}ent (id, name, normalized_name, mention_count, place) and {p}rel (id, src, dst) of the capitalised runs of a text column."""
    stop = "[" + ", ".join(f"'{w}'" for w in sorted(extract.EDGE_WORDS)) + "]"
    return rf"""{p}tok AS (SELECT {key} AS id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT {key}, regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS l FROM {source} WHERE {text} IS NOT NULL)),
{p}mark AS (SELECT id, t, i, regexp_matches(t, '^\p{{Lu}}') AS cap, regexp_full_match(t, ' +') AS gap FROM {p}tok),
{p}run AS (SELECT id, t, i, cap, sum(CASE WHEN cap OR gap THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS r FROM {p}mark),
{p}words AS (SELECT id, min(i) AS i, list(t ORDER BY i) AS w FROM {p}run WHERE cap GROUP BY id, r),
{p}ends AS (SELECT id, i, w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains({stop}, lower(w[k]))) AS live FROM {p}words),
{p}span AS (SELECT id, i, array_to_string(w[live[1]:live[len(live)]], ' ') AS name, live[len(live)] - live[1] AS more FROM {p}ends WHERE len(live) > 0),
{p}all AS (SELECT id, lower(name) AS normalized_name, arg_min(name, i) AS name, count(*) AS mention_count, min(i) AS i FROM {p}span WHERE more > 0 OR length(name) >= 3 GROUP BY 1, 2),
{p}ent AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS place FROM {p}all QUALIFY place <= 64),
{p}rel AS (SELECT a.id, least(a.normalized_name, b.normalized_name) AS src, greatest(a.normalized_name, b.normalized_name) AS dst FROM {p}ent a JOIN {p}ent b ON a.id = b.id AND b.place > a.place AND b.place <= a.place + 4)"""


DOC_ENT = entity_ctes("documents", "doc_id", "text", "d_")


@query(f"WITH {DOC_ENT} SELECT id, name, normalized_name, 'entity' AS entity_type, CAST(mention_count AS INTEGER) AS mention_count FROM d_ent")
def g8_entities(s, d):
    return extract.extract_entities(spread(table(s, d, "documents")), "doc_id", "text")


@query(f"WITH {DOC_ENT} SELECT id, src, dst, CAST(1 AS INTEGER) AS weight, '' AS description FROM d_rel")
def g9_relations(s, d):
    return extract.extract_graph(spread(table(s, d, "documents")), "doc_id", "text")


@query(
    f"""WITH {DOC_ENT}, {entity_ctes("eval_items", "item_id", "item_text", "e_")}
    SELECT 'w' AS workspace_id, 'c' AS collection_id, src, dst, count(*) AS weight, '' AS description, list_sort(list_distinct(list(CAST(id AS VARCHAR)))) AS source_chunk_ids FROM (SELECT * FROM d_rel UNION ALL SELECT * FROM e_rel) GROUP BY src, dst"""
)
def g11_graph_upsert(s, d):
    nodes, links = extract.graph_upsert(None, None, spread(table(s, d, "documents")), "w", "c", "doc_id", "text")
    return extract.graph_upsert(nodes.withColumn("mention_count", F.col("mention_count").cast("int")), links.withColumn("weight", F.col("weight").cast("int")), table(s, d, "eval_items"), "w", "c", "item_id", "item_text")[1]


LETTERS = "abcdefghijklmnop"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A model that SQL can repeat: how often each of 16 letters occurs, in either case."""
    return [[float(t.count(c) + t.count(c.upper())) for c in LETTERS] for t in texts]


def letters_sql(text: str) -> str:
    return f"list_transform({list(LETTERS)!r}, lambda c: CAST(2 * length({text}) - length(replace({text}, c, '')) - length(replace({text}, upper(c), '')) AS FLOAT))"


RAG = f"""WITH {ADJ}, ws AS (SELECT workspace_id AS w, collection_id AS c FROM graph_nodes GROUP BY ALL ORDER BY count(*) DESC, w, c LIMIT 1),
e AS (SELECT id, {letters_sql('name')}::DOUBLE[] AS v FROM graph_nodes, ws WHERE workspace_id = w AND collection_id = c AND name IS NOT NULL),
w0 AS (SELECT id AS node FROM e ORDER BY CASE WHEN list_sum(v) > 0 THEN list_cosine_distance(v, {letters_sql("'data systems'")}::DOUBLE[]) ELSE 'nan'::DOUBLE END, id LIMIT 5),
w1 AS (SELECT node FROM w0 UNION SELECT dst FROM w0 JOIN adj ON src = node), w2 AS (SELECT node FROM w1 UNION SELECT dst FROM w1 JOIN adj ON src = node)
SELECT chunk_id, sum(weight) AS score FROM (SELECT unnest(source_chunk_ids) AS chunk_id, weight FROM graph_edges, ws WHERE workspace_id = w AND collection_id = c AND (src_id IN (SELECT node FROM w2) OR dst_id IN (SELECT node FROM w2))) GROUP BY 1"""


@query(RAG)
def g13_graph_rag(s, d):
    named = extract.embed_nodes(table(s, d, "graph_nodes").withColumn("embedding", F.lit(None).cast("array<float>")), letter_counts)
    ws = table(s, d, "graph_nodes").groupBy("workspace_id", "collection_id").count().orderBy(F.desc("count"), "workspace_id", "collection_id").first()
    return graph.graph_rag_search(cut(named), edges(s, d), letter_counts(["data systems"])[0], ws.workspace_id, ws.collection_id)


# --- chunking, models, pipeline, questions ----------------------------------------------------------------


@query(
    """SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 448 + 1 AS BIGINT), 512) AS chunk_text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 512) / 448.0) AS BIGINT), 0))) AS i FROM documents WHERE length(text) > 0)"""
)
def h_chunk_fixed(s, d):
    return chunk.chunk_rows(table(s, d, "documents"), "doc_id", "text", "fixed", 512, 64)


WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIZE, OVERLAP = 512, 64


def trimmed(t: str) -> str:
    return f"regexp_replace({t}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def cut_by_force(t: str) -> str:
    step = SIZE - OVERLAP
    return f"list_transform(range(0, CAST(greatest(ceil((length({t}) - {SIZE}) / {step}.0), 0) AS BIGINT) + 1), lambda z: substr({t}, z * {step} + 1, {SIZE}))"


def parts_sql(t: str, separators: list[str], level: int = 0) -> str:
    """The parts of at most SIZE characters at the highest separators that give such."""
    deeper = cut_by_force(t)
    if level < len(separators):
        inner = parts_sql(f"p{level}", separators, level + 1)
        deeper = f"flatten(list_transform(list_filter(string_split({t}, {separators[level]}), lambda q{level}: {trimmed(f'q{level}')} <> ''), lambda p{level}: {inner}))"
    return f"CASE WHEN length({t}) <= {SIZE} THEN [{trimmed(t)}] ELSE {deeper} END"


def packed_sql(atoms: str) -> str:
    """Chunks of atoms packed up to SIZE, each beginning with the last atoms of the one before up to OVERLAP."""
    held, joined = "a.k", "array_to_string(a.k, ' ')"
    carry = f"{held}[list_filter(range(1, len({held}) + 2), lambda i: length(array_to_string({held}[i:], ' ')) <= {OVERLAP})[1]:]"
    step = f"CASE WHEN length({joined}) + 1 + length(x.k[1]) > {SIZE} THEN {{'c': list_append(a.c, {joined}), 'k': list_append({carry}, x.k[1])}} ELSE {{'c': a.c, 'k': list_append({held}, x.k[1])}} END"
    return f"""SELECT doc_id AS id, CAST(i - 1 AS INTEGER) AS chunk_index, chunks[i] AS chunk_text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM (SELECT doc_id, list_append(r.c, array_to_string(r.k, ' ')) AS chunks FROM
    (SELECT doc_id, list_reduce(list_transform(atoms, lambda t: {{'c': CAST([] AS VARCHAR[]), 'k': [t]}}), lambda a, x: {step}) AS r FROM (SELECT doc_id, {atoms} AS atoms FROM documents WHERE {trimmed('text')} <> '') WHERE len(atoms) > 0)))"""


SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])({WHITE}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda t: {trimmed('t')}), lambda t: t <> '')"


@query(packed_sql(f"flatten(list_transform({SENTENCES}, lambda s: CASE WHEN length(s) > {SIZE} THEN {cut_by_force('s')} ELSE [s] END))"))
def h_chunk_sentence(s, d):
    return chunk.chunk_rows(spread(table(s, d, "documents")), "doc_id", "text", "sentence", SIZE, OVERLAP)


@query(packed_sql(parts_sql("text", ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"])))
def h_chunk_recursive(s, d):
    return chunk.chunk_rows(spread(table(s, d, "documents")), "doc_id", "text", "recursive", SIZE, OVERLAP)


@query("SELECT event_id, event_id % 2 = 0 AS even FROM events")
def i3_ai_if(s, d):
    return table(s, d, "events").select("event_id", ai.ai_if(F.concat(F.lit("is this even? "), F.col("event_id").cast("string"))).alias("even"))


@query("SELECT job_id, CASE WHEN source_pk IS NULL THEN NULL ELSE job_id % 2 = 0 END AS even FROM (SELECT DISTINCT job_id, source_pk IS NULL AS gone, CASE WHEN source_pk IS NULL THEN NULL ELSE 'x' END AS source_pk FROM vectorizer_queue)")
def i7_ai_if_batch(s, d):
    rows = table(s, d, "vectorizer_queue").select("job_id", F.when(F.col("source_pk").isNotNull(), F.col("job_id").cast("string")).alias("v")).distinct()
    return rows.select("job_id", ai.if_batch("is even", F.col("v")).alias("even"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM events")
def i2_generate(s, d):
    return table(s, d, "events").select("event_id", ai.generate(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("answer"))


@query("SELECT event_id, CAST(user_id AS FLOAT) AS score FROM events")
def i5_rank(s, d):
    return table(s, d, "events").select("event_id", ai.rank(F.col("user_id").cast("string"), lambda p: [f"score {x}" for x in p]).alias("score"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM events")
def i4_sentiment(s, d):
    return table(s, d, "events").select("event_id", ai.analyze_sentiment(F.col("user_id").cast("string"), lambda p: ["positive" if int(x) % 2 == 0 else "negative" for x in p]).alias("sentiment"))


@query("SELECT event_id FROM events WHERE value > 50 AND event_id % 2 = 0")
def i8_cheap_predicates_first(s, d):
    """The model's condition is written first and asked last."""
    return table(s, d, "events").where(ai.if_costly(F.concat(F.lit("even: "), F.col("event_id").cast("string"))) & (F.col("value") > 50)).select("event_id")


def joined_text(prompts: list[str]) -> list[str]:
    """A model that gives back what it was asked to summarise."""
    return [p.split("\n", 1)[1] for p in prompts]


@query(
    """SELECT source, CASE WHEN count(*) FILTER (WHERE length(text) > 0) > 0 THEN left(string_agg(text, chr(10) ORDER BY doc_id) FILTER (WHERE length(text) > 0), 12000) END AS summary FROM documents GROUP BY 1"""
)
def a4_agg_summarize(s, d):
    return ai.agg_summarize(table(s, d, "documents").select("source", "text", "doc_id"), ["source"], "text", "doc_id", joined_text)


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {letters_sql('text')} END AS embedding FROM documents")
def i10_embed(s, d):
    return table(s, d, "documents").select("doc_id", ai.embed_column(F.col("text"), letter_counts, 16).alias("embedding"))


@query(
    """SELECT vectorizer_id, source_pk, min(job_id) AS job_id, struct_extract(max({'j': job_id, 'o': op}) FILTER (WHERE op IS NOT NULL), 'o') AS op, min(enqueued_at) AS enqueued_at, max(attempts) AS attempts
    FROM (SELECT * REPLACE (lower(trim(op)) AS op) FROM vectorizer_queue WHERE state = 'pending') GROUP BY 1, 2"""
)
def j2_coalesced_jobs(s, d):
    return vz.coalesce_jobs(table(s, d, "vectorizer_queue"))


@query("SELECT vectorizer_id, state, count(*) AS jobs, min(enqueued_at) AS oldest FROM vectorizer_queue GROUP BY 1, 2")
def j5_queue_stats(s, d):
    return vz.stats(table(s, d, "vectorizer_queue"))


NOW = "TIMESTAMP '2025-07-01 00:00:00'"


@query(
    f"""SELECT job_id, vectorizer_id, attempts, CASE WHEN (state = 'pending' AND (lease_deadline IS NULL OR lease_deadline <= {NOW}) OR state = 'processing' AND lease_deadline < {NOW}) AND coalesce(attempts, 0) < 5 THEN true ELSE false END AS claimable FROM vectorizer_queue"""
)
def j3_claimable(s, d):
    now = F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")
    return table(s, d, "vectorizer_queue").select("job_id", "vectorizer_id", "attempts", vz.claimable(now).alias("claimable"))


CHUNKS = "SELECT doc_id, i, substr(text, CAST(i * 448 + 1 AS BIGINT), 512) AS t FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 512) / 448.0) AS BIGINT), 0))) AS i FROM documents WHERE length(text) > 0)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS source_pk, CAST(i AS INTEGER) AS chunk_index, t AS chunk_text, {letters_sql('t')} AS embedding FROM ({CHUNKS})")
def j6_embedded_chunks(s, d):
    v = vz.Vectorizer(1, "doc_id", "text", 16, letter_counts, "fixed", 512, 64)
    return vz.embed_jobs(v, table(s, d, "documents").withColumn("op", F.lit("upsert")))


@query("SELECT '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"n\":' || count(*) || '}' AS row FROM orders GROUP BY o_orderstatus")
def k2_nl_query(s, d):
    od = table(s, d, "orders")
    od.createOrReplaceTempView("orders")
    return nl.nl_query(s, "how many orders of each status?", ["orders"], lambda p: ["SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus;"])


@query("SELECT event_type AS category, count(*) AS c, round(avg(value), 4) AS a FROM events GROUP BY 1")
def a1_snapshot_olap(s, d):
    catalog = SnapshotCatalog(s, scratch_path(s, "snapshots"))
    catalog.refresh("events", table(s, d, "events"))
    return catalog.olap("events", "event_type", "value")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dims, '{}' AS metadata FROM embeddings")
def a1_import_vectors(s, d):
    items = emb(s, d).select(F.to_json(F.array(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("values")))).alias("j"))
    return parse_vectors(items, "j").select("id", F.size("embedding").alias("dims"), "metadata")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
