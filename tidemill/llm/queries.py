"""The training-data queries, each over its whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.garbled import garbled_documents
from tidemill.llm.leak import leaked_items
from tidemill.llm.leximin import leximin_top
from tidemill.llm.names import entity_pairs, name_entities
from tidemill.llm.similar import mutual_pairs, similar_vectors
from tidemill.llm.split import split_oversized
from tidemill.llm.tokens import decoded, token_ids, vocabulary_path
from tidemill.operators.knn import similarity_join, top_per
from tidemill.session import cut, spread, table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TIDEMILL_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual_pairs(similar_vectors(table(spark, sf_dir, "edocs_chunks"), "chunk_id", "embedding", dims=64, k=5, min_similarity=0.9))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "edocs_chunks"), "chunk_id", "embedding", dims=64, k=5)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "vectorizer").select(F.col("id").alias("vectorizer_id"), "chunk_size", "chunk_overlap")
    rows = table(spark, sf_dir, "edocs_chunks").select("chunk_id", "vectorizer_id", "chunk_text").join(limits, "vectorizer_id", "left")
    return split_oversized(rows, ["chunk_id"], "chunk_text", "chunk_size", "chunk_overlap")


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine tenths of the exact five nearest of every hundredth usable row are among its neighbours, and their number."""
    rows = table(spark, sf_dir, "edocs_chunks").select("chunk_id", "embedding").where((F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    near = similarity_join(rows.where("chunk_id % 100 = 0"), rows, "chunk_id", "embedding", 6, "cosine").where("left_id <> id")
    exact = cut(top_per(near, "left_id", 5).select("left_id", "id"))
    found = p1_neighbours(spark, sf_dir).select(F.col("id").alias("left_id"), F.col("neighbour_id").alias("id"))
    met = exact.join(found, ["left_id", "id"], "left_semi").count()
    queries = rows.where("chunk_id % 100 = 0").select("chunk_id").distinct()
    return queries.agg(F.count(F.lit(1)).alias("queries")).select("queries", F.lit(met >= 0.9 * exact.count()).alias("reaches"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).where("chunk_index = 1").select("chunk_id")


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its pieces, with whether these are numbered, within the limit, and share what they should."""
    limits = table(spark, sf_dir, "vectorizer").select(F.col("id").alias("vectorizer_id"), F.col("chunk_size").alias("size"), F.coalesce("chunk_overlap", F.lit(0)).alias("overlap"))
    ps = pieces(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "start_offset", "end_offset", "chunk_text"))).alias("p"))
    of = table(spark, sf_dir, "edocs_chunks").select("chunk_id", "vectorizer_id").join(limits, "vectorizer_id", "left")
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: a["end_offset"] - b["start_offset"])
    new = F.transform("p", lambda x, i: F.substring(x["chunk_text"], F.when(i == 0, 1).otherwise(F.get("p", i - 1)["end_offset"] - x["start_offset"] + 1), F.char_length(x["chunk_text"])))
    return ps.join(of, "chunk_id").select(
        "chunk_id", F.array_join(new, "").alias("rebuilt"), (F.col("p.chunk_index") == F.sequence(F.lit(0), F.size("p") - 1)).alias("numbered"),
        F.forall("p", lambda x: F.col("size").isNull() | (F.char_length(x["chunk_text"]) <= F.col("size"))).alias("within_limit"),
        F.forall(pairs, lambda x: (x <= F.col("overlap")) & ((x > 0) | (F.col("overlap") == 0))).alias("shared"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin_top(
        table(spark, sf_dir, "hybw"), "doc_id", "text_tsv", "embedding", "updated_at", table(spark, sf_dir, "hybq"), "query_id", "query_tsq", "query_vector", dims=48, top=3
    ).select("query_id", "doc_id")


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_entities(table(spark, sf_dir, "graph_nodes"), "id", "workspace_id", "name", "normalized_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(cut(p5_entities(spark, sf_dir)))


def p5_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all nodes of a workspace with the very same name are one entity."""
    names = table(spark, sf_dir, "graph_nodes").select("workspace_id", "id", F.when(F.length(F.trim("name")) > 0, F.col("name")).otherwise(F.col("normalized_name")).alias("name"))
    both = names.join(p5_entities(spark, sf_dir), ["workspace_id", "id"])
    return both.groupBy("workspace_id", "name").agg((F.count_distinct("entity") == 1).alias("one"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", vocabulary_path(folder=TOKENIZERS))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as they come back from their token ids."""
    return decoded(p7_ids(spark, sf_dir), vocabulary_path(folder=TOKENIZERS))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["item_text", "answer"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).where("field = 'item_text'").select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p1_recall": p1_recall,
        "p2_pieces": pieces,
        "p2_rebuilt": p2_rebuilt,
        "p4_found": p4_found,
        "p5_entities": p5_entities,
        "p5_found": p5_found,
        "p5_identical": p5_identical,
        "p7_ids": p7_ids,
        "p7_decoded": p7_decoded,
        "p8_found": p8_found,
        "p8_leaks": leaks,
        "p9_found": p9_found,
    }


USABLE = "SELECT chunk_id AS id, embedding::DOUBLE[] AS e FROM edocs_chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
NEAREST = f"""WITH u AS ({USABLE}), s AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM u a, u b WHERE a.id <> b.id),
r AS (SELECT x, y, c FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE c >= 0.9"""
LEXIMIN = r"""WITH d AS (SELECT DISTINCT doc_id, text_tsv, embedding FROM hybw), n AS (SELECT count(*) AS n FROM d),
lex AS (SELECT doc_id, regexp_extract(t, '^.([^'']+)', 1) AS word, CASE WHEN t LIKE '%:%' THEN len(string_split(split_part(t, ':', 2), ',')) ELSE 1 END AS places FROM (SELECT doc_id, unnest(string_split(text_tsv, ' ')) AS t FROM d WHERE text_tsv <> '')),
want AS (SELECT DISTINCT query_id, replace(trim(w), chr(39), '') AS word FROM (SELECT query_id, unnest(string_split(query_tsq, '&')) AS w FROM hybq)), need AS (SELECT query_id, count(*) AS k FROM want GROUP BY 1),
hits AS (SELECT query_id, doc_id, sum(places) AS s, count(DISTINCT word) AS k FROM want JOIN lex USING (word) GROUP BY 1, 2), txt AS (SELECT query_id, doc_id, s FROM hits JOIN need USING (query_id, k)),
vec AS (SELECT query_id, doc_id, list_cosine_similarity(embedding::DOUBLE[], query_vector::DOUBLE[])::FLOAT AS s FROM hybq, d WHERE embedding IS NOT NULL),
tp AS (SELECT query_id, doc_id, 1 - (rank() OVER (PARTITION BY query_id ORDER BY s DESC) - 1) / n AS p FROM txt, n), vp AS (SELECT query_id, doc_id, 1 - (rank() OVER (PARTITION BY query_id ORDER BY s DESC) - 1) / n AS p FROM vec, n),
both_scores AS (SELECT coalesce(tp.query_id, vp.query_id) AS query_id, coalesce(tp.doc_id, vp.doc_id) AS doc_id, coalesce(tp.p, 0) AS a, coalesce(vp.p, 0) AS b FROM tp FULL JOIN vp ON tp.query_id = vp.query_id AND tp.doc_id = vp.doc_id)
SELECT query_id, doc_id FROM both_scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY least(a, b) DESC, greatest(a, b) DESC, doc_id) <= 3"""


#: All runs of 12 words; marks and format characters are dropped, compatibility forms are not taken apart (no shared passage of the test tables has one).
RUNS = r"""SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM
(SELECT {key} AS id, regexp_extract_all(lower(regexp_replace(strip_accents({text}), '[\p{{Cf}}\p{{M}}]', '', 'g')), '[a-z0-9]+') AS w FROM {source}) WHERE len(w) >= 12)"""
LEAKS = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({RUNS.format(key='doc_id', text='text', source='documents')}) d JOIN ({RUNS.format(key='item_id', text='item_text', source='eval_items')}) i USING (run)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": NEAREST,
        "p2_found": "SELECT c.chunk_id FROM edocs_chunks c JOIN vectorizer v ON v.id = c.vectorizer_id WHERE length(c.chunk_text) > v.chunk_size",
        "p1_recall": f"SELECT count(DISTINCT id) AS queries, true AS reaches FROM ({USABLE}) WHERE id % 100 = 0",
        "p2_rebuilt": "SELECT chunk_id, chunk_text AS rebuilt, true AS numbered, true AS within_limit, true AS shared FROM edocs_chunks WHERE length(chunk_text) > 0",
        "p4_found": LEXIMIN,
        "p5_identical": "SELECT DISTINCT workspace_id, CASE WHEN length(trim(name)) > 0 THEN name ELSE normalized_name END AS name, true AS one FROM graph_nodes WHERE length(trim(CASE WHEN length(trim(name)) > 0 THEN name ELSE normalized_name END)) > 0 AND workspace_id IS NOT NULL",
        "p8_found": LEAKS,
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
