"""Entities and their co-occurrence graph from text, by capitalisation heuristics or a model, with additive upsert."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTITIES = 64
WINDOW = 4
# Words that begin or end a capitalised run without being part of a name.
EDGE_WORDS = set(
    "the a an and or but of in on at to for from by with as is are was were be been it this that these those we you they he she i if then so not no yes our their his her its when while after before".split()
)
#: Capitalised words with nothing but blanks between them.
RUN = regex.compile(r"(?<![\p{Alphabetic}\p{N}])\p{Uppercase}[\p{Alphabetic}\p{N}]*(?: +\p{Uppercase}[\p{Alphabetic}\p{N}]*)*")

Graph = tuple[list[tuple[str, str, str, int]], list[tuple[str, str, int, str]]]


def normalize(name: str) -> str:
    return " ".join(name.lower().split())


def entities(text: str | None, most: int = MAX_ENTITIES) -> list[tuple[str, str, str, int]]:
    """(name, normalized_name, entity_type, mention_count) of the first ``most`` distinct entities in order of appearance."""
    found: dict[str, list] = {}
    for run in RUN.findall(text or ""):
        words = run.split()
        while words and words[0].lower() in EDGE_WORDS:
            words.pop(0)
        while words and words[-1].lower() in EDGE_WORDS:
            words.pop()
        if not words or (len(words) == 1 and len(words[0]) < 3):
            continue
        name = " ".join(words)
        entry = found.setdefault(normalize(name), [name, normalize(name), "entity", 0])
        entry[3] += 1
    return [tuple(e) for e in list(found.values())[:most]]


def relations(names: list[str], window: int = WINDOW) -> list[tuple[str, str, int, str]]:
    """(src, dst, weight, description) of distinct entities at most ``window`` places apart in order of appearance; src <= dst."""
    return [(min(a, b), max(a, b), 1, "") for i, a in enumerate(names) for b in names[i + 1 : i + 1 + window]]


def parse_reply(reply: str, text: str | None, most: int = MAX_ENTITIES, window: int = WINDOW) -> Graph:
    """Lines ``E<|>name<|>type`` and ``R<|>source<|>target<|>description`` of a model's reply, others skipped.

    Repeated entities and relations add up, the first description that is not empty stays. Entities without
    a relation are related by their window; a reply without entities falls back to the heuristic.
    """
    ents: dict[str, list] = {}
    rels: dict[tuple[str, str], list] = {}
    for line in (reply or "").splitlines():
        parts = [p.strip() for p in line.split("<|>")]
        if parts[0].upper() == "E" and len(parts) == 3 and parts[1]:
            n = normalize(parts[1])
            ents.setdefault(n, [parts[1], n, parts[2], 0])[3] += 1
        elif parts[0].upper() == "R" and len(parts) == 4:
            a, b = sorted((normalize(parts[1]), normalize(parts[2])))
            if a and a != b:
                held = rels.setdefault((a, b), [0, ""])
                held[0] += 1
                held[1] = held[1] or parts[3]
    if not ents:
        own = entities(text, most)
        return own, relations([e[1] for e in own], window)
    return [tuple(e) for e in ents.values()], [(a, b, *v) for (a, b), v in rels.items()] or relations(list(ents), window)


ENTITY = "array<struct<name:string,normalized_name:string,entity_type:string,mention_count:int>>"
RELATION = "array<struct<src:string,dst:string,weight:int,description:string>>"


def extract(df: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], list[str]] | None = None, most: int = MAX_ENTITIES, window: int = WINDOW) -> DataFrame:
    """(id, entities, relations) of each text; with a model, one call per Arrow batch. At most ``most`` entities of a text are kept."""
    fields = (("name", "normalized_name", "entity_type", "mention_count"), ("src", "dst", "weight", "description"))

    @F.pandas_udf(f"struct<entities:{ENTITY},relations:{RELATION}>")
    def run(s: pd.Series) -> pd.DataFrame:
        if model is None:
            graphs = [(e, relations([x[1] for x in e], window)) for e in s.map(functools.partial(entities, most=most))]
        else:
            graphs = [parse_reply(r, t, most, window) for r, t in zip(model([" ".join((t or "").splitlines()) for t in s]), s)]
        return pd.DataFrame({"entities": [[dict(zip(fields[0], x)) for x in g[0]] for g in graphs], "relations": [[dict(zip(fields[1], x)) for x in g[1]] for g in graphs]})

    return df.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("g")).select("id", "g.entities", "g.relations")


def extract_entities(df: DataFrame, id_col: str, text_col: str, model=None) -> DataFrame:
    return extract(df, id_col, text_col, model).select("id", F.explode("entities").alias("e")).select("id", "e.*")


def extract_graph(df: DataFrame, id_col: str, text_col: str, model=None) -> DataFrame:
    return extract(df, id_col, text_col, model).select("id", F.explode("relations").alias("r")).select("id", "r.*")


def graph_upsert(nodes: DataFrame | None, edges: DataFrame | None, chunks: DataFrame, workspace: str, collection: str, id_col: str, text_col: str, model=None) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges after adding the chunks: counts and weights add up, names, types and the first description that is not empty stay, chunk ids form a set.

    What is there comes before the chunks, and these in the order of their ids (as text).
    """
    g = extract(chunks, id_col, text_col, model)
    keys = [F.lit(workspace).alias("workspace_id"), F.lit(collection).alias("collection_id")]
    at = F.struct(F.lit(1), F.col("id").cast("string")).alias("__at")
    before = F.struct(F.lit(0), F.lit("")).alias("__at")
    fresh = g.select(*keys, F.explode("entities").alias("e"), at).select("workspace_id", "collection_id", "e.*", "__at")
    merged = fresh if nodes is None else nodes.withColumn("__at", before).select(fresh.columns).unionByName(fresh)
    new_nodes = merged.groupBy("workspace_id", "collection_id", "normalized_name").agg(
        F.min_by("name", F.struct("__at", "name")).alias("name"), F.min_by("entity_type", F.struct("__at", "entity_type")).alias("entity_type"), F.sum("mention_count").cast("long").alias("mention_count")
    )
    linked = g.select(*keys, F.explode("relations").alias("r"), F.array(F.col("id").cast("string")).alias("source_chunk_ids"), at).select("workspace_id", "collection_id", "r.*", "source_chunk_ids", "__at")
    all_edges = linked if edges is None else edges.withColumn("__at", before).select(linked.columns).unionByName(linked)
    said = F.nullif("description", F.lit(""))
    new_edges = all_edges.groupBy("workspace_id", "collection_id", "src", "dst").agg(
        F.sum("weight").cast("long").alias("weight"), F.coalesce(F.min_by(said, F.when(said.isNotNull(), F.struct("__at", said))), F.lit("")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunk_ids")))).alias("source_chunk_ids"),
    )
    return new_nodes, new_edges


def embed_nodes(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Fill null embeddings from the node names; the others stay."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        live = [i for i, t in enumerate(s) if t is not None]
        made = dict(zip(live, embed([s.iloc[i] for i in live]))) if live else {}
        return pd.Series([made.get(i) for i in range(len(s))], dtype=object)

    return nodes.withColumn("embedding", F.coalesce("embedding", run(F.when(F.col("embedding").isNull(), F.col("name")))))
