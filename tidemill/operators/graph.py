"""Undirected graph traversal on a symmetrised edge table.

Frontiers are DataFrames; every hop joins the frontier with the adjacency, keeps new nodes and is cut to
the shared folder, so lineage stays short and a lost executor costs one hop. The adjacency of a built graph
is written once, sorted by source, and read by every later traversal until it is built again. Sets that are
expanded together are bits of a node's row and merged by bitwise or; the pairs of set and node are made when
the result is read. A small frontier is sent to all tasks. For a larger one, the arcs of a hub are dealt out
over as many salts as it has stretches of ``ARCS_A_TASK``, and frontier rows that reach a hub are repeated
for its salts, so no task gets a hub as a whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter
from tidemill.operators.change_feed import file_system, publish, read_current
from tidemill.session import cut

MAX_NODE = 2**32 - 1
#: Arcs of one node that a task may get; a node with more is a hub.
ARCS_A_TASK = 50_000
#: Words of 64 sets in a row of bits; more sets take several rows (blocks) a node.
WORDS = 32
#: Sets that a task may number.
SETS_A_TASK = 1_000_000
#: Rows (set, node) that a task gives out, nearly.
ROWS_A_TASK = 2_000_000
#: Bytes of a table that is sent to all tasks; a larger one is shuffled. Beside its words a row takes ROW_BYTES, a set SET_BYTES.
SENT, ROW_BYTES, SET_BYTES = 64 << 20, 64, 64


def adjacency(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst) in both directions with multiplicity; null endpoints dropped, a self-loop gives two entries."""
    e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return e.select(ends.alias("e")).select("e.*")


def graph_build(edges: DataFrame, src: str, dst: str, folder: str) -> int:
    """Write the adjacency under ``folder``; returns the number of edges, repeated ones included."""
    adj = adjacency(edges, src, dst)
    bad = adj.where(~F.col("src").between(0, MAX_NODE)).limit(1).count()
    if bad:
        raise InvalidParameter(f"node ids must lie in 0..{MAX_NODE}")
    publish(adj.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), folder)
    return read_current(edges.sparkSession, folder).count() // 2


def graph_refold(edges: DataFrame, src: str, dst: str, folder: str) -> int:
    """Build again; an error if the graph was never built. Readers see the old snapshot until it is done."""
    read_current(edges.sparkSession, folder)
    return graph_build(edges, src, dst, folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return read_current(spark, folder)


def salted_arcs(arcs: DataFrame, arcs_a_task: int) -> tuple[DataFrame, DataFrame | None]:
    """``arcs`` with a salt, written once, and the hubs as (src, salts); hubs are at most one row for ``arcs_a_task`` arcs."""
    hubs = cut(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > arcs_a_task).select("src", F.ceil(F.col("n") / arcs_a_task).cast("int").alias("salts")))
    if hubs.isEmpty():
        return cut(arcs.withColumn("salt", F.lit(0))), None
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int"))
    return cut(arcs.join(hubs, "src", "left").withColumn("salt", salt).drop("salts")), hubs


def along(front: DataFrame, node: str, arcs: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``front`` joined with the arcs that leave its nodes; ``hubs`` is what ``salted_arcs`` found."""
    if hubs is None:
        return front.join(arcs.withColumnRenamed("src", node), node).drop("salt")
    spread = front.join(hubs.withColumnRenamed("src", node), node, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return spread.join(arcs.withColumnRenamed("src", node), [node, "salt"]).drop("salt")


def numbered_sets(start: DataFrame) -> tuple[DataFrame, int]:
    """(set_id, word, pos): each set's place in words of 64 sets, written once; and the number of sets."""
    ids = start.select("set_id").distinct()
    n = ids.count()
    i = ids.coalesce(n // SETS_A_TASK + 1).withColumn("i", F.monotonically_increasing_id())
    return cut(i.select("set_id", F.shiftright("i", 6).alias("word"), F.col("i").bitwiseAND(63).cast("int").alias("pos"))), n


def members(seen: DataFrame, sets: DataFrame, words: list[str], send: bool) -> DataFrame:
    """The rows of bits as (set_id, node); tasks give out about ``ROWS_A_TASK`` rows each."""
    total = seen.agg(F.sum(sum((F.bit_count(w) for w in words), F.lit(0)).cast("long"))).first()[0] or 0
    if total > ROWS_A_TASK:
        seen = seen.repartition(total // ROWS_A_TASK + 1, "block", "node")
    bits = F.explode(F.array(*(F.struct((F.col("block") * len(words) + i).alias("word"), F.col(w).alias("bits")) for i, w in enumerate(words))))
    own = sets.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "set_id"))), lambda x: x["set_id"]).alias("sets"))
    held = seen.select("node", bits.alias("b")).select("node", "b.*").where("bits != 0").join(F.broadcast(own) if send else own, "word")
    return held.select("node", "bits", F.posexplode("sets").alias("pos", "set_id")).where("getbit(bits, pos) = 1").select("set_id", "node")


def expand_multi(adj: DataFrame, seeds: DataFrame, max_hops: int, arcs_a_task: int = ARCS_A_TASK, sent: int = SENT) -> DataFrame:
    """(set_id, node) reached within ``max_hops`` of each set's seeds, seeds included.

    Seeds that are null or unknown to the graph are skipped; negative hops count as none. Frontiers and sets
    of up to ``sent`` bytes are sent to all tasks.
    """
    # an id below the largest node is in range even if isolated, as node ids are dense
    top = adj.agg(F.max("src").alias("top"))
    start = seeds.select("set_id", F.col("node").cast("long").alias("node")).where("set_id is not null and node is not null").distinct()
    start = cut(start.crossJoin(F.broadcast(top)).where((F.col("node") >= 0) & (F.col("node") <= F.col("top"))).drop("top"))
    if max_hops <= 0 or start.isEmpty():
        return start
    sets, count = numbered_sets(start)
    send, n = count * SET_BYTES <= sent, min(WORDS, -(-count // 64))
    words = [f"w{i}" for i in range(n)]
    merged = [F.bit_or(w).alias(w) for w in words]
    bit = [F.when(F.col("word") % n == i, F.expr("shiftleft(1L, pos)")).otherwise(0).alias(w) for i, w in enumerate(words)]
    numbered = start.join(F.broadcast(sets) if send else sets, "set_id")
    seen = frontier = cut(numbered.select(F.expr(f"word div {n}").alias("block"), "node", *bit).groupBy("block", "node").agg(*merged))
    salted = None
    for left in reversed(range(max_hops)):
        if frontier.count() * (ROW_BYTES + 8 * n) <= sent:
            step = adj.join(F.broadcast(frontier.withColumnRenamed("node", "src")), "src")
        else:
            salted = salted or salted_arcs(adj.select("src", "dst").distinct(), arcs_a_task)
            step = along(frontier, "node", *salted)
        reached = cut(seen.unionByName(step.select("block", F.col("dst").alias("node"), *words)).groupBy("block", "node").agg(*merged))
        if left:
            before = reached.join(seen.select("block", "node", *(F.col(w).alias(f"old_{w}") for w in words)), ["block", "node"], "left")
            # a condition on the new words instead would double the optimizer's constraints with every word
            grown = before.where(" or ".join(f"{w} != coalesce(old_{w}, 0)" for w in words))
            frontier = cut(grown.select("block", "node", *(F.expr(f"{w} & ~coalesce(old_{w}, 0)").alias(w) for w in words)))
        seen = reached
        if left and frontier.isEmpty():
            break
    return members(seen, sets, words, send)


def expand(adj: DataFrame, seeds: list[int], max_hops: int) -> DataFrame:
    """Nodes within ``max_hops`` of the seeds."""
    spark = adj.sparkSession
    start = spark.createDataFrame([(0, s) for s in seeds], "set_id int, node long")
    return expand_multi(adj, start, max_hops).select("node")


def expand_sets(adj: DataFrame, set_ids: list[int], seeds: list[int], max_hops: int) -> DataFrame:
    """expand_multi from parallel arrays, which must be equally long."""
    if len(set_ids) != len(seeds):
        raise InvalidParameter("set ids and seeds must be equally long")
    return expand_multi(adj, adj.sparkSession.createDataFrame(list(zip(set_ids, seeds)), "set_id int, node long"), max_hops)


def ppr(adj: DataFrame, seeds: list[int] | None, damping: float = 0.5, iterations: int = 20, cut_every: int = 5, arcs_a_task: int = ARCS_A_TASK) -> DataFrame:
    """Personalised PageRank as (node, score): restart uniform over the seed entries (a repeated one counts
    again), over all nodes without a valid seed; parallel edges count, mass at isolated seeds leaks.
    Scores up to 1e-12 are dropped; damping is clamped to [0, 0.999].
    """
    d = min(max(damping, 0.0), 0.999)
    spark = adj.sparkSession
    arcs, hubs = salted_arcs(adj.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), arcs_a_task)
    degree = arcs.groupBy("src").agg(F.sum("m").alias("deg")).withColumnRenamed("src", "node")
    salted = arcs.withColumn("s", F.col("salt"))  # a hub's arcs keep their salts
    arcs = cut(along(degree, "node", salted, hubs).select(F.col("node").alias("src"), "dst", F.col("s").alias("salt"), (F.col("m") / F.col("deg")).alias("p")))
    top = adj.agg(F.max("src")).first()[0]
    valid = [s for s in seeds or [] if s is not None and top is not None and 0 <= s <= top]
    if valid:
        n = len(valid)
        restart = spark.createDataFrame([(s,) for s in valid], "node long").groupBy("node").agg((F.count(F.lit(1)) / n).alias("r"))
    else:
        n = (top or 0) + 1
        restart = spark.range(n).select(F.col("id").alias("node"), F.lit(1.0 / n).alias("r")) if top is not None else spark.createDataFrame([], "node long, r double")
    restart = cut(restart)
    pi = restart.select("node", F.col("r").alias("score"))
    for i in range(max(1, iterations)):
        spread = along(pi, "node", arcs, hubs).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("score") * F.col("p")) * d).alias("s"))
        pi = spread.join(restart, "node", "full").select("node", (F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)) * (1 - d)).alias("score"))
        if i % cut_every == cut_every - 1:
            pi = cut(pi)
    return pi.where("score > 1e-12")


def hop_range(pattern: str, default_max: int = 3) -> tuple[int, int]:
    """Hops of a path pattern: none is 1..1, * is 1..default, *N is N..N, *a..b is a..b."""
    m = re.fullmatch(r"\s*<?-\[\s*\w*\s*(\*\s*(\d+)?\s*(\.\.\s*(\d+)?)?)?\s*\]->?\s*", pattern)
    if not m:
        raise InvalidParameter(f"not a path pattern: {pattern!r}")
    if m[1] is None:
        return 1, 1
    low = int(m[2]) if m[2] else 1
    high = (int(m[4]) if m[4] else default_max) if m[3] else (low if m[2] else default_max)
    if high < low:
        raise InvalidParameter("the upper bound is below the lower one")
    return low, high


def pgq_match(adj: DataFrame, sources: list[int], pattern: str = "-[e*1..2]-", default_max: int = 3) -> DataFrame:
    """Nodes whose distance from the sources lies in the pattern's range: within(high) without within(low - 1)."""
    low, high = hop_range(pattern, default_max)
    reached = expand(adj, sources, high)
    return reached if low <= 0 else reached.join(expand(adj, sources, low - 1), "node", "left_anti")


def graph_rag_search(nodes: DataFrame, edges: DataFrame, query: list[float], workspace: str, collection: str, k_entry: int = 5, max_hops: int = 2) -> DataFrame:
    """(chunk_id, score): the chunks of edges around the entry nodes nearest to the query, by summed weight.

    Traversal uses all edges; the workspace and collection narrow the entry nodes and the scored edges.
    """
    from tidemill.operators.knn import knn

    own = (F.col("workspace_id") == workspace) & (F.col("collection_id") == collection)
    entry = [r.id for r in knn(nodes, "id", "embedding", query, k_entry, "cosine", own).collect()]
    reached = expand(adjacency(edges, "src_id", "dst_id"), entry, max_hops)
    touched = edges.where(own).join(reached.withColumnRenamed("node", "src_id"), "src_id", "left_semi").unionByName(
        edges.where(own).join(reached.withColumnRenamed("node", "src_id"), "src_id", "left_anti").join(reached.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi").select(edges.columns)
    )
    return touched.select(F.explode("source_chunk_ids").alias("chunk_id"), "weight").groupBy("chunk_id").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), F.asc("chunk_id"))


def drop_graph(spark: SparkSession, folder: str) -> bool:
    """Remove a built graph with all its versions; False where there is none."""
    path, fs = file_system(spark, folder)
    return bool(fs.delete(path, True))
