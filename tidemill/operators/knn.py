"""Nearest-neighbour search: exact, batched, filtered, joins, inverted lists and quantised codes.

Exact search is a distance expression under ``TakeOrderedAndProject``: each task keeps k rows. Batches of
queries are held against all rows in blocks; every Arrow batch keeps k rows a query before anything is
shuffled. Codebooks are fitted on a bounded sample, assignment and search cover every row.

An index is stored: files partitioned by inverted list, with the vector and, if quantised, its code in
columns of their own. A search reads the probed lists only; a quantised one reads codes only, and then the
vectors of the best codes from the lists these lie in.
"""

from __future__ import annotations

import pickle
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter, overlaps
from tidemill.functions.vectors import distance, lit_vector, metric_name, valid_vector
from tidemill.operators.change_feed import publish, read_current
from tidemill.session import cut, scratch_path

#: Rows a codebook is fitted on at most (smallest hashes of the id).
FIT_ROWS = 50_000
#: Query vectors sent to tasks at once.
QUERY_BLOCK = 2_048


def knn(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest rows as (id, distance); ties by id, NaN last, null ids and vectors skipped. The filter applies before the ranking."""
    if k <= 0:
        raise InvalidParameter("k must be positive")
    rows = df if where is None else df.where(where)
    rows = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), distance(vec_col, lit_vector(query), metric).alias("distance")).orderBy(F.asc("distance"), F.asc("id")).limit(k)


def knn_labels(df: DataFrame, id_col: str, vec_col: str, labels_col: str, query: list[float], labels: list[int], k: int, metric: str = "l2") -> DataFrame:
    """k nearest rows among those whose labels overlap ``labels``."""
    return knn(df, id_col, vec_col, query, k, metric, overlaps(labels_col, F.array(*map(F.lit, labels)).cast(df.schema[labels_col].dataType)))


def distances_np(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of queries to rows in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    dot = q @ x.T
    if metric == "ip":
        return -dot
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    if metric == "l2":
        return np.sqrt(np.maximum(qq + xx - 2 * dot, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip(dot / np.sqrt(qq * xx), -1, 1)


def batch_scan(q: np.ndarray, k: int, metric: str, dims: int, allowed=None):
    """Per Arrow batch, the k nearest rows of every query; ``allowed(part) -> bool matrix`` narrows by inverted list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims) if len(ids) else np.empty((0, dims))
            d = distances_np(q, x, metric)
            live = np.ones(d.shape, bool) if allowed is None else allowed(batch.column(2).to_numpy())
            key = np.where(np.isnan(d), np.inf, d)
            out_q, out_i, out_d = [], [], []
            for r in range(len(q)):
                own = np.flatnonzero(live[r])
                if not len(own):
                    continue
                if len(own) > k:
                    cut = np.partition(key[r, own], k - 1)[k - 1]
                    own = own[key[r, own] <= cut]
                own = own[np.lexsort((ids[own], key[r, own]))][:k]
                out_q += [r] * len(own)
                out_i += ids[own].tolist()
                out_d += d[r, own].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out_i, pa.int64()), pa.array(out_d, pa.float64())], names=["query_idx", "id", "distance"])

    return run


def vector_rows(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v) without null ids and vectors; a row of another dimension is an error."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return rows.select("id", F.when(F.size("v") == dims, F.col("v")).otherwise(F.raise_error(F.lit("different vector dimensions")).cast("array<float>")).alias("v"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn_batch(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, metric: str = "l2") -> DataFrame:
    """(query_idx, id, distance) of the k nearest rows of each query, exact; ties by id, NaN last.

    Rows with a null id or vector are skipped; a row of another dimension is an error; no query gives no rows.
    """
    if k <= 0:
        raise InvalidParameter("k must be positive")
    if not queries:
        return df.sparkSession.createDataFrame([], "query_idx int, id long, distance double")
    dims = len(queries[0])
    if any(len(q) != dims for q in queries):
        raise InvalidParameter("queries of different dimensions")
    kind = metric_name(metric)
    rows = vector_rows(df, id_col, vec_col, dims)
    parts = []
    for at in range(0, len(queries), QUERY_BLOCK):
        q = np.array(queries[at : at + QUERY_BLOCK], np.float64).reshape(-1, dims)
        parts.append(rows.mapInArrow(batch_scan(q, k, kind, dims), "query_idx int, id long, distance double").withColumn("query_idx", F.col("query_idx") + at))
    return top_per(union_all(parts), "query_idx", k)


def top_per(df: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.asc("distance"), F.asc("id"))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def similarity_join(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest right rows of every row of a stated left set, as (left_id, id, distance).

    The left set is read in blocks of ``QUERY_BLOCK`` in the order of its ids, and each block is held against
    all right rows; for the neighbours of all rows of a large table use an index. Of repeated left ids one
    row counts. Left vectors that are null take no part.
    """
    if k <= 0:
        raise InvalidParameter("k must be positive")
    kind = metric_name(metric)
    rows = left.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<float>").alias("v")).dropDuplicates(["i"])
    parts, last = [], None
    while True:
        block = (rows if last is None else rows.where(F.col("i") > last)).orderBy("i").limit(QUERY_BLOCK).collect()
        if block:
            ids, q = np.array([r.i for r in block], np.int64), np.array([r.v for r in block], np.float64)
            last = block[-1].i
            scan = batch_scan(q, k, kind, q.shape[1])
            parts.append(vector_rows(right, id_col, vec_col, q.shape[1]).mapInArrow(with_names(scan, ids), "left_id long, id long, distance double"))
        if len(block) < QUERY_BLOCK:
            break
    if not parts:
        return left.sparkSession.createDataFrame([], "left_id long, id long, distance double")
    return top_per(union_all(parts), "left_id", k)


def with_names(scan, ids: np.ndarray):
    """The batches of a scan with the ids of the queries in place of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids[b.column(0).to_numpy()]), b.column(1), b.column(2)], names=["left_id", "id", "distance"])

    return run


def threshold_join(df: DataFrame, id_col: str, vec_col: str, tau: float) -> DataFrame:
    """Pairs (id_a < id_b) with L2 distance below ``tau``; tau <= 0 gives none. Rows of different dimensions never pair.

    Vectors are placed in cells of width tau along the two directions of largest variance of a bounded
    sample; a projection never lengthens a distance, so a pair lies in one cell or in neighbouring ones, and
    an equi-join on cells, tested on a third direction before the distance, finds all pairs.
    """
    rows = df.where(F.col(id_col).isNotNull() & valid_vector(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    sample = fit_rows(df, id_col, vec_col) if tau > 0 else []
    if not len(sample):
        return rows.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("distance")).limit(0)
    axes = np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2][:3]
    dims = sample.shape[1]

    def along(n: int) -> Column:
        if n >= len(axes):
            return F.lit(0.0)
        return F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in axes[n]]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)

    wide = tau * (1 + 1e-6)  # rounding of the projections
    of_size = rows.where(F.size("v") == dims).withColumn("p3", along(2)).withColumn("c1", F.floor(along(0) / wide)).withColumn("c2", F.floor(along(1) / wide))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = of_size.withColumn("d1", F.explode(near)).withColumn("d2", F.explode(near)).select(F.col("id").alias("id_b"), F.col("v").alias("vb"), F.col("p3").alias("q3"), (F.col("c1") + F.col("d1")).alias("c1"), (F.col("c2") + F.col("d2")).alias("c2"))
    pairs = of_size.select(F.col("id").alias("id_a"), F.col("v").alias("va"), "p3", "c1", "c2").join(spread, ["c1", "c2"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("p3") - F.col("q3")) < wide))
    return pairs.select("id_a", "id_b", distance("va", "vb", "l2").alias("distance")).where(F.col("distance") < tau)


# --- codebooks -------------------------------------------------------------------------------------------


def smallest_hashes(df: DataFrame, id_col: str, limit: int, total: int) -> DataFrame:
    """The ``limit`` of about ``total`` rows with the smallest hashes of the id, in that order.

    Rows are first cut to a share of the hashes that holds twice as many, so that no task sorts or receives
    the candidates of all others; should ids be so unevenly spread that it holds fewer, all rows are looked at.
    """
    rows = df.withColumn("__h", F.xxhash64(id_col))
    if total > 2 * limit:
        part = rows.where(F.col("__h") < F.lit(-(1 << 63) + (1 << 64) * 2 * limit // total))
        if part.count() >= limit:
            rows = part
    return rows.orderBy("__h", id_col).limit(limit).drop("__h")


def fit_rows(df: DataFrame, id_col: str, vec_col: str, limit: int = FIT_ROWS) -> np.ndarray:
    """The vectors with the smallest id hashes, at most ``limit``: the documented sample codebooks are fitted on."""
    rows = df.where(F.col(id_col).isNotNull() & valid_vector(vec_col)).select(F.col(vec_col).alias("v"), F.col(id_col).alias("i"))
    return np.array([r.v for r in smallest_hashes(rows, "i", limit, df.count()).collect()], np.float64)


def kmeans(x: np.ndarray, k: int, iterations: int = 10, seed: int = 42) -> np.ndarray:
    """k-means++ seeding and Lloyd iterations; nearest centroid, first index on ties; k is clamped to the rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = d.sum()
        centres.append(x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(iterations):
        near = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        if np.allclose(moved, c):
            break
        c = moved
    return c


def nearest_lists(x: np.ndarray, centres: np.ndarray, metric: str, spill: float) -> tuple[np.ndarray, np.ndarray | None]:
    """The nearest list of each row; with ``spill`` also the second one that is least parallel to the residual."""
    d = distances_np(x, centres, metric)
    first = np.where(np.isnan(d), np.inf, d).argmin(1)
    if not spill or len(centres) < 2:
        return first, None
    r = x - centres[first]
    rr = np.maximum((r * r).sum(1), 1e-30)[:, None]
    apart = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T
    away = apart + spill * ((x * r).sum(1)[:, None] - r @ centres.T) ** 2 / rr
    away[np.arange(len(x)), first] = np.inf
    return first, away.argmin(1)


def assign(centres: np.ndarray, metric: str, spill: float, coder):
    """Adds the code and the lists of each row to (id, v, ...); a spilled row comes twice."""
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dims)
                first, second = nearest_lists(x, centres, metric, spill)
                codes = [c.tobytes() for c in coder.encode(x)] if coder else [None] * len(part)
                for lists in (first, second) if second is not None else (first,):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.binary()), pa.array(lists.astype(np.int32))], names=[*part.schema.names, "code", "list"])

    return run


class VectorIndex:
    """A stored index: rows (id, v, kept columns, code) partitioned by inverted list, and its model.

    The current version is a small table of segment folders and the fitted model; ``append`` adds a segment
    with the same model, so readers see an append as a whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        held = read_current(spark, root).collect()
        self.segments = sorted(r.segment for r in held)
        self.centres, self.metric, self.coder, self.spill, self.keep = pickle.loads(bytes(held[0].model))
        self.dims = self.centres.shape[1]

    @property
    def rows(self) -> DataFrame:
        return union_all([self.spark.read.parquet(s) for s in self.segments])

    def append(self, df: DataFrame, id_col: str, vec_col: str) -> None:
        """Add all rows with an id and a valid vector of the index's dimension."""
        model = (self.centres, self.metric, self.coder, self.spill, self.keep)
        write_segment(df, id_col, vec_col, model, self.root, self.segments)
        self.__init__(self.spark, self.root)

    def ranked_lists(self, q: np.ndarray) -> np.ndarray:
        d = distances_np(q, self.centres, self.metric)
        return np.argsort(np.where(np.isnan(d), np.inf, d), axis=1, kind="stable")

    def probe(self, queries: list[list[float]], k: int, probes: int | None = None, over_fetch: int = 4, where: Column | None = None) -> DataFrame:
        """(query_idx, id, distance) of the k nearest rows in the ``probes`` nearest lists of each query; a spilled row counts once.

        Without a code, and with all lists probed, the answer is exact. With a code the k * over_fetch best
        by code estimate are reranked by exact distance. ``where`` filters on kept columns before the ranking.
        """
        q = np.array(queries, np.float64).reshape(-1, self.dims)
        probes = len(self.centres) if probes is None else max(1, min(probes, len(self.centres)))
        wanted = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(wanted, self.ranked_lists(q)[:, :probes], True, axis=1)
        rows = self.rows if where is None else self.rows.where(where)
        if probes < len(self.centres):
            rows = rows.where(F.col("list").isin([int(i) for i in np.flatnonzero(wanted.any(0))]))
        allowed = lambda lists: wanted[:, lists]
        if self.coder is None:
            found = rows.select("id", "v", "list").mapInArrow(batch_scan(q, 2 * k, self.metric, self.dims, allowed), "query_idx int, id long, distance double")
            return top_per(found.groupBy("query_idx", "id").agg(F.min("distance").alias("distance")), "query_idx", k)
        kept = k * over_fetch
        guessed = rows.select("id", "code", "list").mapInArrow(code_scan(self.coder, q, 2 * kept if self.spill else kept, allowed), "query_idx int, id long, list int, guess double")
        w = Window.partitionBy("query_idx").orderBy("guess", "id")
        once = guessed.groupBy("query_idx", "id").agg(F.min(F.struct("guess", "list")).alias("g")).select("query_idx", "id", "g.guess", "g.list")
        best = cut(once.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= kept).select("query_idx", "id", "list"))
        # at most k * over_fetch rows a query; the lists they lie in are the only ones whose vectors are read
        held = [r.list for r in best.select("list").distinct().collect()]
        vectors = self.rows.where(F.col("list").isin(held)).select("id", "list", "v").join(F.broadcast(best), ["id", "list"])
        exact = vectors.select("query_idx", "id", "v").mapInArrow(rerank(q, self.metric, self.dims), "query_idx int, id long, distance double")
        return top_per(exact, "query_idx", k)


def write_segment(df: DataFrame, id_col: str, vec_col: str, model: tuple, root: str, before: list[str]) -> None:
    centres, metric, coder, spill, keep = model
    dims = centres.shape[1]
    rows = df.where(F.col(id_col).isNotNull() & valid_vector(vec_col, dims)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code binary, list int"
    folder = f"{root}/data/{uuid.uuid4().hex}"
    # by list and id, so that a list of any share of the rows is cut over tasks
    rows.mapInArrow(assign(centres, metric, spill, coder), schema).repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(folder)
    table = [(s, bytearray(pickle.dumps(model))) for s in [*before, folder]]
    publish(df.sparkSession.createDataFrame(table, "segment string, model binary").coalesce(1), root)


def code_scan(coder, q: np.ndarray, kept: int, allowed):
    """Per Arrow batch, the ``kept`` best code estimates of every query among the rows of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            guess = np.where(allowed(lists), coder.estimate(q, codes), np.inf)
            c = min(kept, n)
            top = np.argsort(guess, axis=1, kind="stable")[:, :c]
            g = np.take_along_axis(guess, top, 1).ravel()
            ok = np.isfinite(g)
            at = top.ravel()[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), c)[ok]), pa.array(ids[at]), pa.array(lists[at].astype(np.int32)), pa.array(g[ok])], names=["query_idx", "id", "list", "guess"])

    return run


def rerank(q: np.ndarray, metric: str, dims: int):
    """Exact distance of each row to its query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dims)
            d = np.array([distances_np(q[i : i + 1], v[None], metric)[0, 0] for i, v in zip(own, x)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["query_idx", "id", "distance"])

    return run


def ivf_build(
    df: DataFrame, id_col: str, vec_col: str, lists: int = 100, metric: str = "l2", soar_lambda: float = 0.0, seed: int = 42, folder: str | None = None, quantiser=None, keep: list[str] | None = None
) -> VectorIndex:
    """Store an index under ``folder`` (a scratch path if None): centroids and codebooks from the sample, every valid row in its nearest list.

    ``quantiser`` makes a Quantiser from the sample; ``keep`` names further columns to store for filters.
    """
    kind = metric_name(metric)
    if clash := {"id", "v", "code", "list"} & set(keep or []):
        raise InvalidParameter(f"kept columns clash with the index: {sorted(clash)}")
    sample = fit_rows(df, id_col, vec_col)
    if not len(sample):
        raise InvalidParameter("no vectors to index")
    model = (kmeans(sample, lists, seed=seed), kind, quantiser(sample) if quantiser else None, soar_lambda, keep or [])
    root = folder or scratch_path(df.sparkSession, "vectors")
    write_segment(df, id_col, vec_col, model, root, [])
    return VectorIndex(df.sparkSession, root)


def ivfflat_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, lists: int = 100, probes: int = 1, metric: str = "l2", seed: int = 42) -> DataFrame:
    return ivf_build(df, id_col, vec_col, lists, metric, seed=seed).probe(queries, k, probes)


def vindex_assign(index: VectorIndex, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, list) that the rows would get in an index."""
    rows = df.where(F.col(id_col).isNotNull() & valid_vector(vec_col, index.dims)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(assign(index.centres, index.metric, 0.0, None), "id long, v array<float>, code binary, list int").select("id", "list")


def hnsw_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, m: int = 16, ef_construction: int = 64, ef_search: int = 40, metric: str = "l2") -> DataFrame:
    """The signature of graph-based search with its parameter checks; the answer is exact, since a graph built by insertion does not distribute."""
    if not 2 <= m <= 100 or not k <= max(ef_search, k) <= 1000 or not k <= max(ef_construction, k) <= 1000:
        raise InvalidParameter("m is 2 to 100, ef_construction and ef_search k to 1000")
    return knn_batch(df, id_col, vec_col, queries, k, metric)


# --- quantised codes ---------------------------------------------------------------------------------------


class Quantiser:
    """Encodes float64 rows to byte rows and estimates distances of queries to codes."""

    def encode(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class BinaryQuantiser(Quantiser):
    """One bit a dimension above the mean, or unary z-score buckets; the estimate is the Hamming distance."""

    def __init__(self, sample: np.ndarray, bits: int = 1):
        self.mean, self.std, self.bits = sample.mean(0), np.maximum(sample.std(0), 1e-12), bits

    def bit_rows(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        if self.bits == 1:
            return z > 0
        cuts = np.linspace(-1.5, 1.5, self.bits)
        return (z[:, :, None] > cuts).reshape(len(x), -1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(self.bit_rows(x), axis=1)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.encode(q)[:, None, :] ^ codes[None, :, :]).sum(2, dtype=np.int64).astype(np.float64)


class ScalarQuantiser(Quantiser):
    """One byte a dimension between its minimum and maximum; decoded at the centre of the bin, a constant dimension to itself."""

    def __init__(self, sample: np.ndarray):
        self.low, self.span = sample.min(0), sample.max(0) - sample.min(0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        unit = np.divide(x - self.low, self.span, out=np.zeros_like(x), where=self.span > 0)
        return np.floor(255 * np.clip(unit, 0, 1)).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + np.where(self.span > 0, (codes + 0.5) / 255.0 * self.span, 0)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return distances_np(q, self.decode(codes), "l2")


class ProductQuantiser(Quantiser):
    """m subspaces with a codebook each; the estimate sums table look-ups. ``eta`` > 1 weighs errors along the vector more (anisotropic)."""

    def __init__(self, sample: np.ndarray, m: int = 8, centroids: int = 256, eta: float = 1.0, iterations: int = 25):
        if sample.shape[1] % m:
            raise InvalidParameter("the dimension must be a multiple of m")
        if eta < 1:
            raise InvalidParameter("eta must be at least 1")
        self.m, self.eta = m, eta
        self.books = [kmeans(part, centroids, iterations) for part in np.split(sample, m, axis=1)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = []
        for part, book in zip(np.split(x, self.m, axis=1), self.books):
            r = part[:, None, :] - book[None]
            cost = (r * r).sum(2)
            if self.eta > 1:
                norm = np.maximum((part * part).sum(1), 1e-30)[:, None]
                cost = cost + (self.eta - 1) * (r * part[:, None, :]).sum(2) ** 2 / norm
            codes.append(cost.argmin(1))
        return np.stack(codes, 1).astype(np.uint8)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(codes)))
        for j, (part, book) in enumerate(zip(np.split(q, self.m, axis=1), self.books)):
            out += np.sqrt(((part[:, None, :] - book[None]) ** 2).sum(2))[:, codes[:, j]]
        return out


class RotationQuantiser(Quantiser):
    """Random rotation and B-bit codes of the centred unit residual with an unbiased inner-product estimate."""

    def __init__(self, sample: np.ndarray, bits: int = 4, seed: int = 42):
        if not 1 <= bits <= 7:
            raise InvalidParameter("bits is 1 to 7")
        self.centre, self.bits = sample.mean(0), bits
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(sample.shape[1],) * 2))[0]

    def encode(self, x: np.ndarray) -> np.ndarray:
        r = (x - self.centre) @ self.rotation
        norm = np.maximum(np.sqrt((r * r).sum(1)), 1e-30)[:, None]
        top = np.maximum(np.abs(r / norm).max(1), 1e-30)[:, None]
        levels = (1 << self.bits) - 1
        grid = np.clip(np.rint((r / norm / top + 1) / 2 * levels), 0, levels)
        back = (grid / levels * 2 - 1) * top
        correction = 1 / np.maximum((back * r / norm).sum(1), 1e-30)
        tail = np.stack([norm[:, 0], top[:, 0], correction], 1).astype("<f4").view(np.uint8).reshape(len(x), 12)
        return np.concatenate([grid.astype(np.uint8), tail], axis=1)

    def estimate(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        d = self.rotation.shape[0]
        norm, top, correction = np.ascontiguousarray(codes[:, d:]).view("<f4").astype(np.float64).reshape(-1, 3).T
        unit = (codes[:, :d] / ((1 << self.bits) - 1) * 2 - 1) * top[:, None] * correction[:, None]
        rq = (q - self.centre) @ self.rotation
        return np.sqrt(np.maximum((rq * rq).sum(1)[:, None] + norm[None] ** 2 - 2 * (rq @ unit.T) * norm[None], 0))


def quantised_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], quantiser, k: int = 10, over_fetch: int = 4, metric: str = "l2", lists: int = 16) -> DataFrame:
    """(query_idx, id, distance): the k * over_fetch best by stored code over all rows, reranked by exact distance.

    ``quantiser`` makes a Quantiser from the fitting sample. With k * over_fetch at least the number of
    rows the answer is exact.
    """
    return ivf_build(df, id_col, vec_col, lists, metric, quantiser=quantiser).probe(queries, k, over_fetch=over_fetch)


def sbq_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, bits: int = 1, over_fetch: int = 4, metric: str = "l2") -> DataFrame:
    return quantised_knn(df, id_col, vec_col, queries, lambda s: BinaryQuantiser(s, bits), k, over_fetch, metric)


def pq_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, m: int = 8, over_fetch: int = 4, metric: str = "l2", eta: float = 1.0, centroids: int = 256) -> DataFrame:
    return quantised_knn(df, id_col, vec_col, queries, lambda s: ProductQuantiser(s, m, centroids, eta), k, over_fetch, metric)


def sq8_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, over_fetch: int = 4, metric: str = "l2") -> DataFrame:
    return quantised_knn(df, id_col, vec_col, queries, ScalarQuantiser, k, over_fetch, metric)


def rabitq_knn(df: DataFrame, id_col: str, vec_col: str, queries: list[list[float]], k: int = 10, bits: int = 4, over_fetch: int = 4, metric: str = "l2") -> DataFrame:
    return quantised_knn(df, id_col, vec_col, queries, lambda s: RotationQuantiser(s, bits), k, over_fetch, metric)


def recommend_probes(index: VectorIndex, exact: DataFrame, queries: list[list[float]], k: int = 10, target: float = 0.95) -> int:
    """The least number of probed lists whose recall against ``exact`` meets the target: doubled first, then bisected."""

    def met(p: int) -> bool:
        return recall_at(index.probe(queries, k, p), exact) >= target

    high, most = 1, len(index.centres)
    while high < most and not met(high):
        high *= 2
    low, high = high // 2 + 1, min(high, most)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if met(mid) else (mid + 1, high)
    return high


def recall_at(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_idx, id) that were found; both hold k rows a query at most."""
    truth = exact.select("query_idx", "id")
    total = truth.count()
    return truth.join(found.select("query_idx", "id"), ["query_idx", "id"], "left_semi").count() / total if total else 1.0


def explain_scan(index: VectorIndex, queries: list[list[float]], probes: int) -> DataFrame:
    """(query_idx, lists, rows): the lists a search would read for each query, nearest first, and their rows."""
    near = index.ranked_lists(np.array(queries, np.float64).reshape(-1, index.dims))[:, : max(1, probes)]
    spark = index.spark
    wanted = spark.createDataFrame([(i, n, int(p)) for i, row in enumerate(near) for n, p in enumerate(row)], "query_idx int, n int, list int")
    sizes = index.rows.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    return wanted.join(sizes, "list", "left").groupBy("query_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "list"))), lambda x: x["list"]).alias("lists"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def scan_stats(index: VectorIndex, queries: list[list[float]], probes: int) -> DataFrame:
    """(query_idx, lists_probed, rows_scanned) of each query."""
    return explain_scan(index, queries, probes).select("query_idx", F.size("lists").cast("long").alias("lists_probed"), F.col("rows").alias("rows_scanned"))


def timed_scan(index: VectorIndex, queries: list[list[float]], k: int, probes: int) -> tuple[list, float]:
    """The rows of a search and the seconds it took."""
    began = time.monotonic()
    return index.probe(queries, k, probes).collect(), time.monotonic() - began


def decoded_bytes(index: VectorIndex, probes_lists: list[int]) -> DataFrame:
    """(list, vectors, vector_bytes, code_bytes): what reading these lists decodes, with and without vectors."""
    rows = index.rows.where(F.col("list").isin(list(probes_lists)))
    return rows.groupBy("list").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.size("v") * 4).alias("vector_bytes"), F.coalesce(F.sum(F.octet_length("code")), F.lit(0)).alias("code_bytes"))
