"""The k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors go through fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard
transform); a hash is the nearest signed axis. Several tables are kept and every vector enters the
``visits`` buckets whose axes it comes closest to over all tables (multiprobe on both sides, so two
vectors meet when any of their probes agree). Candidates met in a bucket are scored there in half precision;
all that the error of these scores allows among the best are reranked with the exact cosine of the stored
embeddings. Where these are many (groups of near-copies), the bucket is searched in double precision.

Scale: a bucket larger than ``bucket_limit`` is split into blocks that are compared pairwise in separate
tasks, which loses nothing; tasks stay bounded, but the work of a bucket grows with the square of its rows
and its data with the number of its blocks. Vectors of one direction are one to the index: of such a group
only the k+1 smallest ids are searched. The others have at least k neighbours of cosine 1, so theirs are the
smallest ids among the group and what the search found at cosine 1 of its first row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

TABLES = 3
#: Buckets a vector enters, whatever the number of rows; README has the recall.
VISITS = 16
#: The same where only neighbours of at least the cosine CLOSE are wanted, which meet sooner.
CLOSE, CLOSE_VISITS = 0.9, 9
BUCKET_LIMIT = 40_000
#: Bytes of packed vectors a task hands over at once.
PACK_BYTES = 64 << 20
#: Directions closer than this are the same: the cosine of any two is 1 to nine decimals (the error of single precision is below it).
SAME_DIRECTION = 8e-6
#: Rows held against a whole bucket at once.
WIDE_ROWS = 256
#: Copy groups above the k+1 limit that may be broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000
TILE = 1024
#: Scores in a bucket are made from half-precision vectors (each off by 2^-11 of its length at most) and are off by less than this.
SLACK = 1e-3


def kept(k: int) -> int:
    """Candidates of a vector within the error of its k-th score that a bucket passes on; vectors with more are searched in double precision there."""
    return 3 * k + 1


def hadamard(d: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return h / np.float32(np.sqrt(d))


def rotation(d: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of dimension ``d`` padded to a power of two: H D3 H D2 H D1."""
    size = 1 << max(0, int(d - 1).bit_length())
    rng, h, r = np.random.default_rng(seed), hadamard(size), np.eye(size, dtype=np.float32)
    for _ in range(3):
        r = (r * rng.choice(np.array([-1, 1], np.float32), size)) @ h
    return r[:d]


def axes(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Closeness of each row to each signed axis of each table."""
    return np.concatenate([part for r in rotations for p in (x @ r,) for part in (p, -p)], axis=1)


def usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows of the embeddings with ``dims`` finite components that are not all zero."""
    emb = batch.column(1)
    ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(emb), dims), False)) & np.asarray(batch.column(0).is_valid())
    part = batch.filter(pa.array(ok))
    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids[good], x[good]


def prepare(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, dims)
            x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            codes = np.round(x * (np.sqrt(dims) / SAME_DIRECTION)).astype(np.int32)
            key = np.array([hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in codes], dtype="S16") if len(ids) else np.empty(0, "S16")
            words = np.frombuffer(key.tobytes(), np.int64).reshape(-1, 2)
            flat = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array([v.tobytes() for v in flat], pa.binary())], names=["id", "k1", "k2", "vec"]
            )

    return run


class Router:
    """Assigns rows to the buckets of their closest axes over all tables; ``blocks`` has the number of blocks of each large bucket."""

    def __init__(self, dims: int, tables: int, visits: int, seed: int, blocks: dict[int, int]):
        self.dims, self.visits, self.blocks = dims, visits, blocks
        self.base = [rotation(dims, seed + t) for t in range(tables)]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and bucket keys."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        close = axes(x, self.base)
        n, c = len(x), min(self.visits, close.shape[1])
        top = np.argpartition(-close, c - 1, axis=1)[:, :c] if c < close.shape[1] else np.tile(np.arange(c), (n, 1))
        return np.repeat(np.arange(n), c), top.ravel().astype(np.int64)


def vectors_of(batch: pa.RecordBatch, name: str, dims: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, dims)


def counts(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, keys = router(vectors_of(batch, "vec", router.dims))
            k, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


def packed(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", "block", "side", "ids", "vecs"])


def pack(router: Router):
    """One row per batch and bucket, with the ids and half-precision vectors that enter it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch, "vec", router.dims)
            ids = batch.column("id").to_numpy()
            half = x.astype(np.float16)
            rows, keys = router(x)
            order = np.argsort(keys, kind="stable")
            rows, keys = rows[order], keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            out: list[tuple[int, int, int, bytes, bytes]] = []
            held = 0
            for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
                k, m = int(keys[a]), router.blocks.get(int(keys[a]), 1)
                where = ids[rows[a:b]] % m  # the block of a row; its pairs of blocks are separate groups
                for i in range(m):
                    for j in range(i, m):
                        for side, pick in ((0, where == i), (1, where == j)) if i != j else ((0, where == i),):
                            if pick.any():
                                r = rows[a:b][pick]
                                out.append((k, i * m + j, side, ids[r].tobytes(), half[r].tobytes()))
                                held += len(r) * (8 + 2 * router.dims)
                            if held > PACK_BYTES:
                                yield packed(out)
                                out, held = [], 0
            yield packed(out)

    return run


def best_of(i: np.ndarray, j: np.ndarray, s: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the candidates that may be among its ``k`` best items whatever the error of the scores, and the i with more than ``kept`` of them, whose candidates are left out."""
    if not len(i):
        return i, j, s, i
    if item[-1] + 1 < len(item):  # some items have several vectors
        order = np.lexsort((-s, item[j], i))
        i, j, s = i[order], j[order], s[order]
        once = np.r_[True, (i[1:] != i[:-1]) | (item[j[1:]] != item[j[:-1]])]
        i, j, s = i[once], j[once], s[once]
    order = np.argsort((i.astype(np.int64) << 32) + ((2 - s.astype(np.float64)) * 2**29).astype(np.int64))  # by i, best scores first
    i, j, s = i[order], j[order], s[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[start, len(i)])
    kth = np.where(size >= k, s[np.minimum(start + k, start + size) - 1], -np.inf)
    keep = s >= np.repeat(kth - 2 * SLACK, size)
    over = np.add.reduceat(keep.astype(np.int64), start) > kept(k)
    keep &= ~np.repeat(over, size)
    return i[keep], j[keep], s[keep], i[start][over]


NEAR = "a long, b array<long>, s array<float>"
FOUND = f"{NEAR}, mark struct<key: long, block: int, side: int, dense: boolean>"


def listed(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Rows of equal neighbouring i as one, with lists of their j and s."""
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    at = pa.array(np.r_[start, len(i)].astype(np.int32))
    return pa.array(i[start], pa.int64()), pa.ListArray.from_arrays(at, pa.array(j, pa.int64())), pa.ListArray.from_arrays(at, pa.array(s.astype(np.float32)))


def floors(x: np.ndarray, side: np.ndarray | None, item: np.ndarray, k: int) -> np.ndarray:
    """What a score must reach to be among the ``k`` best of each row, by the items of its own tile; a bound, since more items only raise it."""
    low = np.full(len(x), -2, np.float32)
    for a in range(0, len(x), TILE):
        xa, ia = x[a : a + TILE], item[a : a + TILE]
        s = xa @ xa.T
        s[ia[:, None] == ia[None, :]] = -2
        s[:, 1:][:, ia[1:] == ia[:-1]] = -2  # one vector of an item
        if side is not None:
            sa = side[a : a + TILE]
            s[sa[:, None] == sa[None, :]] = -2
        if len(xa) >= k:
            low[a : a + TILE] = np.partition(s, len(xa) - k, axis=1)[:, len(xa) - k] - 2 * SLACK
    return low


def search(dims: int, threshold: float | None, k: int):
    """Score all pairs of a bucket tile by tile; emit the k best of every row there, or of the pairs over the threshold if there is one.

    All candidates within the error of the k-th score are emitted. Rows with more than ``kept`` of them are
    marked as dense, and with their candidates (rows without b) left to ``dense_search``.
    """

    def run(group: pa.Table) -> pa.Table:
        sizes = [len(b) // 8 for b in group["ids"].to_pylist()]
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = np.frombuffer(b"".join(group["vecs"].to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)[order]
        side = np.repeat(group["side"].to_numpy(), sizes)[order]
        two = bool((side == 1).any())
        new = np.r_[True, ids[1:] != ids[:-1]]
        at, item = np.flatnonzero(new), np.cumsum(new) - 1
        whole = np.zeros(len(ids), bool)  # rows held against the whole bucket below
        low = floors(x, side if two else None, item, k) if threshold is None else np.full(len(ids), threshold, np.float32)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j, v, over = best_of(*map(np.concatenate, zip(*met)), item, k)
            whole[over] = True
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            full = start[np.diff(np.r_[start, len(i)]) >= k]  # a row's candidates are in order of their scores
            low[i[full]] = np.maximum(low[i[full]], v[full + k - 1] - 2 * SLACK)
            return i, j, v

        starts = range(0, len(ids), TILE)
        for a in starts:
            xa = x[a : a + TILE]
            for b in starts:
                if b < a or whole[a : a + TILE].all() and whole[b : b + TILE].all():
                    continue
                s = xa @ x[b : b + TILE].T
                hit = np.flatnonzero(s >= (np.minimum.outer(low[a : a + TILE], low[b : b + TILE]) if threshold is None else threshold))
                i, j = hit // s.shape[1] + a, hit % s.shape[1] + b
                v = s.ravel()[hit]
                ok = (ids[i] != ids[j]) & ((side[i] != side[j]) if two else (i < j))
                i, j, v = i[ok], j[ok], v[ok]
                i, j, v = np.r_[i, j], np.r_[j, i], np.r_[v, v]
                ok = ~whole[i] & (v >= low[i])
                if ok.any():
                    met.append((i[ok], j[ok], v[ok]))
                    held += len(met[-1][0])
                if held > 2_000_000:
                    met = [reduced()]
                    held = len(met[0][0])
        i, j, v = reduced() if met else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        open_ = ~whole[i]
        out = [(ids[i][open_], ids[j][open_], v[open_])]
        dense, needed = np.zeros(len(at), bool), np.zeros(len(at), bool)
        mine = np.flatnonzero(whole)
        for a in range(0, len(mine), WIDE_ROWS):
            r = mine[a : a + WIDE_ROWS]
            s = best_by_item(x[r] @ x.T, r, side if two else None, at, item)
            c = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - c, axis=1)[:, s.shape[1] - c]
            good = (s >= kth[:, None] - 2 * SLACK) & (s > (-1.5 if threshold is None else threshold))
            over = good.sum(axis=1) > kept(k)
            dense[item[r[over]]] = True
            needed |= good[over].any(axis=0)
            i, j = np.nonzero(good & ~over[:, None])
            out.append((ids[r[i]], ids[at[j]], s[i, j]))
        i, j, v = map(np.concatenate, zip(*out))
        m = np.flatnonzero(dense | needed)
        rows, near, scores = listed(i, j, v)
        z = len(m)
        key, block = group["key"][0].as_py(), group["block"][0].as_py()
        mark = pa.StructArray.from_arrays([pa.array([key] * z, pa.int64()), pa.array([block] * z, pa.int32()), pa.array(side[at[m]], pa.int32()), pa.array(dense[m])], names=["key", "block", "side", "dense"])
        return pa.table({
            "a": pa.concat_arrays([rows, pa.array(ids[at[m]], pa.int64())]),
            "b": pa.concat_arrays([near, pa.nulls(z, near.type)]),
            "s": pa.concat_arrays([scores, pa.nulls(z, scores.type)]),
            "mark": pa.concat_arrays([pa.nulls(len(rows), mark.type), mark]),
        })

    return run


def best_by_item(s: np.ndarray, r: np.ndarray, side: np.ndarray | None, at: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Scores of the rows ``r`` by item (the closest of its vectors), -2 where the two are not compared."""
    if side is not None:
        s[side[r][:, None] == side[None, :]] = -2
    if len(at) < s.shape[1]:
        s = np.maximum.reduceat(s, at, axis=1)
    s[np.arange(len(r)), item[r]] = -2
    return s


def dense_search(dims: int, k: int):
    """The exact k best, in double precision, of the dense rows of a bucket among the rows marked there."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("a")
        ids, side, dense = group["a"].to_numpy(), group["side"].to_numpy(), group["dense"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        new = np.r_[True, ids[1:] != ids[:-1]]
        at, item = np.flatnonzero(new), np.cumsum(new) - 1
        two = side if (side == 1).any() else None
        mine = np.flatnonzero(dense)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for p in range(0, len(mine), WIDE_ROWS):
            r = mine[p : p + WIDE_ROWS]
            s = best_by_item(np.round(np.clip(x[r] @ x.T, -1, 1), 9), r, two, at, item)
            c = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - c, axis=1)[:, s.shape[1] - c]
            for n, own in enumerate(r):
                j = np.flatnonzero((s[n] >= kth[n]) & (s[n] > -1.5))
                j = j[np.argsort(-s[n, j], kind="stable")[:k]]
                out.append((np.full(len(j), ids[own]), ids[at[j]], s[n, j]))
        return pa.table(dict(zip("abs", listed(*map(np.concatenate, zip(*out))))))

    return run


def exact(dims: int):
    """Cosine in double precision of the two stored embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) for c in ("va", "vb"))
            x, y = (v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300) for v in (x, y))
            cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(np.clip(cos, -1, 1), 9))], names=["a", "b", "cosine"])

    return run


def build_plan(searched: DataFrame, dims: int, tables: int, visits: int, limit: int, seed: int) -> Router:
    """Count bucket sizes and split what is too large into blocks; the driver holds one number a bucket."""
    router = Router(dims, tables, visits, seed, {})
    sizes = searched.select("id", "vec").mapInArrow(counts(router), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Router(dims, tables, visits, seed, {int(r.key): -(-int(r.n) // limit) for r in sizes if r.n > limit})


def similar_vectors(
    df: DataFrame, id_col: str, embedding_col: str, dims: int, k: int = 5, min_similarity: float | None = None, tables: int = TABLES, visits: int | None = None, bucket_limit: int = BUCKET_LIMIT, seed: int = 42
) -> DataFrame:
    """The ``k`` most similar rows by cosine of every row, as (id, neighbour_id, cosine, rank).

    Rows whose id is null or whose embedding is null, of another dimension, not finite or all zero take no
    part. Equal similarities (to nine decimals) are ranked by the smaller neighbour id. A repeated id is
    one item, compared by the closest of its vectors. With ``min_similarity`` only neighbours of at least
    that cosine are returned; from CLOSE on, fewer buckets are searched. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).cast("array<float>").alias("embedding"))
    units = rows.mapInArrow(prepare(dims), "id long, k1 long, k2 long, vec binary")
    group = ["k1", "k2"]
    large = units.select(*group, "id").groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    large = cut(large)
    n_large = large.count()
    heads = None
    searched = units
    if n_large:
        small = n_large <= BROADCAST_GROUPS
        hint = F.broadcast if small else (lambda d: d)
        members = units.select(*group, "id").join(hint(large.select(*group)), group, "left_semi").distinct()
        w = Window.partitionBy(*group).orderBy("id")
        heads = cut(members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy(*group).agg(F.array_sort(F.collect_set("id")).alias("heads")))
        marked = units.join(hint(heads), group, "left")
        searched = marked.where(F.col("heads").isNull() | F.array_contains("heads", F.col("id"))).select("id", *group, "vec")
        tails = units.select("id", *group).join(hint(heads.select(*group, "heads")), group).where(~F.array_contains("heads", F.col("id"))).select("id", *group)
    if visits is None:
        visits = CLOSE_VISITS if min_similarity is not None and min_similarity >= CLOSE else VISITS
    router = build_plan(searched, dims, tables, visits, bucket_limit, seed)
    threshold = None if min_similarity is None else min_similarity - SLACK
    found = cut(
        searched.select("id", "vec")
        .mapInArrow(pack(router), "key long, block int, side int, ids binary, vecs binary")
        .groupBy("key", "block")
        .applyInArrow(search(dims, threshold, k), FOUND)
    )
    valid = rows.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    marked_rows, found = found.where("mark is not null").select("a", "mark.*"), found.where("mark is null").select("a", "b", "s")
    if not marked_rows.isEmpty():
        held = marked_rows.join(valid.select(F.col("id").alias("a"), F.col("embedding").alias("v")), "a").select("key", "block", "side", "dense", "a", "v")
        found = found.unionByName(held.groupBy("key", "block").applyInArrow(dense_search(dims, k), NEAR))
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    each = found.repartition("a").select("a", F.inline(F.arrays_zip("b", "s")))
    near = each.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w))
    # only scores within the error of the k-th one can change places in the rerank
    kth = F.max(F.when(F.col("r") == k, F.col("s"))).over(Window.partitionBy("a"))
    near = near.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("s") >= F.col("kth") - 2 * SLACK))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scored = (
        pairs.join(valid.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a")
        .join(valid.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
        .select("a", "b", "va", "vb")
        .mapInArrow(exact(dims), "a long, b long, cosine double")
    )
    if min_similarity is not None:
        scored = scored.where(F.col("cosine") >= min_similarity)
    both = scored.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour_id"), "cosine"), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour_id"), "cosine"))).alias("p")).select("p.*")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    best = both.repartition("id").groupBy("id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if heads is None:
        return ranked
    ranked = cut(ranked)  # read for the first rows of the groups and for the result
    first = heads.select(*group, F.col("heads")[0].alias("id"), "heads")
    same = first.join(ranked.where("cosine = 1"), "id", "left").groupBy(*group).agg(F.first("heads").alias("heads"), F.collect_set("neighbour_id").alias("met"))
    lists = same.select(*group, F.slice(F.array_sort(F.array_union("heads", "met")), 1, k).alias("near"))
    others = tails.join(hint(lists), group).select("id", F.posexplode("near").alias("at", "neighbour_id")).groupBy("id", "neighbour_id").agg(F.min("at").alias("at"))
    others = others.select("id", "neighbour_id", F.lit(1.0).alias("cosine"), (F.col("at") + 1).alias("rank"))
    return ranked.join(tails.select("id"), "id", "left_anti").unionByName(others)


def mutual_pairs(neighbours: DataFrame) -> DataFrame:
    """Neighbour links as distinct unordered pairs (id_a, id_b)."""
    return neighbours.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()
