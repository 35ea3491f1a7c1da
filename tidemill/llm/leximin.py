"""One ranking from several differently-scaled scores, by leximin order.

For every query the scores of each kind become percentiles of the whole collection (a document without the
score stands below all that have it and has percentile 0). A document's percentiles are sorted ascending
and compared lexicographically, the larger first: a weak score cannot be masked by a strong one, and the
range of a score has no influence.

A document with both scores comes before all with one, so most queries are settled among the documents that
match their words. Up to ``QUERY_BLOCK`` queries are taken at once:

1. Words: a document finds the queries whose rarest word it has, and cosines are taken for these pairs only.
   Of them a task keeps for each query what fewer than ``top`` others beat in both scores, since no other
   can be among the first ``top`` (the skyband), and the histogram of text scores.
2. Vectors: only queries with fewer than ``top`` such documents also look for the nearest ones.
3. Places: for the few candidates it is counted how many documents have a higher cosine, which needs the
   cosine of every document: this step alone takes work in proportion to queries times documents.

Document vectors are shuffled once, when repeated ids are reduced to one row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

#: Queries of one pass over the documents: their vectors and words are the only data sent to all tasks.
QUERY_BLOCK = 65_536
#: Queries and documents of one matrix of cosines.
QUERY_TILE, TILE = 4096, 512
LEXEME = re.compile(r"'((?:[^'\\]|''|\\.)*)'(?::([0-9A-Da-d,]+))?")
QUOTED = re.compile(r"'((?:[^']|'')*)'")


def lexeme_counts(tsv: str | None) -> dict[str, int]:
    """Positions of each lexeme; one without positions counts once."""
    found: dict[str, int] = {}
    for word, places in LEXEME.findall(tsv or ""):
        found[word] = found.get(word, 0) + (places.count(",") + 1 if places else 1)
    return found


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length one; NaN where a row has no usable vector."""
    ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
    x = np.full((len(column), dims), np.nan)
    x[ok] = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x[~np.isfinite(x).all(axis=1)] = np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Block:
    """A block of queries: unit vectors (NaN if unusable), and for each word the queries whose rarest word it is."""

    def __init__(self, rows: list[tuple[int, str | None, list[float] | None]], dims: int, df: dict[str, int] | None = None):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.dims = dims
        lists = pa.array([None if r[2] is None else list(r[2]) for r in rows], pa.list_(pa.float64()))
        self.vectors = unit_rows(lists, dims) if rows else np.empty((0, dims))
        self.wants = [sorted(set(QUOTED.findall(r[1] or ""))) for r in rows]
        self.by_lexeme: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.wants):
            if w:
                self.by_lexeme[min(w, key=lambda x: ((df or {}).get(x, 0), -len(x), x))].append(i)

    def text_scores(self, tsvs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document numbers, query numbers and text scores of the matches."""
        d, q, s = [], [], []
        for n, tsv in enumerate(tsvs):
            if tsv:
                counts = lexeme_counts(tsv)
                for word in counts.keys() & self.by_lexeme.keys():
                    for i in self.by_lexeme[word]:
                        if all(w in counts for w in self.wants[i]):
                            d.append(n)
                            q.append(i)
                            s.append(sum(counts[w] for w in self.wants[i]))
        return np.array(d, np.int64), np.array(q, np.int64), np.array(s, np.int64)

    def part(self, own: np.ndarray) -> "Block":
        """Some of the queries, for their vectors only."""
        out = Block([], self.dims)
        out.ids, out.vectors = self.ids[own], self.vectors[own]
        return out


def pair_cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit rows in single precision, computed in double so that they do not depend on the order of the sums."""
    return (x * y).sum(axis=1).astype(np.float32)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T).astype(np.float32)


def skyband(text: np.ndarray, cos: np.ndarray, top: int) -> np.ndarray:
    """Positions that fewer than ``top`` others equal or beat in both scores; earlier positions win ties."""
    order = np.lexsort((np.arange(len(text)), -cos, -text))
    kept, best = [], []  # the ``top`` highest cosines among those with at least this text score
    for i in order:
        if len(best) < top or cos[i] > best[0]:
            kept.append(i)
            best = sorted([*best, cos[i]])[-top:]
    return np.array(kept, np.int64)


KINDS = "q long, doc_id string, text long, cos float, n long"
ARROW_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.float32(), pa.int64())
Found = tuple[str, int | None, float | None]  # doc_id, text score, cosine


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(ARROW_KINDS)], names=["q", "doc_id", "text", "cos", "n"])


def first_best(cos: np.ndarray, c: int) -> np.ndarray:
    """Row numbers, ascending, of the ``c`` highest of each column; earlier rows win ties."""
    part = np.argpartition(-cos, c - 1, axis=0)[:c]
    cth = np.take_along_axis(cos, part, 0).min(axis=0)
    tied = np.flatnonzero(((cos >= cth).sum(axis=0) > c) & (cth > -1.5))
    if len(tied):
        part[:, tied] = np.argsort(-cos[:, tied], axis=0, kind="stable")[:c]
    return np.sort(part, axis=0)


def kept_of(held: list[Found], top: int) -> list[Found]:
    """The skyband of the documents with both scores, and the ``top`` best with one only; smaller ids win ties."""
    held = sorted(held, key=lambda f: f[0])
    both = [f for f in held if f[1] is not None and f[2] is not None]
    keep = [both[i] for i in skyband(np.array([f[1] for f in both], np.float64), np.array([f[2] for f in both], np.float64), top)]
    keep += sorted((f for f in held if f[2] is None), key=lambda f: -f[1])[:top]
    return keep + sorted((f for f in held if f[1] is None), key=lambda f: -f[2])[:top]


def first_pass(block: Block, top: int):
    """Candidates of each query by its words; rows without a doc_id say how many documents of this task have the text score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Found]] = defaultdict(list)
        histogram: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            d, q, s = block.text_scores(batch.column("tsv").to_pylist())
            if not len(d):
                continue
            names = batch.column("doc_id")
            x = unit_rows(batch.column("vector"), block.dims)
            histogram.update(zip(q.tolist(), s.tolist()))
            for a in range(0, len(d), 100_000):
                part = slice(a, a + 100_000)
                cos = pair_cosines(x[d[part]], block.vectors[q[part]])
                for i, name, text, c in zip(q[part].tolist(), names.take(pa.array(d[part])).to_pylist(), s[part].tolist(), cos.tolist()):
                    own = held[i]
                    own.append((name, text, None if c != c else c))
                    if len(own) >= 64 * top:
                        own[:] = kept_of(own, top)
                        if len(own) >= 32 * top:  # a skyband of its own; twice as many before it is looked at again
                            yield rows_of([(int(block.ids[i]), *f, None) for f in own])
                            own.clear()
        yield rows_of([(int(block.ids[i]), *f, None) for i, own in held.items() for f in kept_of(own, top)] + [(int(block.ids[i]), None, t, None, n) for (i, t), n in histogram.items()])

    return run


def nearest_pass(block: Block, top: int):
    """Candidates of each query by cosine alone; twice ``top``, since fewer than ``top`` of them match its words too."""
    keep = 2 * top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(block.ids)
        best, who = np.full((keep, m), -2, np.float32), np.full((keep, m), "", object)
        for batch in batches:
            names = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            x = unit_rows(batch.column("vector"), block.dims)
            for a in range(0, len(x), TILE):
                for b in range(0, m, QUERY_TILE):
                    cols = slice(b, b + QUERY_TILE)
                    cos = cosines(x[a : a + TILE], block.vectors[cols])
                    cos[np.isnan(cos)] = -2
                    for j in np.flatnonzero((cos.max(axis=0) >= best[-1, cols]) & (cos.max(axis=0) > -1.5)):
                        live = np.flatnonzero((cos[:, j] >= best[-1, b + j]) & (cos[:, j] > -1.5))
                        both, ids = np.concatenate([best[:, b + j], cos[live, j]]), np.concatenate([who[:, b + j], names[a + live]])
                        order = best_by_name(both, ids, keep)
                        best[: len(order), b + j], who[: len(order), b + j] = both[order], ids[order]
        q, r = np.nonzero((best > -1.5).T)
        yield rows_of([(int(block.ids[i]), who[k, i], None, float(best[k, i]), None) for i, k in zip(q, r)])

    return run


def best_by_name(cos: np.ndarray, names: np.ndarray, keep: int) -> list[int]:
    """Places of the ``keep`` highest cosines, equal ones by name."""
    live = np.flatnonzero(cos > -1.5)
    if len(live) > keep:
        kth = np.partition(cos[live], len(live) - keep)[len(live) - keep]
        live = live[cos[live] >= kth]
    return sorted(live.tolist(), key=lambda i: (-cos[i], names[i]))[:keep]


def place_pass(block: Block, thresholds: dict[int, list[float]]):
    """How many documents of a task have a cosine above each candidate's."""
    cols = [i for i, q in enumerate(block.ids) if int(q) in thresholds]
    sets = [np.array(sorted(set(thresholds[int(block.ids[i])])), np.float32) for i in cols]
    v = block.vectors[cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(t) + 1, np.int64) for t in sets]
        for batch in batches:
            x = unit_rows(batch.column("vector"), block.dims)
            x = x[~np.isnan(x[:, 0])]
            for a in range(0, len(x), TILE):
                for b in range(0, len(cols), QUERY_TILE):
                    for j, row in enumerate(cosines(v[b : b + QUERY_TILE], x[a : a + TILE]), b):
                        t = sets[j]
                        row = row[row > t[0]]
                        if len(row):
                            total[j] += np.bincount(np.searchsorted(t, row, side="left"), minlength=len(t) + 1)
        q, c, n = [], [], []
        for i, t, own in zip(cols, sets, total):
            q += [int(block.ids[i])] * len(t)
            c += t.tolist()
            n += own[::-1].cumsum()[::-1][1:].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.float32()), pa.array(n, pa.int64())], names=["q", "cos", "above"])

    return run


def leximin_top(
    docs: DataFrame, doc_id: str, tsv: str, vector: str, updated: str | None, queries: DataFrame, query_id: str, tsq: str, query_vector: str, dims: int, top: int = 3, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The first ``top`` documents of every query as (query_id, doc_id, text_score, cosine, text_pct, vector_pct, rank).

    The text score is the number of positions of the query's lexemes and exists where all of them occur;
    the vector score is the cosine and exists where both vectors have ``dims`` finite components that are
    not all zero. Documents with neither score are not ranked. Of repeated document ids the latest row
    counts, of repeated query ids one. Equal documents are ranked by id. A query without lexemes or without
    a usable vector is ranked by its other score alone. Null ids take no part; empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.struct(F.col(tsv).alias("tsv"), F.col(vector).cast("array<float>").alias("vector")).alias("v"), (F.col(updated) if updated else F.lit(0)).alias("at"))
    one = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.max_by("v", F.struct("at", "v.tsv")).alias("v")).select("doc_id", "v.tsv", "v.vector"))
    total = one.count()
    held = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(tsq).alias("tsq"), F.col(query_vector).cast("array<float>").alias("v")).dropDuplicates(["q"])
    held = cut(held)
    df = word_counts(one, held)
    parts, last = [], None
    while True:  # blocks of bounded size, in the order of the ids
        block_rows = (held if last is None else held.where(F.col("q") > last)).orderBy("q").limit(query_block).collect()
        if block_rows or not parts:
            words = {w for r in block_rows for w in QUOTED.findall(r.tsq or "")}
            parts.append(ranked_block(one, Block([(r.q, r.tsq, r.v) for r in block_rows], dims, {w: df.get(w, 0) for w in words}), top, total))
        if len(block_rows) < query_block:
            break
        last = block_rows[-1].q
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_counts(docs: DataFrame, queries: DataFrame) -> dict[str, int]:
    """Documents of each word that any query has; the words of queries are a vocabulary, which the driver holds."""
    wanted = queries.select(F.explode(F.array_distinct(F.regexp_extract_all("tsq", F.lit(r"'((?:[^']|'')*)'"), F.lit(1)))).alias("w")).distinct()
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("tsv", F.lit(r"'((?:[^'\\]|''|\\.)*)'"), F.lit(1)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r.w: r.n for r in wanted.join(held, "w").collect()}


def ranked_block(docs: DataFrame, block: Block, top: int, total: int) -> DataFrame:
    found = cut(docs.mapInArrow(first_pass(block, top), KINDS))
    histogram = found.where("n is not null").groupBy("q", "text").agg(F.sum("n").alias("n"))
    higher = histogram.withColumn("text_above", F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    candidates = cut(pruned(found.where("n is null").drop("n"), top))
    full = {r.q for r in candidates.where("text is not null and cos is not null").groupBy("q").count().where(F.col("count") >= top).select("q").collect()}
    poor = np.array([i for i, q in enumerate(block.ids) if int(q) not in full and not np.isnan(block.vectors[i, 0])], np.int64)
    if len(poor):
        near = docs.select("doc_id", "vector").mapInArrow(nearest_pass(block.part(poor), top), KINDS).drop("n")
        near = near.join(candidates.where("text is not null and cos is not null").select("q", "doc_id"), ["q", "doc_id"], "left_anti").select("q", "doc_id", "text", "cos")
        candidates = cut(pruned(candidates.unionByName(near), top))
    # at most a skyband for each query of the block comes to the driver
    thresholds: dict[int, list[float]] = defaultdict(list)
    for r in candidates.where("cos is not null").select("q", "cos").distinct().collect():
        thresholds[r.q].append(r.cos)
    above = docs.select("vector").mapInArrow(place_pass(block, thresholds), "q long, cos float, above long").groupBy("q", "cos").agg(F.sum("above").alias("cos_above"))
    size = F.lit(float(max(total, 1)))
    scored = (
        candidates.join(higher.select("q", "text", "text_above"), ["q", "text"], "left").join(above, ["q", "cos"], "left")
        .withColumn("text_pct", F.coalesce(1 - F.col("text_above") / size, F.lit(0.0)))
        .withColumn("vector_pct", F.coalesce(1 - F.col("cos_above") / size, F.lit(0.0)))
        .withColumn("leximin", F.array_sort(F.array("text_pct", "vector_pct")))
    )
    w = Window.partitionBy("q").orderBy(F.desc("leximin"), "doc_id")
    first = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return first.select(F.col("q").alias("query_id"), "doc_id", F.col("text").alias("text_score"), F.col("cos").cast("double").alias("cosine"), "text_pct", "vector_pct", "rank")


def pruned(found: DataFrame, top: int) -> DataFrame:
    """The skyband over all tasks, and the ``top`` best of those with one score only."""

    def run(group: pa.Table) -> pa.Table:
        q = group["q"][0].as_py()
        keep = kept_of(list(zip(group["doc_id"].to_pylist(), group["text"].to_pylist(), group["cos"].to_pylist())), top)
        return pa.table({"q": pa.array([q] * len(keep), pa.int64()), "doc_id": [f[0] for f in keep], "text": pa.array([f[1] for f in keep], pa.int64()), "cos": pa.array([f[2] for f in keep], pa.float32())})

    return found.groupBy("q").applyInArrow(run, "q long, doc_id string, text long, cos float")
