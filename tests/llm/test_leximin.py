import numpy as np
import pyarrow as pa

from tidemill.llm import leximin
from tidemill.llm.leximin import Block, cosines, leximin_top, lexeme_counts, nearest_pass, place_pass, skyband, unit_rows

DOCS = "doc_id string, text_tsv string, embedding array<float>, updated_at int, q long, cos string"
QUERIES = "query_id long, query_tsq string, query_vector array<float>, extra int"


def run(spark, docs, queries, top=3, block=4096):
    d = spark.createDataFrame([(*x, 1, 9, "clash") if len(x) == 3 else (*x, 9, "clash") for x in docs], DOCS)
    q = spark.createDataFrame([(*x, 0) for x in queries], QUERIES)
    out = leximin_top(d, "doc_id", "text_tsv", "embedding", "updated_at", q, "query_id", "query_tsq", "query_vector", 2, top, block)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


def brute(docs, query, top):
    docs = dict((d, (t, e)) for d, t, e in docs if d is not None)
    n, (_, tsq, v) = len(docs), query
    words = [w.strip("' ") for w in tsq.split("&")] if tsq else []
    text, cos = {}, {}
    for d, (t, e) in docs.items():
        c = lexeme_counts(t)
        if words and all(w in c for w in words):
            text[d] = sum(c[w] for w in words)
        if v is not None and e is not None and len(e) == 2 and any(e) and any(v):
            cos[d] = float(np.float32(np.dot(e, v) / np.linalg.norm(e) / np.linalg.norm(v)))

    def pct(s, d):
        return 1 - sum(x > s[d] for x in s.values()) / n if d in s else 0

    ranked = sorted((d for d in docs if d in text or d in cos), key=lambda d: ([-x for x in sorted((pct(text, d), pct(cos, d)))], d))
    return ranked[:top]


def test_lexemes():
    assert lexeme_counts("'a':1,2B,3 'b' 'c''d':4A") == {"a": 3, "b": 1, "c''d": 1}
    assert lexeme_counts(None) == lexeme_counts("") == {}


def test_skyband_keeps_every_possible_winner():
    rng = np.random.default_rng(0)
    for _ in range(50):
        t, c = rng.integers(0, 5, 40).astype(float), rng.random(40)
        kept = set(skyband(t, c, 3).tolist())
        for i in set(range(40)) - kept:
            assert sum(t[j] >= t[i] and c[j] >= c[i] for j in range(40) if j != i) >= 3


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "d"]
    docs = []
    for i in range(300):
        own = [w for w in words if rng.random() < 0.5]
        tsv = " ".join(f"'{w}':{','.join(str(p) for p in range(1, rng.integers(2, 9)))}" for w in own)
        e = rng.normal(size=2).astype("f4").tolist() if rng.random() < 0.9 else None
        docs.append((f"d{i:03}", tsv or None, e))
    queries = [(1, "'a'", [1.0, 0.0]), (2, "'a' & 'b'", [0.0, 1.0]), (3, "'c' & 'd'", None), (4, None, [1.0, 1.0]), (5, "'zzz'", [-1.0, 0.2])]
    got = run(spark, docs, queries, block=2)
    for q in queries:
        assert got[q[0]] == brute(docs, q, 3), q


def test_weak_scores_are_not_masked(spark):
    docs = [("x", "'a':1,2,3,4,5,6,7,8,9", [-1.0, 0.0]), ("y", None, [1.0, 0.0]), ("z", "'a':1,2", [0.9, 0.1]), ("w", None, [0.0, 1.0])]
    assert run(spark, docs, [(1, "'a'", [1.0, 0.0])])[1][0] == "z"


def test_edge_rows(spark):
    docs = [("a", "'x':1", [1.0, 0.0], 1), ("a", None, [0.0, 1.0], 0), (None, "'x':1", [1.0, 0.0], 1), ("b", "'x'", None, 1), ("c", "", [float("nan"), 1.0], 1), ("d", None, [0.0, 0.0], 1), ("e", None, [1.0], 1), ("f", None, None, None)]
    got = run(spark, docs, [(1, "'x'", [1.0, 0.0]), (1, "'x'", [1.0, 0.0]), (None, "'x'", None), (2, None, None), (3, "", [0.0, 0.0])])
    assert got == {1: ["a", "b"]}
    assert run(spark, [], [(1, "'x'", [1.0, 0.0])]) == {} and run(spark, docs, []) == {}


def test_copies_of_an_embedding_are_cut_by_id():
    names = [f"d{i:04}" for i in reversed(range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([[1.0, 0.5]] * 3000, pa.list_(pa.float32()))], names=["doc_id", "vector"])
    parts = [batch.slice(at, 700) for at in range(0, 3000, 700)]
    kept = next(nearest_pass(Block([(1, None, [1.0, 0.0])], 2), 3)(iter(parts)))
    assert sorted(kept.column("doc_id").to_pylist()) == [f"d000{i}" for i in range(6)]


def test_places_are_counted_over_all_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.1 * rng.normal(size=(400, 8)) for c in rng.normal(size=(12, 8))]).astype("f4")  # clusters one after the other
    q = x[::97] + 0.01
    block = Block([(i, None, v.tolist()) for i, v in enumerate(q)], 8)
    want = cosines(unit_rows(pa.array(x.tolist(), pa.list_(pa.float32())), 8), block.vectors)
    limits = {i: np.quantile(want[:, i], [0.2, 0.9, 0.999]).astype("f4").tolist() for i in range(len(q))}
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float32()))], names=["vector"])
    monkeypatch.setattr(leximin, "TILE", 200)
    out = next(place_pass(block, limits)(iter([batch]))).to_pylist()
    assert len(out) == 3 * len(q) and all(r["above"] == (want[:, r["q"]] > np.float32(r["cos"])).sum() for r in out)


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(6)
    docs = [(f"d{i:03}", " ".join(f"'w{k}':{','.join('1' * rng.integers(1, 4))}" for k in rng.choice(9, 3, replace=False)), rng.normal(size=2).astype("f4").tolist()) for i in range(200)]
    queries = [(i, f"'w{i % 9}' & 'w{(i + 1) % 9}'" if i % 5 else "'w1'", rng.normal(size=2).tolist()) for i in range(30)]
    one, many = run(spark, docs, queries), run(spark, docs, queries, block=7)
    assert one == many == {q[0]: brute(docs, q, 3) for q in queries}
