"""Operators against literal fixtures, brute force and their error cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import semantics as S
from tidemill.functions import vectors as V
from tidemill.functions.semantics import InvalidParameter
from tidemill.operators import ai, chunk, extract, graph, hybrid, knn, lexical, nl, stemmer
from tidemill.operators.change_feed import apply_changes, publish, read_current, vacuum
from tidemill.operators.hot_keys import balanced_sums, endpoint_totals, hot_nodes
from tidemill.sources import lakehouse
from tidemill.streaming import vectorizer as vz


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


# --- semantics and vectors ---


def test_null_order_overflow_and_overlap(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x long")
    assert [r.x for r in df.orderBy(S.pg_asc("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(S.pg_desc("x")).collect()] == [None, 2, 1]
    big = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x long").agg(S.sum_exact("x").alias("s")).first()
    assert int(big.s) == 3 * 2**62
    assert df.where("x > 5").agg(S.avg_exact("x").alias("a")).first().a is None
    a = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    r = one(spark, p=S.overlaps(a(1, None), a(3)), q=S.overlaps(a(1, 3), a(3)), e=S.overlaps(a(), a()), n=S.overlaps(F.lit(None).cast("array<int>"), a(1)), m=S.overlaps(a(None), a(None)))
    assert (r.p, r.q, r.e, r.n, r.m) == (False, True, False, False, False)


@pytest.mark.parametrize("bad", [[{"col": "a", "op": "~", "value": 1}], [{"col": "a", "op": "IN", "value": []}], [{"col": "a", "op": "="}], [{"col": "a", "op": "=", "value": None}], "x", [1]])
def test_structured_filter_errors(spark, bad):
    with pytest.raises(InvalidParameter):
        S.structured_filter(bad)


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")
    assert df.where(S.structured_filter([])).count() == 3
    assert [r.a for r in df.where(S.structured_filter([{"col": "a", "op": ">", "value": 1}, {"col": "b", "op": "=", "value": "y"}])).collect()] == [2]
    for bad in ("a = 1; drop table x", "a = 1 -- c", "a /* c */ = 1"):
        with pytest.raises(InvalidParameter):
            S.raw_filter(bad)


def test_distances(spark):
    a, b, z = V.lit_vector([0.0, 0.0]), V.lit_vector([3.0, 4.0]), V.lit_vector([0.0, 0.0])
    r = one(spark, l2=V.l2_distance(a, b), ip=V.distance(b, b, "dot"), cos=V.cosine_distance(b, b), zero=V.cosine_distance(a, z), same=V.cosine_distance(b, V.lit_vector([-3.0, -4.0])))
    assert r.l2 == 5 and r.ip == -25 and abs(r.cos) < 1e-12 and np.isnan(r.zero) and abs(r.same - 2) < 1e-12
    with pytest.raises(Exception, match="dimensions"):
        one(spark, x=V.l2_distance(V.lit_vector([1.0]), b))
    for bad in ([], [float("nan")], [float("inf")], [0.0] * 16_001):
        with pytest.raises(InvalidParameter):
            V.lit_vector(bad)
    r = one(spark, a=V.parse_vector(F.lit("[1, 2.5]")), b=V.parse_vector(F.lit("[1,")), c=V.parse_vector(F.lit("[]")), t=V.vector_text(V.lit_vector([1.0, 2.5])), y=V.vector_bytes(V.lit_vector([1.0])))
    assert r.a == [1.0, 2.5] and r.b is None and r.c is None and r.t == "[1.0,2.5]" and bytes(r.y) == b"\x00\x00\x80?"
    assert [V.sbq_bytes_per_vector(*x) for x in ((1024, 1), (768, 1), (1536, 2))] == [128, 96, 384]
    with pytest.raises(InvalidParameter):
        V.metric_name("manhattan")


# --- nearest neighbours ---


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype("f4")
    rows = [(i, v.tolist(), int(i % 5)) for i, v in enumerate(x)] + [(None, [0.0] * 8, 1), (999, None, 1)]
    return x, spark.createDataFrame(rows, "id long, v array<float>, label int")


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_and_indexed_agree(vectors, metric):
    x, df = vectors
    q = x[:5].tolist()
    d = knn.distances_np(x[:5], x, metric)
    want = {(i, int(j)) for i in range(5) for j in np.lexsort((np.arange(400), d[i]))[:7]}
    got = {(r.query_idx, r.id) for r in knn.knn_batch(df, "id", "v", q, 7, metric).collect()}
    assert got == want
    assert [r.id for r in knn.knn(df, "id", "v", q[0], 3, metric).collect()] == [int(j) for j in np.lexsort((np.arange(400), d[0]))[:3]]
    index = knn.ivf_build(df, "id", "v", 10, metric, soar_lambda=1.0)
    assert {(r.query_idx, r.id) for r in index.probe(q, 7).collect()} == want
    for make in (knn.sbq_knn, lambda *a, **k: knn.pq_knn(*a, m=4, centroids=16, **k), knn.sq8_knn, knn.rabitq_knn):
        assert {(r.query_idx, r.id) for r in make(df, "id", "v", q, k=7, over_fetch=60, metric=metric).collect()} == want


def test_index_parameters(vectors, spark):
    x, df = vectors
    q = x[:5].tolist()
    index = knn.ivf_build(df, "id", "v", 10)
    p = knn.recommend_probes(index, knn.knn_batch(df, "id", "v", q, 5), q, 5, 0.9)
    assert 1 <= p <= 10
    stats = knn.scan_stats(index, q, p).collect()
    assert len(stats) == 5 and all(r.lists_probed == p and 0 < r.rows_scanned <= 400 for r in stats)
    for bad in (dict(m=1), dict(ef_search=1001), dict(k=0)):
        with pytest.raises(InvalidParameter):
            knn.hnsw_knn(df, "id", "v", q, **bad).count()
    with pytest.raises(InvalidParameter):
        knn.ProductQuantiser(x.astype(float), 3)
    assert knn.knn_batch(df, "id", "v", [], 5).count() == 0


def test_index_is_stored(vectors, spark, tmp_path):
    x, df = vectors
    q = x[:5].tolist()
    for make in (None, lambda s: knn.ScalarQuantiser(s)):
        index = knn.ivf_build(df, "id", "v", 10, folder=str(tmp_path / f"i{make is None}"), quantiser=make, keep=["label"])
        narrow, wide = (knn.scan_stats(index, q, p).agg(F.sum("rows_scanned")).first()[0] for p in (1, 10))
        assert narrow < wide == 5 * 400
        plan = index.probe(q[:1], 3, 1)._jdf.queryExecution().executedPlan().toString()
        assert make is not None or "PartitionFilters: [isnotnull(list" in plan
        got = index.probe(q, 3, where=F.col("label") == 2).join(df.where("label = 2"), "id")
        assert got.count() == 15
        more = spark.createDataFrame([(5000 + i, v) for i, v in enumerate(q)], "id long, v array<float>").withColumn("label", F.lit(9))
        index.append(more, "id", "v")
        near = {(r.query_idx, r.id) for r in knn.VectorIndex(spark, index.root).probe(q, 2).collect()}
        assert {(i, 5000 + i) for i in range(5)} <= near and {(i, i) for i in range(5)} <= near
    held = knn.decoded_bytes(index, list(range(10))).agg(F.sum("vectors"), F.sum("vector_bytes"), F.sum("code_bytes")).first()
    assert tuple(held) == (405, 405 * 32, 405 * 8)
    assert sorted(r.id for r in knn.vindex_assign(index, df, "id", "v").collect()) == list(range(400))
    with pytest.raises(InvalidParameter):
        knn.ivf_build(df.withColumn("list", F.lit(1)), "id", "v", 4, keep=["list"])
    with pytest.raises(InvalidParameter):
        knn.ivf_build(df.limit(0), "id", "v", 4)


def test_similarity_join_in_blocks(vectors, monkeypatch):
    x, df = vectors
    want = {(r.left_id, r.id) for r in knn.similarity_join(df.where("id < 30"), df, "id", "v", 3).collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    assert {(r.left_id, r.id) for r in knn.similarity_join(df.where("id < 30"), df, "id", "v", 3).collect()} == want and len(want) == 90
    assert knn.similarity_join(df.limit(0), df, "id", "v", 3).count() == 0


def test_quantisers():
    s = np.array([[0.0, 0.0], [2.0, 2.0]])
    b = knn.BinaryQuantiser(s)
    assert b.mean.tolist() == [1, 1] and b.bit_rows(np.array([[3.0, 0.0]])).tolist() == [[True, False]]
    sq = knn.ScalarQuantiser(np.array([[0.0, 5.0], [255.0, 5.0]]))
    assert sq.encode(np.array([[0.0, 5.0], [255.0, 9.0]])).tolist() == [[0, 0], [255, 0]] and sq.decode(np.array([[0, 0]]))[0, 1] == 5
    x = np.random.default_rng(1).normal(size=(200, 16))
    pq, aq = knn.ProductQuantiser(x, 4, 16), knn.ProductQuantiser(x, 4, 16, eta=1.0)
    assert pq.encode(x).shape == (200, 4) and (pq.encode(x) == aq.encode(x)).all()
    rq = knn.RotationQuantiser(x, 5)
    assert np.corrcoef(rq.estimate(x[:20], rq.encode(x)).ravel(), knn.distances_np(x[:20], x, "l2").ravel())[0, 1] > 0.99


def test_threshold_join(vectors, spark):
    x, df = vectors
    d = knn.distances_np(x, x, "l2")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] < 1.5}
    got = {(r.id_a, r.id_b) for r in knn.threshold_join(df, "id", "v", 1.5).collect()}
    assert want == {p for p in got if p[0] < 400} and knn.threshold_join(df, "id", "v", -1.0).count() == 0


# --- lexical and hybrid ---


@pytest.mark.parametrize("word,want", [("consistency", "consist"), ("running", "run"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("knackeries", "knackeri"), ("indexing", "index"), ("databases", "databas"), ("queries", "queri"), ("happy", "happi"), ("by", "by"), ("sensational", "sensat"), ("agreed", "agre"), ("luxuriated", "luxuri")])
def test_stemmer(word, want):
    assert stemmer.stem(word) == want


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "error timeout blk_zebra9 connection reset"), (3, "info dfs datanode packetresponder terminating"), (4, None)], "id long, t string")
    folder = str(tmp_path / "i")
    assert lexical.bm25_build(docs, "id", "t", folder) == 3
    assert [r.id for r in lexical.bm25_search(spark, folder, "Connections RESET!", 5).collect()] == [2]
    assert [r.id for r in lexical.bm25_search(spark, folder, "foxes", 5).collect()] == [1]
    assert lexical.bm25_search(spark, folder, "", 5).count() == 0 and lexical.bm25_search(spark, folder, "the", 5).count() == 0
    with pytest.raises(InvalidParameter):
        lexical.bm25_search(spark, folder, "fox", 0)
    with pytest.raises(Exception):
        lexical.bm25_search(spark, str(tmp_path / "none"), "fox", 1)
    assert lexical.sanitize("Ação, X_1!") == "a o x_1" and lexical.analyze("The " + "x" * 41 + " databases") == ["databas"]


def test_bm25_rebuild_is_seen(spark, tmp_path):
    folder = str(tmp_path / "i")
    lexical.bm25_build(spark.createDataFrame([(1, "red apple")], "id long, t string"), "id", "t", folder)
    assert lexical.bm25_search(spark, folder, "pears", 5).count() == 0
    lexical.bm25_build(spark.createDataFrame([(1, "red apple"), (2, "green pear")], "id long, t string"), "id", "t", folder)
    assert [r.id for r in lexical.bm25_search(spark, folder, "pears", 5).collect()] == [2]
    assert vacuum(spark, folder) == 1 and lexical.bm25_search(spark, folder, "apples", 5).count() == 1


def test_hybrid(spark):
    df = spark.createDataFrame([("dv", "other words", [1.0, 0.0, 0.0]), ("df", "database database database", None)], "doc_id string, body string, e array<float>")
    run = lambda wv, wt: [r.id for r in hybrid.hybrid_search_rrf(df, "doc_id", "body", "e", "database", [1.0, 0.0, 0.0], vector_weight=wv, text_weight=wt).collect()]
    assert run(3.0, 1.0)[0] == "dv" and run(1.0, 3.0)[0] == "df" and run(-0.0, 1.0)[0] == "df"
    for bad in (dict(vector_weight=-1.0), dict(k=0), dict(text_weight=float("nan")), dict(query_text=None, query_vector=None), dict(filter=[], filter_sql="true")):
        with pytest.raises(InvalidParameter):
            hybrid.hybrid_search_rrf(df, "doc_id", "body", "e", **({"query_text": "database", "query_vector": [1.0, 0.0, 0.0]} | bad))
    got = hybrid.hybrid_search(df, {"id_col": "doc_id", "text_col": "body", "vec_col": "e", "query_text": "database", "filter": [{"col": "doc_id", "op": "=", "value": "df"}]}).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("df", round(1 / 61, 6))]


# --- graph ---


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (0, 3), (None, 7)], "s long, d long")


def nodes(df):
    return sorted(r.node for r in df.collect())


def test_expand(spark, g, tmp_path):
    folder = str(tmp_path / "g")
    assert graph.graph_build(g, "s", "d", folder) == 6
    adj = graph.load(spark, folder)
    assert [nodes(graph.expand(adj, [4], h)) for h in (-1, 0, 1, 2, 3)] == [[4], [4], [3, 4], [0, 2, 3, 4], [0, 1, 2, 3, 4]]
    assert nodes(graph.expand(adj, [99, -1], 2)) == []
    more = g.union(spark.createDataFrame([(4, 9)], "s long, d long"))
    assert nodes(graph.expand(graph.load(spark, folder), [9], 1)) == []
    graph.graph_refold(more, "s", "d", folder)
    assert nodes(graph.expand(graph.load(spark, folder), [9], 1)) == [4, 9] and nodes(graph.expand(graph.load(spark, folder), [8], 1)) == [8]
    sets = sorted((r.set_id, r.node) for r in graph.expand_sets(adj, [1, 1, 2, None], [4, 0, 1, 2], 1).collect())
    assert sets == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2)]
    with pytest.raises(InvalidParameter):
        graph.expand_sets(adj, [1], [1, 2], 1)
    with pytest.raises(Exception):
        graph.graph_refold(g, "s", "d", str(tmp_path / "none"))
    with pytest.raises(InvalidParameter):
        graph.graph_build(spark.createDataFrame([(-1, 1)], "s long, d long"), "s", "d", str(tmp_path / "bad"))


def test_hubs_are_dealt_out(spark, tmp_path):
    star = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(59, 60), (60, 61)], "s long, d long")
    adj = graph.adjacency(star, "s", "d")
    arcs, hubs = graph.salted_arcs(adj, 10)
    assert [(r.src, r.salts) for r in hubs.collect()] == [(0, 6)] and arcs.where("src = 0").select("salt").distinct().count() > 1
    start = spark.createDataFrame([(1, 1), (2, 61)], "set_id int, node long")
    for hops in (1, 2, 3):
        a, b = (sorted(map(tuple, graph.expand_multi(adj, start, hops, n).collect())) for n in (10, 1000))
        assert a == b
    a, b = ({r.node: round(r.score, 12) for r in graph.ppr(adj, [1], 0.5, 5, arcs_a_task=n).collect()} for n in (10, 1000))
    assert a == b
    folder = str(tmp_path / "g")
    graph.graph_build(star, "s", "d", folder)
    assert graph.drop_graph(spark, folder) and not graph.drop_graph(spark, folder)


def folder_bytes(spark):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def test_many_sets_take_bits(spark):
    """2,100 sets (two blocks of words) that reach 400 nodes by a hub: the 840,000 pairs are not written on the way."""
    star = graph.adjacency(spark.createDataFrame([(0, i) for i in range(1, 400)], "s long, d long"), "s", "d")
    start = spark.range(2100).selectExpr("concat('set', id) AS set_id", "id % 399 + 1 AS node")
    before = folder_bytes(spark)
    got = graph.expand_multi(star, start, 2)
    assert folder_bytes(spark) - before < 5_000_000
    assert got.columns == ["set_id", "node"] and got.distinct().count() == got.count() == 2100 * 400
    # nothing sent: shuffled joins, with the hub's arcs salted
    few = sorted(map(tuple, graph.expand_multi(star, start.where("node = 3"), 2, 100, 0).collect()))
    assert few == sorted((f"set{i}", x) for i in range(2, 2100, 399) for x in range(400))
    line = graph.adjacency(spark.createDataFrame([(i, i + 1) for i in range(2600)], "s long, d long"), "s", "d")
    rows = graph.expand_multi(line, start, 2, sent=0).collect()
    want = {(f"set{i}", x) for i in range(2100) for x in range(max(0, i % 399 - 1), i % 399 + 4)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_ppr(spark, g):
    adj = graph.adjacency(g, "s", "d")
    a = np.zeros((5, 5))
    for s, d in ((0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (0, 3)):
        a[s, d] += 1
        a[d, s] += 1
    p = a / a.sum(1, keepdims=True)
    for seeds, r in (([4, 4, 0], np.array([1, 0, 0, 0, 2]) / 3), (None, np.full(5, 0.2)), ([77], np.full(5, 0.2))):
        pi = r.copy()
        for _ in range(7):
            pi = 0.5 * r + 0.5 * pi @ p
        got = {x.node: x.score for x in graph.ppr(adj, seeds, 0.5, 7).collect()}
        assert all(abs(got[i] - pi[i]) < 1e-9 for i in range(5))


def test_paths(spark, g):
    assert [graph.hop_range(x) for x in ("-[e]-", "-[e*]-", "-[e*2]-", "-[*1..2]-", "-[e*2..]-")] == [(1, 1), (1, 3), (2, 2), (1, 2), (2, 3)]
    line = graph.adjacency(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "s long, d long"), "s", "d")
    assert nodes(graph.pgq_match(line, [0], "-[e*2..3]-")) == [2, 3] and nodes(graph.pgq_match(line, [0], "-[e*0..1]-")) == [0, 1]
    with pytest.raises(InvalidParameter):
        graph.hop_range("e*2")


def test_graph_rag(spark):
    e = {"A": [1, 0, 0, 0], "B": [0, 1, 0, 0], "C": [0, 0, 1, 0], "D": [0, 0, 0, 1], "E": [1, 1, 0, 0]}
    ns = spark.createDataFrame([(i, "w", "c", k, [float(x) for x in v]) for i, (k, v) in enumerate(e.items())], "id long, workspace_id string, collection_id string, name string, embedding array<float>")
    es = spark.createDataFrame([("w", "c", 0, 1, 3, ["kab"]), ("w", "c", 1, 2, 1, ["kbc"]), ("w", "c", 2, 3, 1, ["kcd"])], "workspace_id string, collection_id string, src_id long, dst_id long, weight int, source_chunk_ids array<string>")
    got = graph.graph_rag_search(ns, es, [0.9, 0.1, 0.0, 0.0], "w", "c", 1, 2).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("kab", 3), ("kbc", 1), ("kcd", 1)]


def test_extraction(spark):
    text = "Ada Lovelace met Charles Babbage in London. The Analytical Engine impressed Ada Lovelace. I saw Al."
    ents = extract.entities(text)
    assert [e[1] for e in ents] == ["ada lovelace", "charles babbage", "london", "analytical engine"] and ents[0][3] == 2
    assert len(extract.relations([e[1] for e in ents])) == 6 and extract.entities(None) == []
    assert extract.parse_reply("E<|>X Corp<|>org\nR<|>X Corp<|>Ada<|>hires\nbad\nR<|>Ada<|>X corp<|>", text) == ([("X Corp", "x corp", "org", 1)], [("ada", "x corp", 2, "hires")])
    assert extract.parse_reply("e<|>A1 B<|>org\nE<|>a1 b<|>x\nE<|>C<|>y", text) == ([("A1 B", "a1 b", "org", 2), ("C", "c", "y", 1)], [("a1 b", "c", 1, "")])
    # small letters of any alphabet are no capitals; all but blanks between capitals ends a run
    assert [e[1] for e in extract.entities("привет łódź Москва  Сити. 東京 Jean-Paul O'Hara Foo\tBar Baz\nQux Yes Been Her Hall So")] == ["москва сити", "jean", "paul o", "hara foo", "bar baz", "qux yes been her hall"]
    assert len(extract.entities(" ".join(f"Name{i}," for i in range(100)))) == 64 and len(extract.entities("Aaa, Bbb, Ccc", 2)) == 2
    assert extract.relations(list("abcdef")) == [(a, b, 1, "") for i, a in enumerate("abcdef") for b in "abcdef"[i + 1 : i + 5]]
    assert extract.parse_reply("nothing", text)[0] == ents
    chunks = spark.createDataFrame([(1, text)], "id long, t string")
    n1, e1 = extract.graph_upsert(None, None, chunks, "w", "c", "id", "t")
    n2, e2 = extract.graph_upsert(n1.withColumn("mention_count", F.col("mention_count").cast("int")), e1.withColumn("weight", F.col("weight").cast("int")), chunks, "w", "c", "id", "t")
    assert {r.normalized_name: r.mention_count for r in n2.collect()}["ada lovelace"] == 4
    assert all(r.weight == 2 and r.source_chunk_ids == ["1"] for r in e2.collect())


# --- chunks, models, questions ---


def test_chunking(spark):
    t = "The cat sat. The dog ran. A bird flew away today."
    assert chunk.chunk(t, "fixed", 20, 4) == [t[0:20], t[16:36], t[32:49]]
    assert chunk.chunk(t, "sentence", 30, 0) == ["The cat sat. The dog ran.", "A bird flew away today."]
    assert chunk.pack(["aaaa bbbb", "cc", "dddddddddd"], 10, 3) == ["aaaa bbbb", "cc", "cc dddddddddd"]
    letters = "abcdefghij" * 120
    for strategy in ("sentence", "recursive", "fixed"):  # what has no boundary is cut into windows that overlap
        assert chunk.chunk(letters, strategy, 512, 64)[:2] == [letters[:512], letters[448:960]] and len(chunk.chunk(letters, strategy, 512, 64)[2]) == 304
    assert chunk.chunk("aa bb\ncc dd\n\nee ff. gg hh", "recursive", 8, 3) == ["aa bb", "cc dd", "ee ff", "gg hh"] and chunk.chunk("aa bb\ncc dd", "recursive", 11, 0) == ["aa bb\ncc dd"]
    assert chunk.chunk("One two. Three four! Five?", "sentence", 20, 9) == ["One two. Three four!", "Five?"] and chunk.chunk("One. Two. Six.", "sentence", 9, 4) == ["One. Two.", "Two. Six."]
    assert chunk.chunk(None) == chunk.chunk("") == chunk.chunk(" \n", "sentence") == [] and chunk.chunk("  ", "fixed") == ["  "]
    df = spark.createDataFrame([(1, t), (2, ""), (3, None), (4, "x" * 7)], "id long, t string")
    for s in chunk.STRATEGIES:
        got = {}
        for r in chunk.chunk_rows(df, "id", "t", s, 20, 4).collect():
            got.setdefault(r.id, []).append(r.chunk_text)
        assert got == {1: chunk.chunk(t, s, 20, 4), 4: ["x" * 7]}
    for bad in (("fixed", 0, 0), ("fixed", 5, 5), ("words", 5, 1), ("fixed", 5, -1)):
        with pytest.raises(InvalidParameter):
            chunk.check(*bad)


def test_models(spark):
    df = spark.createDataFrame([(1, "4"), (2, "5"), (3, None)], "id long, t string")
    assert [r.b for r in df.orderBy("id").select(ai.if_batch("is even", F.col("t")).alias("b")).collect()] == [True, False, None]
    assert [r.b for r in df.where("t is not null").orderBy("id").select(ai.ai_if(F.col("t")).alias("b")).collect()] == [True, False]
    with pytest.raises(Exception, match="null"):
        df.select(ai.ai_if(F.col("t"))).collect()
    assert ai.parse_number("score: 7.5/10") == 7.5 and ai.parse_sentiment("Mostly NEGATIVE.") == "negative"
    for f in (ai.parse_bool, ai.parse_sentiment, ai.parse_number):
        with pytest.raises(ai.ModelError):
            f("hm")
    sizes = []
    assert len(ai.generate_batch(["1"] * 600, lambda p: sizes.append(len(p)) or ["x"] * len(p))) == 600 and sizes == [256, 256, 88]
    assert ai.generate_batch([], lambda p: 1 / 0) == []
    assert ai.rerank("q", ["a", "bb", "cc"], lambda q, d: [len(x) for x in d], 2) == [(1, 2), (2, 2)]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("a", 3, "2"), ("b", 1, None)], "k string, o int, t string")
    got = {r.k: r.summary for r in ai.agg_summarize(rows, ["k"], "t", "o", lambda p: [x.split("\n", 1)[1] for x in p]).collect()}
    assert got == {"a": "x\n2", "b": None}
    many = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i, f"t{i}" * (50 if i % 2 else 1)) for i in range(2000)], "k int, o int, t string").repartition(6)
    same = lambda p: [x.split("\n", 1)[1] for x in p]
    got = {r.k: r.summary for r in ai.agg_summarize(many, ["k"], "t", "o", same).collect()}
    for k in (None, 0, 1, 2):
        own = [f"t{i}" * (50 if i % 2 else 1) for i in range(2000) if (None if i % 7 == 0 else i % 3) == k]
        assert got[k] == "\n".join(own)[:12_000]
    assert ai.agg_summarize(many.limit(0), ["k"], "t", "o", same).count() == 0
    reg = ai.ModelRegistry()
    reg.create_model("m", "chat", "https://x", model=ai.parity)
    assert reg.apply_model("m")(["2"]) == ["yes"] and reg.list_models()[0]["name"] == "m" and reg.drop_model("m") and not reg.drop_model("m")
    with pytest.raises(InvalidParameter):
        reg.create_model("m", "chat", "ftp://x")
    assert ai.pushdown_safe({"a"}, {"b"}) and not ai.pushdown_safe({"a"}, {"a", "b"})


def test_questions(spark):
    spark.range(5).withColumnRenamed("id", "n").createOrReplaceTempView("numbers")
    spark.range(5).createOrReplaceTempView("secrets")
    ask = lambda sql, **k: nl.nl_query(spark, "q", ["numbers"], lambda p: [sql], **k)
    assert ask("SELECT n FROM numbers ORDER BY n", max_rows=3).count() == 3
    assert ask("```sql\nWITH x AS (SELECT n FROM numbers) SELECT count(*) AS c FROM x;\n```").first()[0] == '{"c":5}'
    for bad in ("DROP TABLE numbers", "SELECT 1; SELECT 2", "SELECT * FROM secrets", "SELECT n FROM numbers -- c", "SELECT * FROM numbers JOIN secrets", "INSERT INTO numbers SELECT 1", "", "SELECT * FROM parquet.`/tmp/x`", "SELECT (SELECT max(id) FROM secrets) FROM numbers", "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets", "WITH x AS (SELECT 1 AS n) SELECT n FROM (WITH y AS (SELECT id FROM secrets) SELECT id AS n FROM y)", "SELECT * FROM global_temp.numbers", "SELECT nothing FROM numbers"):
        with pytest.raises(InvalidParameter):
            ask(bad)
    with pytest.raises(InvalidParameter):
        ask("SELECT 1", max_rows=0)
    spark.range(2).createOrReplaceGlobalTempView("numbers")
    with pytest.raises(InvalidParameter):
        ask("SELECT id FROM global_temp.numbers")
    assert ask("WITH secrets AS (SELECT n FROM numbers) SELECT * FROM secrets").count() == 5
    cfg = nl.NlConfigs()
    cfg.add_config("c", ["numbers"], "ctx", "t")
    cfg.add_template("t", "tmpl")
    cfg.set_template_enabled("t", False)
    cfg.add_template("t", "tmpl2")
    assert cfg.refresh_value_index(spark, "c", "numbers", "n", 2) == 2 and cfg.prompt("c") == "ctx\nnumbers.n: 0, 1"
    for f in (lambda: cfg.config("x"), lambda: cfg.set_template_enabled("x", True), lambda: cfg.refresh_value_index(spark, "c", "secrets", "id"), lambda: cfg.add_config("", ["a"])):
        with pytest.raises(InvalidParameter):
            f()


# --- sources and pipeline ---


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "category string, amount double")
    cat = lakehouse.SnapshotCatalog(spark, str(tmp_path / "s"))
    with pytest.raises(lakehouse.NoSnapshot):
        cat.read("r")
    cat.refresh("r", df)
    old = cat.read("r")
    cat.refresh("r", df.where("category = 'b'"))
    assert old.count() == 3 and cat.read("r").count() == 1
    assert lakehouse.SnapshotCatalog(spark, str(tmp_path / "s")).open().read("r").count() == 1
    assert [(r.category, r.c, r.a) for r in cat.olap("r").collect()] == [("b", 1, None)]
    assert cat.freshness("r").first()[0].total_seconds() >= 0
    with pytest.raises(InvalidParameter):
        cat.register("r", " ")
    assert lakehouse.write_parquet(df, str(tmp_path / "w")) == 3
    cache = lakehouse.ColumnCache(1)
    assert cache.columnarize("x", df, ["category"]) is cache.columnarize("x", df, ["category"]) and cache.columnarize("y", df, ["amount"]).count() == 3


def test_inserted_rows(spark, tmp_path):
    root = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        lakehouse.read_inserted(spark, root)
    assert lakehouse.insert_rows(spark.range(3), root) == 3 and lakehouse.insert_rows(spark.range(3, 5), root) == 2
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        lakehouse.insert_rows(bad, root)
    assert lakehouse.insert_rows(spark.range(1).withColumn("x", F.lit("new")), root) == 1
    rows = lakehouse.read_inserted(spark, root)
    assert sorted((r.id, r.x) for r in rows.where("x is null").collect()) == [(i, None) for i in range(5)] and rows.count() == 6
    assert lakehouse.insert_rows(spark.range(0), root) == 0


def test_import_vectors(spark, tmp_path):
    df = spark.createDataFrame([('[{"id": 1, "values": [1, 2]}, {"id": "b", "values": [3], "metadata": {"k": 1}}]',), ("[]",)], "j string")
    assert lakehouse.import_vectors(df, "j", str(tmp_path / "t")) == 2
    assert {(r.id, tuple(r.embedding), r.metadata) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("1", (1.0, 2.0), "{}"), ("b", (3.0,), '{"k":1}')}
    assert lakehouse.import_vectors_chunked(df, "j", str(tmp_path / "u"), 1) == 2
    with pytest.raises(Exception, match="id and values"):
        lakehouse.import_vectors(spark.createDataFrame([('[{"id": 1}]',)], "j string"), "j", str(tmp_path / "v"))


QUEUE = "job_id long, vectorizer_id int, source_pk string, op string, state string, attempts int, owner string, lease_deadline timestamp_ntz, last_error string, enqueued_at timestamp_ntz"


def test_queue_transitions(spark):
    now = F.lit("2025-01-01 12:00:00").cast("timestamp_ntz")
    rows = [(1, 1, "a", "insert", "pending", 0, None, None, None, None), (2, 1, "a", "delete", "pending", 0, None, None, None, None), (3, 1, "b", "insert", "processing", 4, "old", None, None, None), (4, 1, "c", "insert", "failed", 5, None, None, "x", None)]
    q = spark.createDataFrame(rows, QUEUE).withColumn("lease_deadline", F.when(F.col("job_id") == 3, now - F.expr("INTERVAL 1 HOUR")))
    merged = {r.source_pk: (r.job_id, r.op) for r in vz.coalesce_jobs(q).collect()}
    assert merged == {"a": (1, "delete")}
    claimed = vz.claim(q, "me", now, 2)
    by = {r.job_id: r for r in claimed.collect()}
    assert (by[1].state, by[1].owner, by[1].attempts, by[3].state) == ("processing", "me", 1, "processing") and by[2].owner == "me"
    assert {r.job_id for r in vz.finish(claimed, "me", [1, 3]).collect()} == {2, 3, 4}
    failed = {r.job_id: r for r in vz.fail(claimed, "me", [1], "boom", now).collect()}
    assert failed[1].state == "pending" and failed[1].last_error == "boom" and failed[1].lease_deadline.second == 2
    last = claimed.withColumn("attempts", F.lit(5))
    assert {r.job_id: r.state for r in vz.fail(last, "me", [1], "boom", now).collect()}[1] == "failed"
    assert {r.job_id: r.state for r in vz.reap(q.withColumn("attempts", F.lit(5)), now).collect()}[3] == "failed"
    assert vz.purge(q, 0).count() == 3 and vz.renew(claimed, "me", now, 9).where("job_id = 1").first().lease_deadline.second == 9
    assert {(r.state, r.jobs) for r in vz.stats(q).collect()} == {("pending", 2), ("processing", 1), ("failed", 1)}
    assert [r.b for r in spark.createDataFrame([(1,), (3,), (20,)], "a int").select(vz.backoff_seconds(F.col("a")).alias("b")).collect()] == [2, 8, 300]


def test_streaming_vectorizer(spark, tmp_path):
    src, out, ck = (str(tmp_path / p) for p in ("src", "out", "ck"))
    schema = "pk string, body string, op string, seq long"
    v = vz.Vectorizer(1, "pk", "body", 8, ai.hashed_embedding(8), "fixed", 10, 2)
    spark.createDataFrame([("a", "hello world again", "insert", 1), ("b", "short", "insert", 2), ("a", "new text", "update", 3)], schema).write.mode("append").parquet(src)
    vz.run_vectorizer(spark, v, src, schema, out, ck).awaitTermination()
    got = {(r.source_pk, r.chunk_index): r.chunk_text for r in vz.Target(spark, out).read().collect()}
    assert got == {("a", 0): "new text", ("b", 0): "short"}
    spark.createDataFrame([("b", None, "delete", 4), ("c", "third one", "insert", 5)], schema).write.mode("append").parquet(src)
    vz.run_vectorizer(spark, v, src, schema, out, ck).awaitTermination()
    rows = vz.Target(spark, out).read().collect()
    assert {r.source_pk for r in rows} == {"a", "c"} and all(len(r.embedding) == 8 for r in rows)


def test_vectorizer_ignores_late_changes(spark, tmp_path):
    target = vz.Target(spark, str(tmp_path / "out"), 4)
    v = vz.Vectorizer(1, "pk", "body", 8, ai.hashed_embedding(8))
    feed = lambda *rows: target.apply(v, vz.last_changes(spark.createDataFrame(list(rows), "pk string, body string, op string, seq long"), "pk", "seq"), "seq")
    now = lambda: {r.source_pk: r.chunk_text for r in target.read().collect()}
    feed(("a", "new", "upsert", 10), ("b", "b", "insert", 1), ("c", "", "insert", 2))
    feed(("a", "old", "upsert", 5))
    assert now() == {"a": "new", "b": "b", "c": ""}
    feed(("a", None, "delete", 3), ("b", None, "delete", 7), (None, "x", "insert", 8), ("d", "x", "insert", None))
    assert now() == {"a": "new", "c": ""}
    feed(("b", "late", "insert", 6))
    assert now() == {"a": "new", "c": ""}
    assert feed(("b", "back", "insert", 8)) == 1 and now() == {"a": "new", "b": "back", "c": ""}
    assert target.apply(v, spark.createDataFrame([], "pk string, body string, op string, seq long"), "seq") == 0
    pointer = tmp_path / "out" / "CURRENT"
    pointer.write_text("version-lost")
    (tmp_path / "out" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):  # an unreadable target is no empty one
        feed(("z", "z", "insert", 99))
    reg = vz.VectorizerRegistry()
    assert reg.create("pk", "body", 8, ai.hashed_embedding(8), "fixed", 10, 2) == 1 and reg.create("pk", "body", 4, ai.hashed_embedding(4)) == 2
    reg.save(spark, str(tmp_path / "reg"))
    again = vz.VectorizerRegistry.open(spark, str(tmp_path / "reg"), ai.hashed_embedding(8))
    assert again.get(1).chunk_strategy == "fixed" and again.drop(1) and not again.drop(1)
    with pytest.raises(InvalidParameter):
        again.get(1)


# --- hot keys and change feed ---


def test_hot_keys(spark):
    rows = [(1, 2, 5, "x"), (1, 2, 5, "x"), (1, 1, None, "x"), (None, 1, 2, "x"), (3, None, 4, "x"), (None, None, 9, "x")] + [(1, i, 1, "x") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "s long, d long, w int, key string").repartition(7)
    want = {}
    for s, d, w, _ in rows:
        for k in {s, d} - {None}:
            n, t = want.get(k, (0, 0))
            want[k] = (n + 1, t + (w or 0))
    for parts in (1, 3, 16):
        got = {r.node_id: (r.n_edges, r.sum_weight) for r in endpoint_totals(df, "s", "d", "w", parts).collect()}
        assert got == want
    assert [r.node_id for r in hot_nodes(endpoint_totals(df, "s", "d", "w"), len(rows), 0.5).collect()] == [1]
    assert endpoint_totals(df.limit(0), "s", "d", "w").count() == 0
    with pytest.raises(ValueError):
        balanced_sums(df, "s", {"key": F.lit(1)})
    money = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 2**62), (1, 1.9, 3), (2, None, None)], "k long, x double, y long").withColumn("d", F.col("x").cast("decimal(9,2)"))
    r = {r.key: (round(r.x, 9), str(r.d), r.y) for r in balanced_sums(money, "k", {"x": F.col("x"), "d": F.col("d"), "y": F.col("y")}, 3).collect()}
    assert r == {1: (3.1, "3.10", 2**62 + 4), 2: (0.0, "0.00", 0)}
    with pytest.raises(ValueError):
        balanced_sums(money, "k", {"d": F.col("d").cast("decimal(30,2)")})
    with pytest.raises(Exception, match="64 bits|overflow"):
        balanced_sums(money.withColumn("y", F.lit(2**62)), "k", {"y": F.col("y")}).collect()


def test_change_feed(spark, tmp_path):
    rows = [
        (1, " a ", "INSERT", 5, "v5"), (1, "a", "insert", 1, "v1"), (1, "a", "delete ", 3, None), (1, "a\t", "Update", 5, "v5"), (2, "a", "upsert", 4, "w4"), (1, "b", "insert", 2, "x"), (1, "b", "DELETE", 6, "y"), (1, "b", "noop", 9, "z"),
        (1, None, "insert", 7, "n"), (1, "c", None, 8, "n"), (None, "c", "insert", 8, "n"), (1, "c", "insert", None, "n"), (1, "", "insert", 10, "empty"), (1, "long", "insert", 11, "x" * 300_000),
    ] + [(7, "hot", "update", 100 + i, str(i)) for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "v int, k string, o string, j long, body string, deleted int").repartition(5)
    state = apply_changes(df, "v", "k", "o", "j", "body")
    live = {(r.owner, r.pk): (r.seq, r.payload) for r in state.where("not deleted").collect()}
    assert live == {(1, "a"): (5, "v5"), (2, "a"): (4, "w4"), (1, ""): (10, "empty"), (1, "long"): (11, "x" * 300_000), (7, "hot"): (599, "499")}
    root = str(tmp_path / "t")
    publish(state, root)
    late = spark.createDataFrame([(1, "b", "insert", 5, "too late", 0), (1, "b", "insert", 12, "back", 0), (1, "a", "delete", 4, None, 0)], df.schema)
    again = apply_changes(late, "v", "k", "o", "j", "body", read_current(spark, root))
    publish(again, root)
    now = {(r.owner, r.pk): r.payload for r in read_current(spark, root).where("not deleted").collect()}
    assert now[(1, "b")] == "back" and now[(1, "a")] == "v5" and len(now) == 6
    assert apply_changes(df.limit(0), "v", "k", "o", "j", "body").count() == 0


def test_sql_functions(spark):
    from tidemill.functions.sql_functions import TABLES, register, table_function

    names = register(spark, ai.parity, ai.hashed_embedding(4))
    assert len(names) == len(set(names)) >= 35 and len(TABLES) >= 30
    r = spark.sql(
        "SELECT l2_distance(array(0f, 0f), array(3f, 4f)) AS d, inner_product(array(1f, 2f), array(3f, 4f)) AS p, label_overlap(array(1s, null), array(3s)) AS o, sbq_bytes_per_vector(768, 1) AS b, "
        "chunk_text('hello world', 'fixed', 5, 0) AS c, size(extract_entities('Ada Lovelace met Charles Babbage')) AS n, cosine_distance(array(1f, 0f), array(0f, 2f)) AS cs, cosine_distance(array(0f), array(1f)) AS z, "
        "vector_in('[1, 2.5]') AS vi, vector_in('[1') AS bad, vector_out(array(1f, 2.5f)) AS vo, vector_cmp(array(1f, 2f), array(1f, 3f)) AS vc, vector_recv(vector_send(array(1f, 2f))) AS rt, ai_if('is 4 even') AS yes, ai_generate('3') AS g, "
        "size(embed('some text')) AS e, ai_if_batch('even', '7') AS ib, analyze_text('the Databases') AS an, sanitize_query('Ab, c!') AS sq, cover_density('red x apple', 'apples red') AS cd, size(extract_graph('Ada One, Bob Two')) AS eg, vectorizer_backoff(3) AS bo"
    ).first()
    assert (r.d, r.p, r.o, r.b, r.c, r.n, r.cs) == (5.0, 11.0, False, 96, ["hello", " worl", "d"], 2, 1.0) and np.isnan(r.z)
    assert (r.vi, r.bad, r.vo, r.vc, r.rt, r.yes, r.g) == ([1.0, 2.5], None, "[1.0,2.5]", -1, [1.0, 2.0], True, "no")
    assert (r.e, r.ib, r.an, r.sq, round(r.cd, 9), r.eg, r.bo) == (4, False, ["databas"], "ab c", 0.05, 1, 8.0)
    for bad in ("l2_distance(array(0f), array(3f, 4f))", "vector_coerce(array(1f), 2)", "cosine_distance(array(0f), array(3f, 4f))"):
        with pytest.raises(Exception, match="dimensions"):
            spark.sql(f"SELECT {bad}").first()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    table_function("knn", "nearest", rows, "id", "v", [1.0, 0.1], 1)
    assert spark.sql("SELECT id FROM nearest").first().id == 1


def test_cover_density():
    assert [hybrid.covers(p) for p in ([[1, 5], [3]], [[2, 4, 9]], [[1], []], [])] == [[(1, 3, 2), (3, 5, 2)], [(2, 2, 1), (4, 4, 1), (9, 9, 1)], [], []]
    density = lambda text, *q: round(hybrid.cover_density(text.split(), list(q)), 6)
    assert density("a b", "a", "b") == 0.1 and density("a x b", "a", "b") == 0.05 and density("a x b a", "a", "b") == 0.15 and density("a a a", "a") == 0.3 and density("a x", "a", "b") == 0


def test_footers_and_counters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).selectExpr("id", "cast(id as string) as s").sortWithinPartitions("id").write.parquet(path)
    df = lakehouse.min_max_count(spark, path, "id")
    assert tuple(df.first()) == (0, 999, 1000) and "PushedAggregation: [MIN(id), MAX(id), COUNT(*)]" in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(lakehouse.min_max_count(spark, path, "s").first()) == ("0", "999", 1000)
    groups = lakehouse.row_groups(spark, path, "id", 0, 10).agg(F.sum("scanned"), F.sum("skipped")).first()
    assert tuple(groups) == (1, 3)
    counter = ai.CallCounter(spark)
    cheap = spark.range(100).where(ai.if_costly(F.col("id").cast("string"), counter.wrap(ai.parity)) & (F.col("id") < 3))
    assert cheap.count() == 2 and counter.count == 3
    counter.reset()
    assert counter.count == 0
    said = spark.range(1).select(ai.chat(F.lit("hi"), lambda p, system: [f"{system}: {x}" for x in p], "be kind").alias("r")).first().r
    assert said == "be kind: hi"
    r = one(spark, a=V.vector_from_bytes(V.vector_bytes(V.lit_vector([1.0, 2.0]))), b=V.vector_from_bytes(F.lit(b"abc")), n=V.vector_from_bytes(F.lit(b"\x00\x00\xc0\x7f")), d=V.with_dims(V.lit_vector([1.0]), 1))
    assert (r.a, r.b, r.n, r.d) == ([1.0, 2.0], None, None, [1.0])
    with pytest.raises(Exception, match="dimensions"):
        one(spark, d=V.with_dims(V.lit_vector([1.0]), 2))
