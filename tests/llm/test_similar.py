import numpy as np
import pytest

from tidemill.llm.similar import TABLES, VISITS, Router, build_plan, mutual_pairs, prepare, rotation, similar_vectors

SCHEMA = "chunk_id long, embedding array<float>, id long, vec string"


def brute(rows, k, dims):
    best = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in ok:
        others = {}
        for j, w in ok:
            if j != i:
                c = round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                others[j] = max(c, others.get(j, -2))
        best[i] = [j for j, _ in sorted(others.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return best


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour_id)
    return out


def test_pseudo_rotation_keeps_lengths():
    r = rotation(64, 3)
    assert np.allclose(r @ r.T, np.eye(64), atol=1e-5)


def test_unusable_rows_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, [3.0 * x for x in base[0]]) for i in range(20)]  # scaled copies of row 0
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [1.0] * 7), (205, [None] + [1.0] * 7), (None, base[1]), (206, [float("inf")] + [0.0] * 7)]
    got = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 8, 5))
    want = brute(rows, 5, 8)
    assert got.keys() == want.keys()
    assert all(got[i] == want[i] for i in want if i >= 100 or i == 0)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_and_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 64))
    near = base[:200] + 0.1 * rng.normal(size=(200, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    want = brute(rows, 5, 64)
    df = table(spark, rows)
    got = found(similar_vectors(df, "chunk_id", "embedding", 64, 5))
    recall = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert recall >= 0.9
    close = {(r.id_a, r.id_b) for r in mutual_pairs(similar_vectors(df, "chunk_id", "embedding", 64, 5, min_similarity=0.9)).collect()}
    assert {(i, 1500 + i) for i in range(200)} <= close


def test_large_buckets_are_refined_and_split(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    x = centre + 0.05 * rng.normal(size=(600, 16))  # one tight cluster falls into the same buckets
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 16, 3, bucket_limit=100))
    want = brute(rows, 3, 16)
    recall = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert got.keys() == want.keys() and recall >= 0.9


def test_repeated_id_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.1])]
    got = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 2, 1))
    assert got[2] == [1] and got[3] == [1]
    assert similar_vectors(table(spark, []), "chunk_id", "embedding", 2, 1).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_collections(spark, n):
    rows = [(i, [1.0, float(i)]) for i in range(n)]
    assert similar_vectors(table(spark, rows), "chunk_id", "embedding", 2, 5).count() == n * (n - 1)


@pytest.mark.parametrize("options", [{}, {"min_similarity": 0.9}])
def test_near_copies_closer_than_half_precision(spark, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(300, 64))  # cosines about 0.9999
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype("f4"))]
    rows += [(300, v) for _, v in rows[:1]] + [(300, (x[7] + 0.01 * rng.normal(size=64)).tolist())]  # two vectors of one id
    got, want = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 64, 5, **options)), brute(rows, 5, 64)
    assert all(got[i] == want[i] for i in range(300))


def test_large_buckets_lose_nothing(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(600, 16)))]
    one, split = (found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 16, 5, bucket_limit=n)) for n in (40_000, 50))
    assert one == split


def test_visits_do_not_depend_on_the_number_of_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(7).normal(size=(50, 64)))]
    units = table(spark, rows).select("chunk_id", "embedding").mapInArrow(prepare(64), "id long, k1 long, k2 long, vec binary")
    assert build_plan(units, 64, 3, 9, 40_000, 42).visits == 9


def test_copies_at_every_distance(spark):
    """Forty near-copies each that differ by little more and little less than single precision can tell."""
    rng = np.random.default_rng(8)
    rows = []
    for g, noise in enumerate((0, 1e-7, 1e-6, 1e-5, 3e-5, 1e-4)):
        centre = rng.normal(size=64) / 8
        rows += [(100 * g + (37 * i) % 41, ((1 + i % 3) * (centre + noise * rng.normal(size=64) / 8)).astype("f4").tolist()) for i in range(40)]
    for options in ({}, {"min_similarity": 0.9}):
        got, want = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 64, 5, **options)), brute(rows, 5, 64)
        assert got == want


def test_more_neighbours_than_a_bucket_keeps(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(9).normal(size=(120, 16)))]
    got, want = found(similar_vectors(table(spark, rows), "chunk_id", "embedding", 16, 40)), brute(rows, 40, 16)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_every_row_gets_the_best_of_all_it_meets(spark):
    """One row in a hundred has no near neighbour; what the others reach is no bound for it."""
    rng = np.random.default_rng(10)
    groups = np.repeat(rng.normal(size=(330, 64)), 6, axis=0) + 0.05 * rng.normal(size=(1980, 64))
    x = np.concatenate([groups, rng.normal(size=(20, 64))])
    got = found(similar_vectors(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), "chunk_id", "embedding", 64, 5))
    x = x.astype("f4").astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    enters = np.zeros((len(x), 2 * 64 * TABLES), bool)
    enters[Router(64, TABLES, VISITS, 42, {})(x.astype("f4"))[:2]] = True
    cosines = np.where(enters.astype("f4") @ enters.T.astype("f4") > 0, np.round(x @ x.T, 9), -2)
    np.fill_diagonal(cosines, -2)
    assert all(got[i] == np.lexsort((np.arange(len(x)), -c))[:5].tolist() for i, c in enumerate(cosines))
