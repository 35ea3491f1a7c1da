"""Recall of the approximate nearest-neighbour queries against brute force over their largest table."""

import pytest

from tidemill.plans import registry, search

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def truth(spark):
    return {(r.query_id, r.id) for r in registry.queries()["c2_knn_batch"](spark, DATA).collect()}


@pytest.mark.parametrize("name", ["ivf", *search.OVER_FETCH])
def test_recall(spark, truth, name):
    found = search.ivf_probed(spark, DATA) if name == "ivf" else search.quantised(name)(spark, DATA)
    got = {(r.query_id, r.id) for r in found.collect()}
    print(name, len(got & truth) / len(truth))
    assert len(got & truth) >= 0.9 * len(truth)
