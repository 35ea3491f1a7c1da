import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import leak
from tidemill.llm.leak import fold, fold_offsets, leaked_items

ITEM = "Which of the following clauses keeps only those groups whose total is above a limit?"


def test_folding():
    assert fold("Ré­su​mé, N° ½ İX K") == " resume n 1 2 ix k "
    text = "Ünï — cödé́ ﬁne A1"
    assert [w for w, _, _ in fold_offsets(text)] == fold(text).split()
    assert all(text[a : b + 1] for _, a, b in fold_offsets(text))


def test_passages_and_offsets(spark):
    cut12 = " ".join(ITEM.split()[:12])
    docs = [
        (1, f"Intro. {ITEM} Outro."), (2, ITEM.upper().replace(" ", " ​—\n")), (3, " ".join(ITEM.split()[:11]) + " other words"), (4, f"x{cut12}"), (5, f"see {cut12}."), (6, None), (7, ""), (8, "word " * 200_000 + ITEM),
        (1, f"Intro. {ITEM} Outro."), (9, "the answer is a very long one that has at least twelve words in it too"),
    ]
    items = [(10, ITEM, None), (11, "too short", "short"), (12, None, "The answer is a very long one that has at least twelve words in it"), (13, ITEM, ""), (13, ITEM, ""), (None, ITEM, None)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    q = spark.createDataFrame(items, "item_id long, item_text string, answer string")
    rows = leaked_items(d, "doc_id", "text", q, "item_id", ["item_text", "answer"]).collect()
    assert {(r.doc_id, r.item_id, r.field) for r in rows} == {(i, j, "item_text") for i in (1, 2, 5, 8) for j in (10, 13)} | {(9, 12, "answer")}
    assert len(rows) == 11  # the repeated document gives its rows again
    by = {r.doc_id: r for r in rows}
    text = dict(docs)[1]
    assert text[by[1].start_offset : by[1].end_offset] == ITEM[:-1] and by[1].words_shared == len(ITEM.split())
    assert by[5].words_shared == 12


def test_empty_tables_and_size_bound(spark, monkeypatch):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    q = spark.createDataFrame([(1, ITEM, None)], "item_id long, item_text string, answer string")
    assert leaked_items(d, "doc_id", "text", q.limit(0), "item_id", ["item_text"]).count() == 0
    assert leaked_items(d.limit(0), "doc_id", "text", q, "item_id", ["item_text"]).count() == 0
    many = spark.createDataFrame([(i, ITEM, None) for i in range(5)], "item_id long, item_text string, answer string")
    whole = sorted(leaked_items(d, "doc_id", "text", many, "item_id", ["item_text"]).collect())
    monkeypatch.setattr(leak, "PART_BYTES", 2 * len(ITEM))  # three automata
    assert len(whole) == 5 and sorted(leaked_items(d, "doc_id", "text", many, "item_id", ["item_text"]).collect()) == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=4), st.integers(1, 7))
def test_passages_are_those_of_brute_force(doc, items, words):
    found = leak.Scanner([(n, "f", " ".join(w)) for n, w in enumerate(items)], words).passages(fold(" ".join(doc)))
    runs = lambda w: {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    for n, w in enumerate(items):
        covered = {i + k for i in range(len(doc) - words + 1) if tuple(doc[i : i + words]) in runs(w) for k in range(words)}
        assert {i for a, b in found.get((n, "f"), []) for i in range(a, b)} == covered


def test_the_automaton_grows_with_the_items():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(2000)]
    texts = [(i, "f", " ".join(rng.choices(words, k=60))) for i in range(200)]
    stats = leak.Scanner(texts, 12).tree.get_stats()
    assert stats["nodes_count"] <= sum(len(t) for _, _, t in texts) + 2000
