import pytest

from tidemill.llm.garbled import CHAINS, forms, from_utf16, garble, garbled_documents, restored_run, strange

CLEAN = ["A decisão não é estável: a réplica já está atrás.", "Após a correção, só a última posição é válida.", "Isn’t it “the end” — 5 ≤ 6 … costs €5", "Die Änderung verkürzt die Ausführung über Nacht.", "São três as opções do parâmetro padrão.", "数据迁移完成。索引重建。"]


def corpus(spark, extra):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(extra)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, token string")


def garbled(text, written, read):
    return text.encode(written).decode(read, "replace")


CASES = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("utf-8", "koi8_r"), ("utf-8", "cp1251")]


def test_every_case_is_found_and_restored(spark):
    texts = [garbled(CLEAN[0], *c) for c in CASES]
    out = {r.doc_id: r for r in garbled_documents(corpus(spark, texts), "doc_id", "text").collect()}
    assert set(out) == {1000 + i for i in range(len(texts))}
    for i, case in enumerate(CASES):
        assert out[1000 + i].restored_text == CLEAN[0], case


def test_other_damage_and_unusual_text(spark):
    twice = garbled(garbled(CLEAN[1], "utf-8", "cp1252") if False else CLEAN[1].encode().decode("latin-1"), "utf-8", "latin-1")
    entities = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in garbled(CLEAN[0], "utf-8", "latin-1"))
    utf16 = "ok: " + "plain words read in pairs of bytes.".encode().ljust(36).decode("utf-16-le")
    bad = [twice, entities, utf16, garbled(CLEAN[0], "cp1252", "utf-8"), "lost � sign"]
    good = [None, "", "ASCII only", "naïve Ångström Łódź", "São Paulo​ e﻿ São", "É ÉTÉ Ù", "│ 12 │ └──┘", "数据。数据", "x" * 100_000, "é" * 50_000]
    out = {r.doc_id: r for r in garbled_documents(corpus(spark, bad + good), "doc_id", "text").collect()}
    assert set(out) == {1000 + i for i in range(len(bad))}
    assert out[1000].restored_text == CLEAN[1] and out[1001].restored_text == CLEAN[0]
    assert "plain words read in pairs" in out[1002].restored_text
    assert out[1003].n_restored > 0 and out[1004].n_lost == 1


def test_a_weak_token_alone_is_no_case(spark):
    assert garbled_documents(corpus(spark, ["only Θ here"]), "doc_id", "text").count() == 0


def test_parts(spark):
    assert ("utf-8", "cp1252") in CHAINS[0] and garble("é", (("utf-8", "cp1252"),)) == "Ã©"
    assert "nÃ£o" in forms("não", False) and "Ã£" in forms("ã", True)
    assert restored_run("â€™") == "’" and restored_run("çã") is None
    assert strange("decisгo") and not strange("decisão")
    assert from_utf16("数据迁移完成") is None


def test_empty_and_repeated(spark):
    df = corpus(spark, [garbled(CLEAN[0], "utf-8", "latin-1")])
    assert garbled_documents(df.limit(0), "doc_id", "text").count() == 0
    assert garbled_documents(df.union(df), "doc_id", "text").count() == 2


@pytest.mark.parametrize("text", ["a" * 200_000 + "é", "é" * 20_000 + "a" * 20_000, "aé" * 20_000])
def test_long_words_take_linear_time(text):
    from tidemill.llm.garbled import WORD

    assert sum(len(w) for w in WORD.findall(text)) == len(text)


def test_garbled_forms_may_outnumber_the_clean_words(spark):
    out = garbled_documents(corpus(spark, [garbled(CLEAN[0], "cp1252", "cp850")] * 60), "doc_id", "text")
    assert {r.doc_id for r in out.collect()} == set(range(1000, 1060))
