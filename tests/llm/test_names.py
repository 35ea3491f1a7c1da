import random

import pytest

from tidemill.llm.names import ALIKE, CROWD, VOTE, abbreviates, asked, entity_pairs, evidence, learned_variants, name_entities, near, rivals, shared_places, spellings_of, voters, words


def entities(spark, names):
    rows = [(i, ws, name, norm, "clash", 1) for i, (ws, name, norm) in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, workspace_id string, name string, normalized_name string, root string, n int")
    return name_entities(df, "id", "workspace_id", "name", "normalized_name")


def linked(spark, *names):
    out = entities(spark, [("w", n, None) for n in names]).collect()
    return len({r.entity for r in out}) == 1


@pytest.mark.parametrize("a,b", [("abc", "abc"), ("abc", "ab"), ("abc", "acb"), ("abc", "axc"), ("abc", "xabc")])
def test_one_error(a, b):
    assert near(a, b) and near(b, a)


def test_two_errors():
    assert not near("abcd", "badc") and not near("abc", "a") and not near("abc", "xyc")


def test_reading():
    assert words("Dr. Robert J. Mustermann") == ["dr", "j", "mustermann", "robert"] == words("MUSTERMANN, robert J. (Dr.) Dr")
    assert words("AcmestraData Sys. & Co - Berlin") == ["acmestra", "and", "co", "data", "sys"] and words("K.J. Müller-Brix") == ["brix", "kj", "muller"]
    assert words("???") == ["???"] and words("( )") == ["()"] and words("Int'l") == ["intl"]
    assert abbreviates("ltd", "limited") and abbreviates("gianni", "giovanni") and abbreviates("laboratory", "laboratories") and not abbreviates("mining", "milling") and not abbreviates("bob", "robert")


def test_channel():
    name = [{"w": "acmestra", "df": 2}, {"w": "and", "df": 90}, {"w": "company", "df": 90}, {"w": "energy", "df": 50}]
    made = spellings_of(name)
    assert made["acmestra"] == ["and", "company", "energy"] and made["acmestra energy"] == ["and", "company"] and made["and company energy"] == ["acmestra"]
    assert {k for n in ("eac", "ec") for k in asked([{"w": "acmestra", "df": 2}, {"w": n, "df": 3}])} & made.keys() == {"acmestra @ace", "acmestra @ce"}
    person = [{"w": "j", "df": 90}, {"w": "robert", "df": 50}, {"w": "tressomir", "df": 2}]
    assert {"tressomir @jr", "robert tressomir", "tressomir @r"} <= spellings_of(person).keys()


@pytest.mark.parametrize(
    "names",
    [
        ("Robert Krandeval", "Bob Krandeval", "Krandeval, R.", "ROBERT KRANDEVL", "Krandeval Robert", "Prof. Robert_Krandeval (ops)"),
        ("Katherine J. Brix-Yorel", "K. J. Brix-Yorel", "Kathy Brix-Yorel"),
        ("Vrelanor Optics Technologies GmbH", "Vrelanor Optics", "vrelanor", "Optics Vrelanor Tech GmbH", "Vrelanor OTG", "VrelanorOptics Technologies", "Vrelanro Optics"),
        ("José Trelavan", "Jose Trelavan", "Zé Trelavan"),
        ("Giovanni Rossi", "Gianni Rossi", "Rossi, Giovanni"),
        ("Taro Yamada", "Yamada Taro"),
        ("Acme Bakery", "Acme Bakery Ltd", "ACME Bakry Ltd"),
        ("University of Leeds", "Univ. of Leeds", "Leeds University", "Universty of Leeds"),
    ],
)
def test_variants_are_linked(spark, names):
    assert linked(spark, *names)


@pytest.mark.parametrize("names", [("Robert Krandeval", "Olivia Krandeval"), ("Vrelanor Optics GmbH", "Vrelanor Foods GmbH"), ("Robert A. Krandeval", "Robert B. Krandeval"), ("Robert Krandeval", "Robert Tressomir"), ("University of Leeds", "University of Bradford"), ("Acme Bakery Ltd", "Acme Brewery Ltd")])
def test_relatives_and_sisters_are_not(spark, names):
    assert not linked(spark, *names)


def syllables(rng, n):
    return "".join(rng.choice(["ka", "lo", "mi", "ru", "ten", "vas", "dor", "shi", "pel", "gan"]) for _ in range(n))


def test_nicknames_forms_and_titles_are_learned(spark):
    """Nothing here is on any list: nicknames, a legal form with its abbreviation, and a title are made up."""
    rng = random.Random(3)
    full = {"Quovadrin": "Zeb", "Ilmandra": "Poko", "Tarsevil": "Nix", "Ombeline": "Fufu"}
    rows, want = [], {}
    for f in range(160):
        ws, root = f"w{f % 7}", syllables(rng, 4).capitalize()
        first, other = rng.sample(sorted(full), 2)
        spelled = [(f"{first} {root}", 0), (rng.choice([f"{full[first]} {root}", f"{root}, {first}", f"{first[0]}. {root}", f"Grux. {first} {root}"]), 0), (f"{full[first]} {root}", 0)]
        spelled += [(f"{other} {root}", 1)] * (f % 8 == 0)  # a relative
        firm = syllables(rng, 5).capitalize()
        line, second = rng.sample(["Kelpworks", "Moonfarm", "Tidecraft", "Ropehaus"], 2)
        spelled += [(f"{firm} {line} Ammonderschaft", 2), (rng.choice([f"{firm} {line} Amds.", f"{firm} {line}", f"{firm} Ammonderschaft", f"{firm} {line[0]}A"]), 2)]
        spelled += [(f"{firm} {second} Ammonderschaft", 3)] * (f % 8 == 1)  # a sister
        for n, who in spelled:
            want[len(rows)] = (f, who)
            rows.append((ws, n, None))
    pairs = {(r.id_a, r.id_b) for r in entity_pairs(entities(spark, rows)).collect()}
    true = {(a, b) for a in want for b in want if a < b and want[a] == want[b]}
    assert len(pairs & true) >= 0.95 * len(true) and len(pairs & true) >= 0.98 * len(pairs)


def test_frequent_root_is_no_group(spark):
    """Five thousand persons of one surname: each spelling meets only names it can be made of."""
    rng = random.Random(4)
    firsts = sorted({syllables(rng, 4).capitalize() for _ in range(6000)})[:2500]
    rows = [("w", f"{n} Silva", None) for n in firsts] + [("w", f"SILVA, {n}", None) for n in firsts]
    pairs = {(r.id_a, r.id_b) for r in entity_pairs(entities(spark, rows)).collect()}
    assert {(i, i + len(firsts)) for i in range(len(firsts))} <= pairs and len(pairs) <= 1.5 * len(firsts)


def test_long_words_with_an_error(spark):
    long = "abcdefghij" * 9
    assert linked(spark, f"Ana {long}", f"Ana {long[:50]}{long[51:]}", f"Ana {long[:20]}x{long[21:]}") and not linked(spark, f"Ana {long}", f"Ana {long[:20]}xy{long[22:]}")


def test_edge_rows(spark):
    names = [("w", None, "robert krandeval"), ("w", "Robert Krandeval", None), ("v", "Robert Krandeval", ""), ("w", None, None), ("w", "  ", ""), (None, "Robert Krandeval", ""), ("w", "???", ""), ("w", "x" * 50_000, None), ("w", "Robert Krandeval", "")]
    out = entities(spark, names)
    pairs = {(r.id_a, r.id_b) for r in entity_pairs(out).collect()}
    assert pairs == {(0, 1), (0, 8), (1, 8)}
    assert {r.id for r in out.collect()} == {0, 1, 2, 6, 7, 8}
    assert entities(spark, []).count() == 0


def test_places_of_many_words_are_evidence_too(spark):
    """Tars shares two places with Tarsevil alone, too few of its 22 names, and four with 29 others as well."""
    forms = [(f"{root} {w}", n) for root in ("lira", "moku") for w, n in (("tars", 1), ("tarsevil", 100))]
    forms += [(" ".join(sorted((root, w))), n) for root in ("adorn", "bexal", "cirro", "dulma") for w, n in (("tars", 1), ("tarsevil", 100), *((f"first{i}", 1) for i in range(29)))]
    forms += [(" ".join(sorted((f"single{i}", "tars"))), 1) for i in range(16)]
    df = spark.createDataFrame([("w", f, n) for f, n in forms], "ws string, form string, n long")
    assert ("tars", "tarsevil") in {(r.w, r.to) for r in learned_variants(df).collect()}


def test_no_pair_is_lost_and_all_its_places_count(spark):
    rng = random.Random(5)
    sizes = [rng.choice((2, 2, 2, 3, 4, 6, 7, 9, 30)) for _ in range(400)]
    held = {p: (rng.sample(range(60), n), rng.randrange(20)) for p, n in enumerate(sizes)}
    df = [w % 15 for w in range(60)]
    places = shared_places(spark.createDataFrame([(p, (f"w{w}", df[w]), least) for p, (ws, least) in held.items() for w in ws], "place long, w struct<w: string, df: long>, least long"))
    want, votes = {}, {}
    for ws, least in held.values():
        r = len(ws) - 1
        vote = round(VOTE * min(1, CROWD / r) ** 2)
        for a in ws:
            votes[f"w{a}"] = votes.get(f"w{a}", 0) + r * vote
            for b in ws:
                if a != b:
                    e, rooted = want.setdefault((f"w{a}", f"w{b}"), [0] * 4), least < min(df[a], df[b])
                    e[:] = [x + y for x, y in zip(e, (1, vote, rooted, rooted * vote))]
    pairs = rivals(places)
    got = {(r.a, r.b): [r.s, r.v, r.rooted, r.rooted_v] for r in evidence(places, pairs).collect()}
    assert {r.a: r.votes for r in voters(places).collect()} == votes
    assert got.keys() >= {p for p, e in want.items() if e[1] / votes[p[0]] >= ALIKE[1]} and len(got) < len(want)
    assert all(e == want[p] for p, e in got.items())
