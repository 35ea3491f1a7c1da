"""Variant spellings of the names of persons and organisations, by noisy-channel attribution.

A name is the set of its words, so reordered parts are no difference. Which words carry identity, which are
given names, lines of business or legal forms is not listed anywhere: all that is needed comes from the
corpus. Two names of a workspace that are equal but for one word give evidence about that pair of words. A
word stands for another when the two fill the same place in names much more often than chance (a relative or
a sister company fills the place of many others, a nickname that of one), or once where the two also look
like a typing error or an abbreviation. How often a word is left out is counted for each word.

The channel then goes from a name to its spellings, in the order in which they are undone:

1. a word becomes a variant (nickname, abbreviation, typing error), by the learned pairs, by one typing
   error of a much more frequent word, or by one of a word of the same workspace;
2. words are left out, each with its own probability;
3. one word is cut to its initial, or all but one to initials or an acronym.

Every frequent or complete name is a candidate; it gives all spellings that steps 2 and 3 can make of it, with
their likelihoods, and each spelling is attached to the candidate of the highest posterior (frequency times
likelihood) by a join on the spelling. No two names are compared with each other, so a name of any
frequency costs no more than its own rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

# Given names with their common short forms (English, Portuguese, Spanish, German).
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony ant", "antonio": "toninho tonho toni tonio", "barbara": "babs barb",
    "benjamin": "ben benny benni", "carlos": "carlinhos kaka", "charles": "charlie chuck", "charlotte": "lottie charlie lotte", "christopher": "chris kit", "daniel": "dan danny", "daniela": "dani ela",
    "david": "dave davy", "dorothy": "dot dolly", "edward": "ed eddie ted ned", "eduardo": "dudu edu duda", "elizabeth": "liz lizzie beth betty eliza", "fernanda": "nanda fer fe", "fernando": "nando fer",
    "francisco": "chico paco pancho kiko", "frederick": "fred freddie", "friedrich": "fritz fiete", "gabriel": "gabo gabe", "gabriela": "gabi gaby", "george": "georgie", "guilherme": "gui guiga", "guillermo": "memo guille",
    "helen": "nell nellie", "henrique": "rique ique henri", "henry": "harry hank", "isabella": "bella isa izzy", "isabel": "isa bel", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hans hannes jo",
    "john": "jack johnny", "jose": "ze pepe zeca", "joseph": "joe joey", "katherine": "kate kathy kat katie kit", "lawrence": "larry", "leonardo": "leo nardo", "ludwig": "lutz wiggerl", "manuel": "manolo manny",
    "margaret": "maggie peggy meg greta", "maria": "mia mariazinha", "matthew": "matt", "michael": "mike mick micky", "nicolas": "nico nicky colas", "olivia": "liv livia livvy", "patricia": "pati pat patty trish tricia",
    "peter": "pete", "quentin": "quent quin", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve", "susanne": "susi sanne suse", "theodore": "ted theo",
    "thomas": "tom tommy", "ursula": "uschi ulla ursel", "victoria": "tori vicky vic", "wilhelm": "willi willy", "william": "will bill billy liam", "ximena": "xime mena", "yolanda": "yoli yola landa", "zachary": "zach zack zac",
}
SHORT_FORMS = {(short, full) for full, shorts in NICKNAMES.items() for short in shorts.split()}

#: Words shorter than this are never taken for typing errors of each other.
MIN_TYPO = 4
#: Longer words are matched by halves, one of which an error leaves as it is.
HALVES_FROM = 64
#: A word this many times as frequent takes in its typing errors wherever they are.
FREQUENT = 20
#: Other words in a place from which on each has less than a vote there, and all together the fewer the more there are.
CROWD = 7
#: A vote in whole units, so that sums do not depend on their order.
VOTE = 1 << 30
#: Evidence for a pair that looks like an error or abbreviation: share of the word's names, and of the votes of its places.
ALIKE = (0.1, 0.2)
#: Share of its names for a word of up to three letters that is no beginning of the other, since it may be an acronym too.
LETTERS = 0.3
#: The same two shares for a pair that does not look alike, and the places needed.
UNLIKE = (0.25, 0.5, 3)
#: Left out of more than this share of its names, a word tells nothing about any.
FILLER = 0.5
#: Further words that are left out together with one; each makes it less likely by this.
TOGETHER = 0.7
#: Ways to leave out words that are less likely than this are not expected.
LEAST = 0.01
#: Likelihood of an initial or acronym for the words it stands for.
INITIAL = 0.05
#: Copies of a small table that a frequent word's rows are spread over.
SALTS = 8


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours, or none, turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def fold(name: str) -> str:
    """Small letters without accents; words written together are taken apart, remarks in brackets or behind a dash dropped."""
    name = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ]{2})", " ", name)
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("ı", "i")
    bare = re.sub(r"\([^)]*\)|\s[-–—]\s.*$", " ", name)
    return re.sub(r"['’`]", "", (bare if bare.strip() else name).replace("_", " ").replace("&", " and "))


def words(name: str) -> list[str]:
    """The distinct words in order of the alphabet; letters with dots between them are one word."""
    folded = re.sub(r"(?<![^\W_])((?:[^\W\d_]\.)+[^\W\d_])(?![^\W_])\.?", lambda m: f" {m[1].replace('.', '')} ", fold(name))
    found = sorted(set(re.findall(r"[^\s,;:/\-–—.()\"]+", folded)))
    return found or [re.sub(r"\s+", "", name)]


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ws"), pa.array([" ".join(words(n)) for n in batch.column("name").to_pylist()], pa.string())], names=["id", "ws", "spelling"])


def abbreviates(short: str, full: str) -> bool:
    """Whether ``short`` keeps the first letter and some later ones of ``full`` in order, or differs from its start by an ending."""
    if short[0] != full[0] or len(short) > len(full):
        return False
    rest = iter(full)
    if all(c in rest for c in short):
        return True
    same = next((i for i, (a, b) in enumerate(zip(short, full)) if a != b), len(short))
    return same >= 5 and len(short) - same <= 2 and len(full) - same <= 4


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the word ``a`` looks like a spelling of ``b``, or is a known short form of it."""
    for batch in batches:
        out = [(a, b) in SHORT_FORMS or (min(len(a), len(b)) >= MIN_TYPO and near(a, b)) or abbreviates(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "alike"])


def spread_join(left: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the row of ``small`` for its key; rows of a frequent key are dealt out over SALTS copies of that row."""
    salted = small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")


def forms_of(spellings: DataFrame) -> DataFrame:
    """(ws, form, n): the distinct names as they are read so far, with the nodes that bear them."""
    return spellings.groupBy("ws", "form").agg(F.sum("n").alias("n"))


def by_word(forms: DataFrame) -> DataFrame:
    return forms.withColumn("w", F.explode(F.split("form", " ")))


def kind_of(word: str | Column) -> Column:
    """What words are counted as: each for itself, but all initials together."""
    w = F.col(word) if isinstance(word, str) else word
    return F.when(F.char_length(w) == 1, F.lit("")).otherwise(w)


def with_counts(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ws, form, n, words of (w, df)), how often each word occurs in the corpus; and the counts as (kind, df)."""
    each = by_word(forms).withColumn("kind", kind_of("w"))
    counts = each.groupBy("kind").agg(F.count(F.lit(1)).alias("df"))
    rows = spread_join(each, counts, ["kind"], "inner").groupBy("ws", "form").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("w", "df"))).alias("words"))
    return rows, counts


def shared_places(places: DataFrame) -> DataFrame:
    """The (place, w, df, least) of more than one word, with the number ``rivals`` of the others there and the ``vote`` for each of them."""
    others = places.groupBy("place").agg((F.count(F.lit(1)) - 1).alias("rivals")).where("rivals > 0")
    vote = F.round(VOTE * F.pow(F.least(F.lit(1.0), CROWD / F.col("rivals")), F.lit(2))).cast("long")
    return cut(places.join(others, "place").select("place", "w.w", "w.df", "least", "rivals", vote.alias("vote")))


def voters(places: DataFrame) -> DataFrame:
    """(a, votes, far): all votes of the places of each word, and what those too full to make a pair by themselves give one other word at most."""
    return places.groupBy(F.col("w").alias("a")).agg(F.sum(F.col("rivals") * F.col("vote")).alias("votes"), F.sum(F.when(F.col("rivals") * ALIKE[1] > 1, F.col("vote")).otherwise(0)).alias("far"))


def rivals(places: DataFrame) -> DataFrame:
    """All pairs (a, b) of different words for which b may have the share ALIKE of the votes of the places of a.

    Where there are more than 1 / ALIKE rivals each has less than that share. So b must also be met in a place
    with fewer, and have enough votes there to reach it with all that the fuller places could give it. That is
    a thirtieth of all votes at least (a fifth less the sixth that fuller places can give), so no word has more
    than 30 such partners, and pairs are made in places of few words only.
    """
    few = places.where(F.col("rivals") * ALIKE[1] <= 1).groupBy("place").agg(F.collect_list("w").alias("all"), F.first("vote").alias("vote"))
    pairs = few.select("vote", "all", F.explode("all").alias("a")).select("vote", "a", F.explode("all").alias("b")).where("a <> b")
    met = pairs.groupBy("a", "b").agg(F.sum("vote").alias("v")).join(voters(places), "a")
    return met.where((F.col("v") + F.col("far")) / F.col("votes") >= ALIKE[1]).select("a", "b")


def evidence(places: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair (a, b) the number ``s`` of all places the two share and their votes ``v``, and both for the places with a word rarer than a and b."""
    own = spread_join(places.select("place", F.col("w").alias("a"), F.col("df").alias("da"), "least", "vote"), pairs.select("a", "b"), ["a"], "inner")
    both = own.join(places.select("place", F.col("w").alias("b"), F.col("df").alias("db")), ["place", "b"])
    rooted = (F.col("least") < F.col("da")) & (F.col("least") < F.col("db"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"), F.sum("vote").alias("v"), F.count_if(rooted).alias("rooted"), F.sum(F.when(rooted, F.col("vote")).otherwise(0)).alias("rooted_v"))


def learned_variants(forms: DataFrame) -> DataFrame:
    """(w, to): words that stand for another one, by the places the two share.

    A place is the rest of a name without its initials or, for words with the same first letter, the rarest
    word of a name. The more words fill a place, the less it tells about any two of them, and the less it counts.
    Pairs that do not look alike are learned only from places with a word rarer than both.
    """
    names = with_counts(forms)[0]
    each = cut(names.select("ws", "form", "n", "words", F.explode("words").alias("w")).where(F.char_length("w.w") > 1))
    others = F.filter("words", lambda x: (x["w"] != F.col("w.w")) & (F.char_length(x["w"]) > 1))  # initials tell nothing about the other words
    rest = each.where(F.size(others) > 0).select(F.xxhash64("ws", F.transform(others, lambda x: x["w"])).alias("place"), "w", F.array_min(F.transform(others, lambda x: x["df"])).alias("least")).distinct()
    root = F.array_min(F.transform(F.filter(others, lambda x: F.char_length(x["w"]) >= MIN_TYPO), lambda x: F.struct(x["df"], -F.char_length(x["w"]), x["w"])))
    rooted = each.withColumn("root", root).where(F.col("root").isNotNull() & (F.col("root.df") <= F.col("w.df")))
    initial = rooted.select(F.xxhash64("ws", "root.w", F.substring("w.w", 1, 1)).alias("place"), "w", F.col("root.df").alias("least")).distinct()
    counts = each.groupBy("w.w").agg(F.first("w.df").alias("df"), F.sum("n").alias("m"))
    rest, initial = shared_places(rest), shared_places(initial)
    of = lambda x: counts.select(F.col("w").alias(x), F.col("df").alias(f"d{x}"), F.col("m").alias(f"m{x}"))
    rank = lambda x: F.struct(F.col(f"m{x}"), F.char_length(x), F.col(x))
    toward = cut(rivals(rest).union(rivals(initial)).distinct().join(of("a"), "a").join(of("b"), "b").where(rank("b") > rank("a")).select("a", "b", "da", "mb"))
    all_ = lambda places, x: voters(places).select("a", F.col("votes").alias(x))
    pairs = toward.join(evidence(rest, toward), ["a", "b"], "left").join(evidence(initial, toward).select("a", "b", F.col("s").alias("t"), F.col("v").alias("u")), ["a", "b"], "left")
    pairs = pairs.join(all_(rest, "all_v"), "a", "left").join(all_(initial, "all_u"), "a", "left").na.fill(0, ["s", "v", "t", "u", "rooted", "rooted_v"])
    columns = ["da", "mb", "s", "v", "t", "u", "rooted", "rooted_v", "all_v", "all_u"]
    judged = pairs.select("a", "b", *columns).mapInArrow(alike, f"a string, b string, {', '.join(f'{c} long' for c in columns)}, alike boolean")
    share = lambda c, d: F.try_divide(F.col(c), F.col(d))
    seen = lambda s, v: F.coalesce((share(s, "da") >= ALIKE[0]) & (share(v, f"all_{v}") >= ALIKE[1]), F.lit(False))
    unlike = (share("rooted", "da") >= UNLIKE[0]) & (share("rooted_v", "all_v") >= UNLIKE[1]) & (F.col("rooted") >= UNLIKE[2])
    letters = (F.char_length("a") <= 3) & ~F.startswith("b", "a")
    sure = F.when(F.col("alike") & letters, seen("s", "v") & (share("s", "da") >= LETTERS)).when(F.col("alike"), seen("s", "v") | seen("t", "u")).otherwise(F.coalesce(unlike, F.lit(False)))
    best = judged.where(sure).groupBy("a").agg(F.max_by("b", F.struct("alike", F.greatest("s", "t"), "mb", "b")).alias("to")).select(F.col("a").alias("w"), "to")
    return followed(best, ["w"])


def fillers(forms: DataFrame) -> DataFrame:
    """(w, to), with an empty ``to``: words without which most of the names that have them stand as well (titles, roles)."""
    each = by_word(forms).where(F.char_length("w") > 1)
    rest = F.array_join(F.array_remove(F.split("form", " "), F.col("w")), " ")
    there = each.select("ws", rest.alias("form"), "w").join(forms.select("ws", "form", F.lit(1).alias("there")), ["ws", "form"], "left")
    rates = there.groupBy("w").agg(((F.coalesce(F.sum("there"), F.lit(0)) + 0.5) / (F.count(F.lit(1)) + 2)).alias("rate"))
    return rates.where(F.col("rate") > FILLER).select("w", F.lit("").alias("to"))


def followed(step: DataFrame, keys: list[str], rounds: int = 2) -> DataFrame:
    """(keys, to) with the steps followed from one to the next; each leads to a larger word, so they end."""
    step = cut(step)
    own = [k for k in keys if k != "w"]
    for _ in range(rounds):
        on = step.select(*own, F.col("w").alias("to"), F.col("to").alias("then"))
        step = step.join(on, [*own, "to"], "left").select(*own, "w", F.coalesce("then", "to").alias("to"))
    return step


def typo_keys(word: str | Column) -> Column:
    """Keys of which two words of a length share one exactly if they may be one typing error apart."""
    w = F.col(word) if isinstance(word, str) else word
    n = F.char_length(w)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
    halves = F.flatten(F.transform(F.array(F.floor(n / 2) - 1, F.floor((n + 1) / 2) - 1), lambda h: F.array(F.concat(F.lit("<"), F.substring(w, F.lit(1), h.cast("int"))), F.concat(F.lit(">"), F.substring(w, n - h.cast("int") + 1, n)))))
    return F.array_distinct(F.when(n >= HALVES_FROM, halves).otherwise(F.array_append(less, w)))


def one_error(a: str, b: str) -> Column:
    apart = F.levenshtein(a, b, 2)
    swap = (F.char_length(a) == F.char_length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return apart.between(0, 1) | ((apart == 2) & swap)


def errors_of_frequent(forms: DataFrame) -> DataFrame:
    """(w, to): words one typing error from a word that is FREQUENT times as frequent in the corpus."""
    counts = by_word(forms).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(F.char_length("w") > MIN_TYPO)
    hashed = lambda: F.explode(F.transform(typo_keys("w"), lambda k: F.xxhash64(k))).alias("key")
    target = counts.where(F.col("df") >= FREQUENT).select(F.col("w").alias("to"), F.col("df").alias("m"), hashed())
    source = counts.select("w", "df", hashed())
    close = source.join(target, "key").where((F.col("m") >= FREQUENT * F.col("df")) & one_error("w", "to"))
    return close.groupBy("w").agg(F.max_by("to", F.struct("m", "to")).alias("to"))


def errors_in_workspace(forms: DataFrame) -> DataFrame:
    """(ws, w, to): words one typing error from a more frequent word of their workspace, as often there as they are anywhere."""
    each = by_word(forms).where(F.char_length("w") >= MIN_TYPO)
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    local = spread_join(each.groupBy("ws", "w").agg(F.sum("n").alias("n")), counts, ["w"], "inner").select("ws", "w", "n", "df")
    # a key holds the words that one deletion leads to, at most some letters' worth for each of its places
    keyed = local.select(F.struct("ws", "w", "n", "df").alias("x"), F.explode(F.transform(typo_keys("w"), lambda k: F.xxhash64("ws", k))).alias("key"))
    shared = keyed.groupBy("key").agg(F.collect_list("x").alias("all")).where(F.size("all") > 1)
    pairs = shared.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.ws = b.ws and a.w <> b.w and a.df <= b.n and (b.n > a.n or (b.n = a.n and b.w < a.w))")
    close = pairs.select("a.ws", "a.w", F.col("b.w").alias("to"), F.col("b.n").alias("m")).where(one_error("w", "to"))
    return followed(close.groupBy("ws", "w").agg(F.max_by("to", F.struct("m", "to")).alias("to")), ["ws", "w"])


def respelled(spellings: DataFrame, *variants: tuple[DataFrame, list[str]]) -> DataFrame:
    """The spellings with all words replaced that one of ``variants``, (keys, to) with its keys, knows; the first that does."""
    put = spellings.withColumn("w", F.explode(F.split("form", " ")))
    for n, (known, keys) in enumerate(variants):
        put = spread_join(put, known.withColumnRenamed("to", f"to{n}"), keys)
    new = F.coalesce(*[f"to{n}" for n in range(len(variants))], "w")
    made = put.groupBy("ws", "spelling").agg(F.first("n").alias("n"), F.array_join(F.array_remove(F.array_sort(F.collect_set(new)), ""), " ").alias("form"), F.first("form").alias("was"))
    return cut(made.select("ws", "spelling", "n", F.when(F.col("form") == "", F.col("was")).otherwise(F.col("form")).alias("form")))


def rarest(parts: list[dict]) -> str:
    """The word that carries the identity: the rarest of four letters or more, then the longest."""
    return min(parts, key=lambda p: (len(p["w"]) < 4, p["df"], -len(p["w"]), p["w"]))["w"]


def initials_key(kept: list[str], letters: list[str]) -> str:
    return f"{' '.join(sorted(kept))} @{''.join(sorted(''.join(letters)))}"


def spellings_of(parts: list[dict]) -> dict[str, list[str]]:
    """What steps 2 and 3 of the channel make of a name, with the words left out.

    All words but the rarest may be left out in any way, and that one alone, since it may be a slip; of names
    of more than six words at most two are, or at most two stay beside the rarest.
    """
    root, every = rarest(parts), [p["w"] for p in parts]
    others = [w for w in every if w != root]
    out: dict[str, list[str]] = {}

    def put(key: str, gone: list[str]) -> None:
        if key not in out or len(gone) < len(out[key]):
            out[key] = gone

    m = len(others)
    for n in range(m + 1) if m <= 5 else sorted({0, 1, 2, m - 2, m - 1, m}):
        for gone in combinations(others, n):
            kept = [w for w in every if w not in gone]
            if gone and (len(kept) == 1 or any(len(w) > 1 for w in kept if w != root)):  # initials do not stay without the words they go with
                put(" ".join(kept), list(gone))
            if m <= 3 or not gone:  # one word cut to its initial
                for w in kept:
                    if len(w) > 1 and (w != root or m):
                        put(initials_key([v for v in kept if v != w and len(v) > 1], [w[0], *(v for v in kept if len(v) == 1)]), list(gone))
    if any(len(w) > 1 for w in others):
        put(" ".join(others), [root])
    # all but one as initials; short words (and, of) may be missing in an acronym
    for own in every:
        must, may = [w[0] for w in every if len(w) > 3 and w != own], [w[0] for w in every if len(w) <= 3 and w != own]
        for n in range(len(may) + 1 if must and len(own) >= MIN_TYPO and len(may) <= 5 else 0):
            for some in combinations(may, n):
                put(initials_key([own], [*must, *some]), [])
    return out


def asked(parts: list[dict]) -> list[str]:
    """The keys under which a name may be the spelling of another: itself, and what its initials or its acronym stand for."""
    own = [p["w"] for p in parts]
    letters, kept = [w for w in own if len(w) == 1], [w for w in own if len(w) > 1]
    keys = [" ".join(own)]
    if letters and kept:
        keys.append(initials_key(kept, letters))
    if len(kept) > 1:  # a short word may be an acronym
        keys += [initials_key([w for w in kept if w != p], [*letters, p]) for p in kept if 2 <= len(p) <= 5]
    return keys


def key_of(ws: str, key: str) -> int:
    return xxhash.xxh64_intdigest(f"{ws}\0{key}") - (1 << 63)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, size, asks): hashes of the spellings a name gives, and of those it asks for."""
    for batch in batches:
        keys, names, sizes, asks = [], [], [], []
        for ws, form, name, parts in zip(*(batch.column(c).to_pylist() for c in ("ws", "form", "name", "words"))):
            given, wanted = spellings_of(parts), asked(parts)
            keys += [key_of(ws, k) for k in (*given, *wanted)]
            names += [name] * (len(given) + len(wanted))
            sizes += [len(form) + sum(len(p["w"]) > 1 for p in parts)] * (len(given) + len(wanted))
            asks += [False] * len(given) + [True] * len(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(asks, pa.bool_())], names=["key", "name", "size", "asks"])


def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair that met, how the name ``head`` becomes the spelling ``form``: the words left out, and whether others were cut to initials."""
    for batch in batches:
        rows = []
        for ws, form, words_, head, n, parts in zip(*(batch.column(c).to_pylist() for c in ("ws", "form", "words", "head", "n", "head_words"))):
            made = spellings_of(parts)
            rows += [(ws, form, head, n, made[k], "@" in k) for k in asked(words_) if k in made]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["ws", "form", "head", "n", "gone", "short"])


def left_out_rates(met: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, rate): in what share of the names with a word there is a spelling of the name without it."""
    seen = met.where("not short").select("ws", "head", F.explode("gone").alias("w")).distinct()
    lost = seen.groupBy(kind_of("w").alias("kind")).agg(F.count(F.lit(1)).alias("lost"))
    return counts.join(lost, "kind", "left").select("kind", ((F.coalesce("lost", F.lit(0)) + 0.5) / (F.col("df") + 2)).alias("rate"))


def attached(forms: DataFrame) -> DataFrame:
    """(ws, form, head): each name with the candidate it is attached to, over all steps, or itself."""
    names, counts = with_counts(forms)
    names = cut(names.withColumn("name", F.xxhash64("ws", "form")))
    rows = cut(names.mapInArrow(candidates, "key long, name long, size int, asks boolean"))
    gives, wants = rows.where("not asks").select("key", F.col("name").alias("head"), "size"), rows.where("asks").select("key", "name", F.col("size").alias("own"))
    pairs = wants.join(gives, "key").where((F.col("head") != F.col("name")) & (F.col("size") > F.col("own"))).select("name", "head").distinct()
    heads = names.select(F.col("name").alias("head"), F.col("form").alias("head_form"), F.col("n").alias("head_n"), F.col("words").alias("head_words"))
    both = pairs.join(names, "name").join(heads, "head").select("ws", "form", "words", F.col("head_form").alias("head"), F.col("head_n").alias("n"), "head_words")
    met = cut(both.mapInArrow(explained, "ws string, form string, head string, n long, gone array<string>, short boolean").withColumn("size", F.char_length("head")))
    # words are left out together (a whole legal form), so the least likely one counts in full and each other little
    lost = met.withColumn("w", F.explode_outer("gone")).withColumn("kind", kind_of("w"))
    rated = spread_join(lost, left_out_rates(met, counts), ["kind"]).groupBy("ws", "form", "head", "short", "gone").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.coalesce(F.min("rate"), F.lit(1.0)).alias("rate"), F.size("gone").alias("lost"))
    likelihood = F.col("rate") * F.pow(F.lit(TOGETHER), F.greatest(F.col("lost") - 1, F.lit(0)))
    cut_short = F.when(F.col("short"), INITIAL).otherwise(1.0)
    best = rated.withColumn("p", likelihood).where(F.col("p") >= LEAST).groupBy("ws", "form").agg(F.max(F.struct((F.col("n") * F.col("p") * cut_short).alias("score"), "size", "head")).alias("b"))
    step = cut(best.select("ws", "form", F.col("b.head").alias("head")))
    for _ in range(3):  # attachments only lead to longer names; eight of them one after the other are followed
        then = step.select("ws", F.col("form").alias("head"), F.col("head").alias("then"))
        step = step.join(then, ["ws", "head"], "left").select("ws", "form", F.coalesce("then", "head").alias("head"))
    return forms.select("ws", "form").join(step, ["ws", "form"], "left").select("ws", "form", F.coalesce("head", "form").alias("head"))


def read_spellings(parsed: DataFrame) -> DataFrame:
    """(ws, spelling, n, form): the distinct spellings and what is left when all variants of words are undone."""
    s = cut(parsed.groupBy("ws", "spelling").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.col("spelling")))
    forms = cut(forms_of(s))
    s = respelled(s, (errors_of_frequent(forms), ["w"]), (errors_in_workspace(forms), ["ws", "w"]))
    s = respelled(s, (learned_variants(forms_of(s)), ["w"]))
    return respelled(s, (fillers(forms_of(s)), ["w"]))


def name_entities(nodes: DataFrame, id_col: str, workspace: str, name: str, normalized: str) -> DataFrame:
    """(workspace_id, id, entity): nodes of a workspace with the same entity are spellings of one name.

    The name is read from ``name``, or from ``normalized`` where ``name`` is null or blank; nodes with
    neither, or without an id or workspace, take no part. Words of fewer than MIN_TYPO letters have no typing
    errors. Equal posteriors go to the longer, then the alphabetically last candidate. Repeated rows of an id
    are one node; one with several names gets the alphabetically first entity.
    """
    blank = F.length(F.trim(name)) == 0
    rows = nodes.select(F.col(id_col).cast("long").alias("id"), F.col(workspace).cast("string").alias("ws"), F.when(F.col(name).isNull() | blank, F.col(normalized)).otherwise(F.col(name)).alias("name"))
    rows = rows.where("id is not null and ws is not null and length(trim(name)) > 0").dropDuplicates(["id", "ws", "name"])
    parsed = cut(rows.mapInArrow(parse, "id long, ws string, spelling string"))
    read = read_spellings(parsed)
    heads = read.join(attached(cut(forms_of(read))), ["ws", "form"]).select("ws", "spelling", "head")
    linked = parsed.join(heads, ["ws", "spelling"]).groupBy("ws", "id").agg(F.min("head").alias("entity"))
    return linked.select(F.col("ws").alias("workspace_id"), "id", "entity")


def entity_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of nodes of one entity, as (id_a, id_b) with id_a < id_b."""
    a = entities.select("workspace_id", "entity", F.col("id").alias("id_a"))
    b = entities.select("workspace_id", "entity", F.col("id").alias("id_b"))
    return a.join(b, ["workspace_id", "entity"]).where("id_a < id_b").select("id_a", "id_b").distinct()
