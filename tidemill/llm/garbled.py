"""Text that was decoded with another encoding than it was written in.

A word is a maximal run of ASCII letters and of characters outside ASCII that holds at least
one of the latter; its runs are the stretches outside ASCII. Every distinct clean word and run of the
corpus is garbled under all chains of encodings below; the forms are hash-joined with the distinct tokens
of the corpus, and a match is accepted when the original is clearly the more frequent one or the form
could not be a word of its own. The documents' tokens are then joined with the accepted table, and the
originals are put in their place.

Three kinds of damage leave no form of a corpus word, so the table cannot hold them; they are recognised
by what they are: a run that is valid UTF-8 when written back in one of the wrong encodings and that gives
only characters of the clean corpus (words seen only in garbled form), stretches of ASCII text read as
UTF-16, and replacement characters or C1 controls, which no correct decoding leaves behind.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

# Encodings, in the order in which equally good explanations are preferred.
WRONG_FOR_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "iso8859_15", "cp1254", "cp1257", "cp866"]
SINGLE_BYTE = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "latin-1"]
TWICE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]

#: Original at least this many times as frequent (in documents) as a form that might be a word of its own.
RATIO = 5
#: A character belongs to the clean alphabet when runs without damage use it in at least so many documents.
MIN_ALPHABET_DOCS = 3
#: Distinct tokens (some hundred bytes each) up to which a token table is broadcast.
BROADCAST_TOKENS = 60_000

SPACES = "\u00a0  -‏ -  ⁠　﻿"
EDGES = " ­​﻿"
WORD = re.compile(rf"(?<![A-Za-z])[A-Za-z]*[^\x00-\x7f{SPACES}][^\x00-@\[-`{{-\x7f{SPACES}]*")
RUN = re.compile(rf"[^\x00-\x7f{SPACES}]+")
ENTITY = re.compile(r"&#(?:\d{2,7}|[xX][0-9a-fA-F]{2,6});")
CONTROL = re.compile("[\x80-\x9f]")
STRETCH = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f\n]| (?=[^\x00-\x7f]))*")


def code_page(name: str) -> tuple[dict[int, int], dict[int, str]]:
    """Code points to bytes and bytes to characters; in the Windows and ISO encodings undefined positions are the C1 controls, as lenient decoders have them."""
    read = {}
    for b in range(128, 256):
        ch = bytes([b]).decode(name, "ignore") or (chr(b) if name.startswith(("cp125", "iso")) else "")
        if ch:
            read[b] = ch
    write = {i: 0xFFFF for i in range(128, 256)}  # not in the encoding: fails on the way to bytes
    write |= {ord(ch): b for b, ch in read.items()}
    return write, {b: read.get(b, "\ufffd") for b in range(128, 256)}


PAGES = {name: code_page(name) for name in dict.fromkeys([*WRONG_FOR_UTF8, *SINGLE_BYTE])}


def encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "replace")
    try:
        return text.translate(PAGES[name][0]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decode(data: bytes, name: str) -> str:
    return data.decode("utf-8", "replace") if name == "utf-8" else data.decode("latin-1").translate(PAGES[name][1])


def all_chains() -> tuple[tuple[tuple[str, str], ...], ...]:
    """All chains: each step is (encoding the text was written in, encoding it was read in)."""
    once = [(("utf-8", w),) for w in WRONG_FOR_UTF8]
    single = [((a, b),) for a, b in product(SINGLE_BYTE, SINGLE_BYTE) if a != b and not {a, b} <= {"cp1252", "latin-1"}]
    twice = [(("utf-8", a), ("utf-8", b)) for a, b in product(TWICE, TWICE)]
    thrice = [(("utf-8", "cp1252"),) * 3]
    lost = [((a, "utf-8"),) for a in ("cp1252", "mac_roman", "cp850")]
    return tuple([*once, *twice, *thrice, *lost, *single])


CHAINS = all_chains()
#: Added to the number of a chain whose C1 controls were dropped afterwards; OWN marks a run restored by itself.
LOST, OWN = 1000, -1


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in chain:
        data = encode(word, written)
        if data is None:
            return None
        word = decode(data, read)
    return word


def forms(word: str, is_run: bool) -> dict[str, list[int]]:
    """Garbled form to the chains that give it, by number; plus LOST with the controls dropped, as many tools do."""
    out: dict[str, list[int]] = {}
    for number, chain in enumerate(CHAINS):
        if is_run and chain[0][0] != "utf-8":
            continue  # one character for one: only whole words tell
        form = garble(word, chain)
        if form is None or form == word:
            continue
        bare = CONTROL.sub("", form)
        for f, how in ((form, number), (bare, number + LOST)) if bare != form else ((form, number),):
            f = f.strip(EDGES)
            if is_run and len(f) < 2:
                continue
            if f and f != word and (RUN if is_run else WORD).fullmatch(f):
                out.setdefault(f, []).append(how)
    return out


def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0] if ch.isalpha() else ""


def strange(token: str) -> bool:
    """Whether the token could hardly be a word: damage, symbols between letters, letters of several alphabets, or capitals after small letters."""
    if "�" in token or CONTROL.search(token):
        return True
    scripts = {s for s in map(script, token) if s in ("LATIN", "GREEK", "CYRILLIC")}
    if len(scripts) > 1:
        return True
    odd = [i for i, c in enumerate(token) if not c.isalnum() and c not in "\u2019\u2018\u00b7"]
    if any(0 < i < len(token) - 1 and token[i - 1].isalpha() and token[i + 1].isalpha() for i in odd):
        return True
    return any(a.islower() and b.isupper() and (b > "\x7f" or a > "\x7f") for a, b in zip(token, token[1:]))


def restored_run(run: str) -> str | None:
    """The text whose UTF-8 was read in a wrong encoding once to three times, if the run is such."""
    best, now = None, run
    for _ in range(3):
        for name in WRONG_FOR_UTF8:
            data = encode(now, name)
            if data is None or len(data) < 2:
                continue
            try:
                back = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(back) < len(now):
                best = now = back
                break
        else:
            break
    return best


def broken_run(run: str) -> bool:
    """Whether a longer run is UTF-8 read in a wrong encoding of which some bytes are gone."""
    for name in WRONG_FOR_UTF8 if len(run) >= 6 else ():
        data = encode(run, name)
        if data is not None:
            back = data.decode("utf-8", "replace")
            if back.count("\ufffd") * 3 <= len(back) < 0.8 * len(run):
                return True
    return False


def from_utf16(stretch: str) -> str | None:
    """The mostly ASCII text whose bytes, taken in pairs, gave these characters."""
    if len(stretch) < 4:
        return None
    for written, read in (("utf-16-le", "utf-8"), ("utf-16-be", "utf-8"), ("utf-16-be", "utf-16-le")):
        back = stretch.encode(written, "replace").decode(read, "replace")
        if sum(c.isascii() and (c.isalnum() or c in " \n\r.,;:-_'()") for c in back) >= 0.93 * len(back):
            return back
    return None


def plain(text: str) -> str:
    """The text with numeric character references resolved, since damage may hide in them."""
    return ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&#" in text else text


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and runs of each document, and its damage that needs no table."""
    for batch in batches:
        docs, token, is_run = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = plain(text)
            words = set(WORD.findall(text))
            runs = {r for w in words for r in RUN.findall(w)}
            docs += [doc] * (len(words) + len(runs))
            token += [*words, *runs]
            is_run += [False] * len(words) + [True] * len(runs)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(token, pa.string()), pa.array(is_run, pa.bool_())], names=["doc_id", "token", "is_run"])


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each distinct token: whether it is strange, and what it restores to if it shows its own damage."""
    for batch in batches:
        odd, back = [], []
        for t, run in zip(batch.column("token").to_pylist(), batch.column("is_run").to_pylist()):
            odd.append(strange(t))
            runs = [t] if run else RUN.findall(t)
            found = [restored_run(r) or ("" if broken_run(r) else None) for r in runs]
            back.append(next((f for f in found if f is not None), None))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.bool_()), pa.array(back, pa.string())], names=[*batch.schema.names, "odd", "back"])


def garbled_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = [
                (form, run, word, numbers, df)
                for word, run, df in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in ("token", "is_run", "df")))
                for form, numbers in forms(word, run).items()
            ]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int16()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["token", "is_run", "original", "chains", "df"])


def is_weak(token: str, odd: bool, numbers: list[int]) -> bool:
    """A single character that would be a word of its own says nothing alone."""
    return len(token) == 1 and not odd and all(n != OWN and CHAINS[n % LOST][0][0] != "utf-8" for n in numbers)


def choose(entries: list[dict]) -> dict[str, str | None]:
    """The original of each known token of one document; the chain that explains most of its tokens wins, and weak tokens need a second one of their chain."""
    votes = Counter(n for e in entries for n in {n for o in e["options"] for n in o["chains"]})
    known: dict[str, str | None] = {}
    for e in entries:
        support = [max(votes[n] for n in o["chains"]) for o in e["options"]]
        most = max(support)
        best = max((o for o, v in zip(e["options"], support) if v == most), key=lambda o: (o["df"], o["original"] or ""))
        if most < 2 and is_weak(e["token"], e["odd"], best["chains"]):
            continue
        rivals = {o["original"] for o, v in zip(e["options"], support) if v == most}
        lost = best["original"] is None or ("\ufffd" in e["token"] and len(rivals) > 1)
        known[("\n" if e["is_run"] else "") + e["token"]] = None if lost else best["original"]
    return known


def restore(text: str, known: dict[str, str | None]) -> tuple[str, int, int]:
    """The text with originals in place, the number of stretches put right and of those that could not be."""
    right, wrong = 0, 0

    def word(m: re.Match) -> str:
        nonlocal right, wrong
        if m[0] in known:
            new = known[m[0]]
        elif any("\n" + r in known for r in RUN.findall(m[0])):
            new = RUN.sub(lambda r: known.get("\n" + r[0]) or r[0], m[0])
            new = None if new == m[0] else new
        else:
            wrong += bool("\ufffd" in m[0] or CONTROL.search(m[0]))
            return m[0]
        right, wrong = right + (new is not None), wrong + (new is None)
        return m[0] if new is None else new

    def stretch(m: re.Match) -> str:
        nonlocal right
        back = from_utf16(m[0])
        right += back is not None
        return m[0] if back is None else back

    text = plain(text)
    text = STRETCH.sub(stretch, text)
    return WORD.sub(word, text), right, wrong


def substitute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts, rights, wrongs = [], [], [], []
        for doc, text, entries in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "known"))):
            new, right, wrong = restore(text, choose(entries or []))
            if right or wrong:
                docs.append(doc)
                texts.append(new)
                rights.append(right)
                wrongs.append(wrong)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((docs, texts, rights, wrongs), kinds)], names=["doc_id", "restored_text", "n_restored", "n_lost"])


def garbled_documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with text decoded wrongly, as (doc_id, restored_text, n_restored, n_lost).

    ``restored_text`` has the originals of the ``n_restored`` stretches in place; ``n_lost`` stretches are
    damaged and stay as they are. Numeric character references are resolved first. Null, empty and pure
    ASCII texts are never damaged. Repeated rows of an id are judged each for itself with the tokens of
    all of them. Word frequencies are counted over the whole corpus.
    """
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = source.where((F.octet_length("text") > F.char_length("text")) | F.contains("text", F.lit("&#")))
    seen = rows.mapInArrow(tokens, "doc_id long, token string, is_run boolean")
    counted = seen.groupBy("token", "is_run").agg(F.count(F.lit(1)).alias("df"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = cut(counted.repartition(parts).mapInArrow(judge, "token string, is_run boolean, df long, odd boolean, back string"))
    table = accepted(judged)
    small = table.count() <= BROADCAST_TOKENS
    known = seen.join(F.broadcast(table) if small else table, ["token", "is_run"]).groupBy("doc_id").agg(F.collect_list(F.struct("token", "is_run", "odd", "options")).alias("known"))
    # besides the documents with known tokens only those that show damage of their own go on to the last step
    marked = rows.withColumn("suspect", F.rlike("text", F.lit("[\u0080-\u009f�]")) | F.rlike("text", F.lit(r"[^\x00-\x7f─-╿]{4}")))
    joined = marked.join(known, "doc_id", "left").where(F.col("suspect") | F.col("known").isNotNull()).select("doc_id", "text", "known")
    return joined.mapInArrow(substitute, "doc_id long, restored_text string, n_restored int, n_lost int")


def accepted(judged: DataFrame) -> DataFrame:
    """Tokens taken for garbled with what they may stand for, as (token, is_run, odd, options of (original, df, chains))."""
    clean = judged.where(~F.col("odd") & F.col("back").isNull())
    parts = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = clean.select("token", "is_run", "df").repartition(parts).mapInArrow(garbled_forms, "token string, is_run boolean, original string, chains array<short>, df long")
    few = judged.count() <= BROADCAST_TOKENS
    here = judged.select("token", "is_run", F.col("df").alias("own_df"), "odd")
    matches = made.join(F.broadcast(here) if few else here, ["token", "is_run"])
    enough = F.col("odd") | (F.col("df") >= RATIO * F.col("own_df"))  # a strange token is no word, however frequent
    from_table = matches.where(enough).select("token", "is_run", "odd", "original", "df", "chains")
    # a restored run must consist of characters of clean runs
    letters = clean.where("is_run").select("df", F.explode(F.array_distinct(F.split("token", ""))).alias("ch")).groupBy("ch").agg(F.sum("df").alias("n")).where(F.col("n") >= MIN_ALPHABET_DOCS)
    own = judged.where(F.col("is_run") & F.col("back").isNotNull())
    spelled = own.select("token", F.explode(F.array_distinct(F.split("back", ""))).alias("ch")).where("ch > '\u007f'")
    unknown = spelled.join(letters, "ch", "left_anti").select("token").distinct()
    by_itself = own.join(unknown, "token", "left_anti").select("token", "is_run", "odd", F.nullif("back", F.lit("")).alias("original"), F.lit(0).cast("long").alias("df"), F.array(F.lit(OWN).cast("short")).alias("chains"))
    return cut(from_table.unionByName(by_itself).groupBy("token", "is_run", "odd").agg(F.collect_list(F.struct("original", "df", "chains")).alias("options")))
