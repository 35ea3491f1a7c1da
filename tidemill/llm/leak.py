"""Evaluation items that leak into training text.

Items and documents are normalised alike: NFKD, without combining marks and format characters, then the
maximal runs of a-z and 0-9 in lower case are the words. A passage of at least ``words`` words that an item
and a document share holds a whole block of half as many words that begins at a multiple of the block's
length in the item. These blocks go into one Aho-Corasick automaton, whose size is so in proportion to the
items; each document is normalised and scanned once, every hit is extended to the whole passage by comparing
words with the item, and passages long enough are mapped back to offsets of the stored text.

The automaton is built in each Python worker from the item texts. Items of more than ``PART_BYTES`` are
scanned in parts of that size, each with its own automaton. Documents are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Item texts in one automaton, which takes about 60 times as much memory in each Python worker.
PART_BYTES = 4 << 20
WORD = re.compile(r"[a-z0-9]+")
PLAIN = str.maketrans({chr(c): chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})


def dropped(ch: str) -> bool:
    c = unicodedata.category(ch)
    return c[0] == "M" or c == "Cf"


def fold(text: str) -> str:
    """Lower-case ASCII words between single blanks, with a blank at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if odd := {c for c in set(text) if c > "\x7f"}:
            text = text.translate({ord(c): None if dropped(c) else " " for c in odd})
    return f" {' '.join(text.translate(PLAIN).split())} "


def fold_offsets(text: str) -> list[tuple[str, int, int]]:
    """The same words with their first and last offset in the stored text; used for documents with hits only."""
    chars, places = [], []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKD", ch) if ch > "\x7f" else ch:
            if not (c > "\x7f" and dropped(c)):
                chars.append(c.lower() if c <= "\x7f" else " ")
                places.append(i)
    return [(m[0], places[m.start()], places[m.end() - 1]) for m in WORD.finditer("".join(chars))]


Block = tuple[int, str, int, int]  # item, field, number of its text, first word


class Scanner:
    """The automaton over the blocks of all items, and the words of the items to extend hits."""

    def __init__(self, items: list[tuple[int, str, str]], words: int):
        import ahocorasick

        self.words, block = words, max(1, (words + 1) // 2)
        self.texts: list[list[str]] = []
        owners: dict[str, list[Block]] = {}
        for item, field, text in items:
            w = fold(text).split()
            if len(w) >= words:
                for at in range(0, len(w) - block + 1, block):
                    owners.setdefault(f" {' '.join(w[at : at + block])} ", []).append((item, field, len(self.texts), at))
                self.texts.append(w)
        self.tree = ahocorasick.Automaton()
        for run, own in owners.items():
            self.tree.add_word(run, (len(run), own))
        if owners:
            self.tree.make_automaton()

    def passages(self, folded: str) -> dict[tuple[int, str], list[tuple[int, int]]]:
        """(item, field) to the stretches of document words that are a passage of it."""
        out: dict[tuple[int, str], list[tuple[int, int]]] = {}
        if not self.texts:
            return out
        own: list[str] | None = None
        done: dict[tuple[int, int], int] = {}  # (text, document word minus item word) to the end of the last passage
        at = passed = 0
        for end, (size, blocks) in self.tree.iter(folded):
            own = folded.split() if own is None else own
            start = end - size + 1
            at, passed = at + folded.count(" ", passed, start), start
            for item, field, number, first in blocks:
                line = self.texts[number]
                if done.get((number, at - first), -1) > at:
                    continue  # inside a passage that was already extended
                a, b, i, j = at, at, first, first
                while a and i and own[a - 1] == line[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(own) and j < len(line) and own[b] == line[j]:
                    b, j = b + 1, j + 1
                done[number, at - first] = b
                if b - a >= self.words:
                    out.setdefault((item, field), []).append((a, b))
        return out


def scan(items: list[tuple[int, str, str]], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items, words)
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for r, text in enumerate(batch.column(1).to_pylist()):
                if hits := scanner.passages(fold(text)):
                    place = fold_offsets(text)
                    for (item, field), spans in hits.items():
                        covered = len(set().union(*(range(a, b) for a, b in spans)))
                        rows.append((ids[r], item, field, place[min(a for a, _ in spans)][1], place[max(b for _, b in spans) - 1][2] + 1, covered))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "item_id", "field", "start_offset", "end_offset", "words_shared"])

    return run


def parts_of(held: DataFrame, fields: list[str], most: int) -> Iterator[list[tuple[int, str, str]]]:
    """The item texts in portions of up to ``most`` bytes; an item's text is never divided."""
    part: list[tuple[int, str, str]] = []
    size = 0
    for r in held.toLocalIterator():
        n = len(r.t.encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r.i, fields[r.f], r.t))
        size += n
    yield part


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], words: int = 12) -> DataFrame:
    """Documents sharing at least ``words`` consecutive words with an item, as (doc_id, item_id, field, start_offset, end_offset, words_shared).

    The offsets span all shared passages in the stored text; ``words_shared`` counts the document's words
    that lie in one. Null or empty texts and items below ``words`` words match nothing; passages are not
    joined across fields. Repeated rows of documents give repeated results, repeated items do not; an item
    id with several texts may give a row for each.
    """
    held = items.select(F.col(item_id).cast("long").alias("i"), F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("f", "t")).where("i is not null and t is not null")
    schema = "doc_id long, item_id long, field string, start_offset int, end_offset int, words_shared int"
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = None
    for part in parts_of(held.distinct().orderBy("i", "f", "t"), fields, PART_BYTES):
        found = rows.mapInArrow(scan(part, words), schema)
        out = found if out is None else out.unionByName(found)
    return out
