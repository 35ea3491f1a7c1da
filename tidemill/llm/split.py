"""Splitting of oversized texts at natural boundaries.

The separators form a hierarchy: section, paragraph, sentence or line, word, character. A text over the limit
is split at its sections. Parts are packed greedily into a piece as long as it stays within the limit; a part
that does not fit into a piece of its own closes the piece before it, is split at the next lower level by
the same rule, and its last piece is closed in turn, so the boundaries of the higher level stay piece ends.
Each piece starts inside the one before, at the first word that begins in its last ``overlap`` characters
(or exactly so far back if none does), so pieces are exact substrings and the text can be put together
again from their offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A boundary is the end of a match, from the highest level down; a piece cut between characters needs none.
LEVELS = [
    re.compile(r"(?:\r?\n|^)[ \t]*(?:-{3,}|={3,}|\*{3,})[ \t]*(?:\r?\n)+|(?:\r?\n)+(?=#{1,6} )|\f"),
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+|\r?\n"),
    re.compile(r"\s+"),
]


class Packer:
    """Cuts one text; a piece is known by its end and by its start, which reaches into the piece before."""

    def __init__(self, text: str, size: int, overlap: int):
        self.text, self.size, self.overlap = text, size, min(overlap, size - 1)
        self.words = [m.end() for m in LEVELS[-1].finditer(text)]
        self.spans: list[tuple[int, int]] = []
        self.start = self.end = self.fresh = 0  # of the open piece; from ``fresh`` on it is new text

    def start_at(self, cut: int) -> int:
        """Where the piece begins that follows the open one when this ends at ``cut``; always behind the start of that."""
        back = max(cut - self.overlap, self.start + 1)
        at = bisect_left(self.words, back)
        return self.words[at] if at < len(self.words) and self.words[at] < cut else back

    def close(self) -> None:
        if self.end > self.fresh:
            self.spans.append((self.start, self.end))
            self.start, self.fresh = self.start_at(self.end), self.end

    def add(self, a: int, b: int, level: int) -> None:
        """Pack the part from ``a`` to ``b``, which has no boundary above ``level``."""
        if b - self.start <= self.size:
            self.end = b
        elif a > self.fresh and b - self.start_at(a) <= self.size:
            self.close()
            self.end = b
        elif level == len(LEVELS):
            while b - self.start > self.size:
                self.end = self.start + self.size
                self.close()
            self.end = b
        else:
            cuts = [m.end() for m in LEVELS[level].finditer(self.text, a, b) if a < m.end() < b]
            if cuts and level:
                self.close()
            for x, y in zip([a, *cuts], [*cuts, b]):
                self.add(x, y, level + 1)
            if cuts and level:
                self.close()


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the pieces: each at most ``size`` characters, covering the text, consecutive ones sharing up to ``overlap``."""
    packer = Packer(text, size, overlap)
    packer.add(0, len(text), 0)
    packer.close()
    return packer.spans


def cut_texts(keys: pa.Schema):
    names = [*keys.names, "chunk_index", "chunk_text", "start_offset", "end_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, overlap = batch.column("__size").to_pylist(), batch.column("__overlap").to_pylist()
            rows, index, text, begin, end = [], [], [], [], []
            for r, t in enumerate(batch.column("__text").to_pylist()):
                spans = split_spans(t, size[r], overlap[r])
                rows += [r] * len(spans)
                index += range(len(spans))
                text += [t[a:b] for a, b in spans]
                begin += [a for a, _ in spans]
                end += [b for _, b in spans]
            kept = batch.select(keys.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(index, pa.int32()), pa.array(text, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=names)

    return run


def split_oversized(df: DataFrame, key_cols: list[str], text: str | Column, size: int | str | Column, overlap: int | str | Column) -> DataFrame:
    """All pieces of all texts as (keys, chunk_index, chunk_text, start_offset, end_offset); lengths count code points.

    ``size`` and ``overlap`` are numbers, columns or column names. A text within its limit is one piece. A
    null or empty text has none. A limit that is null or below one leaves the text whole; a null or
    negative overlap is none, and one that reaches the limit is cut to limit - 1. Repeated rows are split
    each for itself. Texts within their limit never leave the JVM.
    """

    def col(x) -> Column:
        return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x

    out = ("chunk_index", "chunk_text", "start_offset", "end_offset")
    if clash := set(key_cols) & set(out):
        raise ValueError(f"key columns clash with the result: {sorted(clash)}")
    source = df.select(*key_cols, col(text).alias("__text"), col(size).cast("int").alias("__size"), F.greatest(F.coalesce(col(overlap).cast("int"), F.lit(0)), F.lit(0)).alias("__overlap"))
    length = F.char_length("__text")
    source = source.where(length > 0)
    over = F.coalesce((F.col("__size") > 0) & (length > F.col("__size")), F.lit(False))
    whole = source.where(~over).select(*key_cols, F.lit(0).alias(out[0]), F.col("__text").alias(out[1]), F.lit(0).alias(out[2]), length.alias(out[3]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*key_cols).schema) + ", chunk_index int, chunk_text string, start_offset int, end_offset int"
    keys = pa.schema([(name, pa.null()) for name in key_cols])
    return whole.unionByName(source.where(over).mapInArrow(cut_texts(keys), schema))
