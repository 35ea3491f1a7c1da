"""Text chunking with the strategies fixed, sentence and recursive; lengths count code points."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter

STRATEGIES = ("fixed", "sentence", "recursive")


def check(strategy: str, size: int, overlap: int) -> None:
    if strategy not in STRATEGIES:
        raise InvalidParameter(f"unknown chunk strategy {strategy!r}")
    if size <= 0 or overlap < 0 or overlap >= size:
        raise InvalidParameter("chunk size must be positive and the overlap smaller than it")


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Character windows that advance by size - overlap; the last one reaches the end and none holds overlap only."""
    step, out, at = size - overlap, [], 0
    while at < len(text):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += step
    return out


def pack(atoms: list[str], size: int, overlap: int) -> list[str]:
    """Join atoms with blanks up to the size; a new chunk carries trailing atoms of up to ``overlap`` characters.

    The carry and the next atom together may exceed the size, as users of this chunker know it.
    """
    out: list[str] = []
    now: list[str] = []
    length = 0
    for atom in atoms:
        added = len(atom) + (1 if now else 0)
        if now and length + added > size:
            out.append(" ".join(now))
            carry: list[str] = []
            total = 0
            for prev in reversed(now):
                if total + len(prev) + (1 if carry else 0) > overlap:
                    break
                total += len(prev) + (1 if carry else 0)
                carry.insert(0, prev)
            now, length = carry, total
            added = len(atom) + (1 if now else 0)
        now.append(atom)
        length += added
    if now:
        out.append(" ".join(now))
    return out


def sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences; one over the size is cut into windows that overlap."""
    parts = [p.strip() for p in re.split(r"(?<=[.!?])(?=\s|$)", text)]
    return [w for p in parts if p for w in (windows(p, size, overlap) if len(p) > size else [p])]


def atoms_of(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Parts of at most ``size`` at the highest separators that give such; without one, windows that overlap."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    if not separators:
        return windows(text, size, overlap)
    return [a for part in text.split(separators[0]) if part.strip() for a in atoms_of(part, size, overlap, separators[1:])]


def chunk(text: str | None, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> list[str]:
    """Chunks of one text; none for a null or empty one. Blank text has none either, but ``fixed`` returns it as it is."""
    check(strategy, size, overlap)
    if not text:
        return []
    if strategy == "fixed":
        return windows(text, size, overlap)
    if not text.strip():
        return []
    return pack(sentences(text, size, overlap) if strategy == "sentence" else atoms_of(text, size, overlap), size, overlap)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """The fixed strategy as a JVM expression."""
    check("fixed", size, overlap)
    step = size - overlap
    n = F.char_length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_column(text: Column, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> Column:
    check(strategy, size, overlap)
    if strategy == "fixed":
        return fixed_chunks(text, size, overlap)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk(t, strategy, size, overlap))

    return run(text)


def chunk_rows(df: DataFrame, id_col: str, text_col: str, strategy: str = "recursive", size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, chunk_text)."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(chunk_column(F.col(text_col), strategy, size, overlap)).alias("chunk_index", "chunk_text"))
