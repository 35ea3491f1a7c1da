"""Token ids of whole corpora with a public byte-level BPE.

Overlapping chunk encoding: a long text is cut into chunks that reach ``overlap`` characters into the
next one, the chunks are pre-tokenised in parallel, and two neighbours are stitched at the first
pre-token boundary that both have in the overlap. The pre-token pattern looks only forward, so from a
common boundary on both go the same way; boundaries that the end of a chunk might have moved are not
used. The pieces between the stitches are then encoded one by one and their ids concatenated. Where an
overlap has no common boundary, the rest of that text stays one piece, which is always exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pre-token pattern of the vocabulary (a fixed value of the published byte-level BPE).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 4_096
OVERLAP = 256
#: A boundary this close to the end of a chunk may come from the cut.
MARGIN = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return str(Path(folder) / name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pretoken_ends(text: str) -> list[int]:
    import regex

    return [m.end() for m in regex.finditer(PATTERN, text)]


def decode(ids: list[int], by_id: dict[int, bytes]) -> str:
    """The text of token ids: their raw bytes joined, then read as UTF-8."""
    return b"".join(by_id[i] for i in ids).decode("utf-8")


def decoded(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); an empty list gives an empty text, and ids outside the vocabulary are an error."""
    by_id = {i: b for b, i in load_ranks(vocabulary).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(ids, by_id) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))))


def encode_rows(ranks: dict[bytes, int], extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], lists(ids)], names=[*extra, "ids"])

    return run


def pretokenise(chunk: int, overlap: int, margin: int):
    """Boundaries, as offsets of the whole text, in the overlap with the chunk before and with the chunk after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for base, last, text in zip(batch.column("base").to_pylist(), batch.column("last").to_pylist(), batch.column("chunk").to_pylist()):
                ends = [base + e for e in pretoken_ends(text)]
                heads.append([e for e in ends if e <= base + overlap])
                safe = base + len(text) - margin
                # the last pre-tokens before the cut may go on behind it
                tails.append([] if last else [e for e in ends[:-2] if base + chunk <= e <= safe])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "k", "base")], lists(heads), lists(tails)], names=["row", "k", "base", "heads", "tails"])

    return run


def cut_chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                bases = list(range(0, len(text), chunk))
                last = [b + chunk >= len(text) for b in bases]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(bases), pa.string()), pa.array(range(len(bases)), pa.int32()), pa.array(bases, pa.int32()), pa.array(last), pa.array([text[b : b + chunk + overlap] for b in bases], pa.string())],
                    names=["row", "k", "base", "last", "chunk"],
                )

    return run


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text between its stitches."""
    for batch in batches:
        for row, text, stops in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "stops"))):
            cuts = [0, *(stops or []), len(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * (len(cuts) - 1), pa.string()), pa.array(cuts[:-1], pa.int32()), pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.string())], names=["row", "start", "piece"]
            )


def token_ids(df: DataFrame, doc_id: str, text: str, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> DataFrame:
    """(doc_id, ids) with one row for each input row; null and empty texts give an empty list, special tokens are ordinary text.

    Repeated rows are encoded each for itself. Texts up to ``chunk`` characters are one piece; only longer
    ones are cut, so the shuffles here carry nothing but their chunks and ids.
    """
    if not margin < overlap < chunk:
        raise ValueError("margin < overlap < chunk is required")
    ranks = load_ranks(vocabulary)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    kind = source.schema["doc_id"].dataType.simpleString()
    short = source.where(~is_long).select("doc_id", F.col("text").alias("piece")).mapInArrow(encode_rows(ranks, ["doc_id"]), f"doc_id {kind}, ids array<int>")
    rows = source.where(is_long).withColumn("row", F.sha2("text", 256))  # a cryptographic hash stands for the text
    # equal long texts are encoded once and joined back to every row
    texts = rows.groupBy("row").agg(F.first("text").alias("text"))
    spread = texts.mapInArrow(cut_chunks(chunk, overlap), "row string, k int, base int, last boolean, chunk string").repartition("row", "k")
    marks = spread.mapInArrow(pretokenise(chunk, overlap, margin), "row string, k int, base int, heads array<int>, tails array<int>")
    w = Window.partitionBy("row").orderBy("k")
    stitch = F.array_min(F.array_intersect(F.col("tails"), F.lead("heads").over(w)))
    bounds = marks.withColumn("stitch", stitch).withColumn("is_end", F.lead("k").over(w).isNull())
    # behind a missing stitch no boundary is proven, so the text from the last stitch on is one piece
    gap = F.min(F.when(F.col("stitch").isNull() & ~F.col("is_end"), F.col("k"))).over(Window.partitionBy("row"))
    proven = bounds.withColumn("gap", gap).where(F.col("stitch").isNotNull() & (F.col("gap").isNull() | (F.col("k") < F.col("gap"))))
    stops = proven.groupBy("row").agg(F.array_sort(F.collect_set("stitch")).alias("stops"))
    pieces = texts.join(stops, "row", "left").mapInArrow(cut_pieces, "row string, start int, piece string").repartition("row", "start")
    encoded = pieces.mapInArrow(encode_rows(ranks, ["row", "start"]), "row string, start int, ids array<int>")
    whole = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p")).select("row", F.flatten(F.col("p.ids")).alias("ids"))
    return short.unionByName(rows.select("doc_id", "row").join(whole, "row").select("doc_id", "ids"))
