"""Per-key aggregates with even work although a few keys own most rows.

Every task first combines its own rows of a key where they are read, without a shuffle. The partial states
are range-partitioned on (key, secondary order), the secondary order being the place of a state in its
input, with the quantiles that Spark samples, so a key with many states is cut across partitions like any
other stretch of the order. Each partition combines its sorted run in one pass; only its first and last key
can go on in a neighbour, and these boundary states are stitched by one small aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

from tidemill.session import cut


#: Rows a task combines at once before the shuffle.
COMBINE_ROWS = 1_000_000
ARROW = {"bigint": pa.int64(), "double": pa.float64()}


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at ``starts``; integers that leave 64 bits are an error."""
    out = np.add.reduceat(values, starts)
    if values.dtype == np.int64 and len(values) and np.abs(np.add.reduceat(values.astype(np.float64), starts)).max() > 9.2e18:
        raise OverflowError("a sum exceeds 64 bits")
    return out


def combine_input(columns: dict[str, str]):
    """Partial sums of up to COMBINE_ROWS rows at a time, with their place in the input."""

    def reduced(held: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys = table["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = [pa.array(run_sums(table[c].to_numpy()[order], starts), ARROW[t]) for c, t in columns.items()]
        return pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array(np.full(len(starts), place, np.int64)), *sums], names=["key", "__split", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= COMBINE_ROWS:
                yield reduced(held, place)
                place, held, n = place + 1, [], 0
        if n:
            yield reduced(held, place)

    return run


def combine_run(columns: dict[str, str]):
    """Sums of each key of a sorted partition; ``edge`` marks its first and last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states(keys, sums, edge):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(s, ARROW[t]) for s, t in zip(sums, columns.values())], pa.array(edge, pa.bool_())], names=["key", *columns, "edge"])

        open_key, open_sums, first = None, None, True
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column("key").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = [run_sums(batch.column(c).to_numpy(), starts).tolist() for c in columns]
            keys = keys[starts]
            if open_key is not None:
                if open_key == keys[0]:
                    for s, o in zip(sums, open_sums):
                        s[0] += o
                else:
                    yield states([open_key], [[o] for o in open_sums], [first])
                    first = False
            if len(keys) > 1:
                edge = np.zeros(len(keys) - 1, bool)
                edge[0] = first
                yield states(keys[:-1], [s[:-1] for s in sums], edge)
                first = False
            open_key, open_sums = int(keys[-1]), [s[-1] for s in sums]
        if open_key is not None:
            yield states([open_key], [[o] for o in open_sums], [True])

    return run


def summable(df: DataFrame, column: Column) -> tuple[Column, str, int]:
    """The column as long or double, its type, and the decimal places that were taken out."""
    kind = df.select(column.alias("c")).schema["c"].dataType
    if isinstance(kind, DecimalType):
        if kind.precision > 15:
            raise ValueError(f"decimals of up to 15 digits can be summed, not {kind.simpleString()}; cast to double")
        return (column * F.lit(10**kind.scale)).cast("long"), "bigint", kind.scale
    if isinstance(kind, FractionalType):
        return column.cast("double"), "double", 0
    if isinstance(kind, IntegralType):
        return column.cast("long"), "bigint", 0
    raise ValueError(f"only numbers can be summed, not {kind.simpleString()}")


def balanced_sums(df: DataFrame, key: str | Column, sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """One row per key with the sums, as (key, *sums); nulls add nothing.

    Integers are summed as 64-bit integers (leaving them is an error), floating numbers as doubles, decimals
    of up to 15 digits exactly. Rows with a null key take no part. Repeated rows count as often as they
    stand. Results do not depend on ``partitions``, but for the rounding of doubles. An empty table gives no rows.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if clash := {"key", "edge", "__split"} & set(sums):
        raise ValueError(f"names are used by the operator: {sorted(clash)}")
    numbers = {n: summable(df, c) for n, c in sums.items()}
    columns = {n: kind for n, (_, kind, _) in numbers.items()}
    schema = ", ".join(f"`{n}` {kind}" for n, kind in columns.items())
    rows = df.select((F.col(key) if isinstance(key, str) else key).cast("long").alias("key"), *[F.coalesce(c, F.lit(0).cast(kind)).alias(n) for n, (c, kind, _) in numbers.items()]).where("key is not null")
    partial = cut(rows.mapInArrow(combine_input(columns), f"key long, __split long, {schema}"))
    ranged = partial.repartitionByRange(parts, "key", "__split").sortWithinPartitions("key", "__split")
    states = cut(ranged.select("key", *columns).mapInArrow(combine_run(columns), f"key long, {schema}, edge boolean"))
    inner = states.where(~F.col("edge")).drop("edge")
    stitched = states.where("edge").groupBy("key").agg(*[F.sum(n).alias(n) for n in columns])
    total = lambda n, places: (F.col(n).cast("decimal(38,0)") / F.lit(10**places)).cast(f"decimal(38,{places})").alias(n) if places else F.col(n)
    return inner.unionByName(stitched).select("key", *[total(n, places) for n, (_, _, places) in numbers.items()])


def endpoint_totals(edges: DataFrame, src: str, dst: str, weight: str, partitions: int | None = None) -> DataFrame:
    """Edges and weight of every node that is an endpoint, as (node_id, n_edges, sum_weight).

    Rows count as they stand, repeated ones included; a self-loop counts once; a null endpoint is no node
    and a null weight adds nothing.
    """
    ends = F.array_distinct(F.array_compact(F.array(F.col(src).cast("long"), F.col(dst).cast("long"))))
    rows = edges.select(F.explode(ends).alias("node"), F.col(weight).alias("w"))
    return balanced_sums(rows, "node", {"n_edges": F.lit(1), "sum_weight": F.col("w")}, partitions).withColumnRenamed("key", "node_id")


def hot_nodes(totals: DataFrame, rows: int, share: float = 0.02) -> DataFrame:
    """Nodes of ``totals`` that occur in at least ``share`` of ``rows`` rows."""
    return totals.where(F.col("n_edges") >= max(1, math.ceil(round(share * rows, 6))))
