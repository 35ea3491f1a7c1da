"""Vectors as ``array<float>``: distances as Column expressions, validation, conversions.

Products and differences are summed in single precision in element order, then finished in double
precision. A zero vector has cosine distance NaN, which sorts last. Distances of different dimensions raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.semantics import InvalidParameter, col

MAX_DIMS = 16_000
METRICS = {"l2": "l2", "euclidean": "l2", "ip": "ip", "inner_product": "ip", "dot": "ip", "cosine": "cosine"}


def metric_name(metric: str) -> str:
    if metric.lower() not in METRICS:
        raise InvalidParameter(f"unknown metric {metric!r}")
    return METRICS[metric.lower()]


def lit_vector(values: list[float]) -> Column:
    if not 1 <= len(values) <= MAX_DIMS:
        raise InvalidParameter(f"a vector has 1 to {MAX_DIMS} dimensions")
    if any(v is None or v != v or v in (float("inf"), float("-inf")) for v in values):
        raise InvalidParameter("vector components must be finite")
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def fold(a: Column, b: Column, step) -> Column:
    zero = F.lit(0.0).cast("float")
    pairs = F.zip_with(a, b, step)
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, zero, lambda acc, x: acc + x)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("different vector dimensions")).cast("float"))


def l2_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(fold(col(a), col(b), lambda x, y: (x - y) * (x - y)).cast("double"))


def inner_product(a: str | Column, b: str | Column) -> Column:
    return fold(col(a), col(b), lambda x, y: x * y).cast("double")


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    dot, na, nb = inner_product(a, b), inner_product(a, a), inner_product(b, b)
    cos = F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))
    return F.when(cos.isNotNull(), 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).when(dot.isNotNull(), F.lit(float("nan")))


def distance(a: str | Column, b: str | Column, metric: str = "l2") -> Column:
    """Distance by metric, smaller is nearer; the inner product is negated."""
    kind = metric_name(metric)
    return l2_distance(a, b) if kind == "l2" else cosine_distance(a, b) if kind == "cosine" else -inner_product(a, b)


def parse_vector(text: str | Column) -> Column:
    """``[x,y,z]`` as array<float>; null where malformed or not finite."""
    v = F.from_json(F.trim(col(text)), "array<float>")
    return F.when((F.size(v) >= 1) & (F.size(v) <= MAX_DIMS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def vector_text(v: str | Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col(v), lambda x: x.cast("string")), ","), F.lit("]"))


def valid_vector(v: str | Column, dims: int | None = None) -> Column:
    v = col(v)
    ok = v.isNotNull() & (F.size(v) >= 1) & (F.size(v) <= MAX_DIMS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(v) == dims) if dims else ok, F.lit(False))


def send_udf():
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack


def vector_bytes(v: str | Column) -> Column:
    """Little-endian single-precision bytes of a vector."""
    return send_udf()(col(v))


def receive_udf():
    @F.pandas_udf("array<float>")
    def unpack(s: pd.Series) -> pd.Series:
        def one(data: bytes | None):
            if data is None or not data or len(data) % 4 or len(data) > 4 * MAX_DIMS:
                return None
            v = np.frombuffer(data, "<f4")
            return v if np.isfinite(v).all() else None

        return s.map(one)

    return unpack


def vector_from_bytes(b: str | Column) -> Column:
    """The vector of little-endian single-precision bytes; null where these are no vector."""
    return receive_udf()(col(b))


def with_dims(v: str | Column, dims: int) -> Column:
    """The vector, which must have ``dims`` dimensions if it is not null."""
    return F.when(col(v).isNull() | (F.size(col(v)) == dims), col(v)).otherwise(F.raise_error(F.lit(f"expected {dims} dimensions")).cast("array<float>"))


def sbq_bytes_per_vector(dims: int, bits: int = 1) -> int:
    """Bytes of a scalar-quantised code: whole 64-bit words."""
    if not 1 <= dims <= 1_000_000 or not 1 <= bits <= 8:
        raise InvalidParameter("dims is 1 to 1,000,000 and bits 1 to 8")
    return -(-dims * bits // 64) * 8
