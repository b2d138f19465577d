"""Vectors as arrays: products, metrics, and embeddings made from text alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; the longer vector's rest is ignored."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def score(a: Column, b: Column, metric: str) -> Column:
    """Similarity by a metric: greater is nearer."""
    return {"dot": dot, "cosine": cosine}[metric](a, b) if metric != "l2" else -l2(a, b)


def scorer(query: Sequence[float], metric: str) -> Callable[[Column | str], Column]:
    """Scores a column of vectors against one query in Arrow batches, as score() does row by row: the longer vector's rest is ignored, null numbers count as 0, a vector that is
    null or empty scores as the query itself does, and a cosine with a zero vector is null."""
    q = np.asarray(query, dtype=np.float64)

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            if metric == "l2":
                return -np.sqrt(((x - y) ** 2).sum(axis=1))
            s = x @ y
            if metric == "cosine":
                n = np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q)
                s = np.where(n == 0, np.nan, s / n)
            return s

    if metric not in ("dot", "cosine", "l2"):
        raise KeyError(metric)

    def run(v: pa.Array) -> pa.Array:
        n = np.asarray(v.value_lengths().fill_null(0)) if len(v) else np.zeros(0, dtype=np.int64)
        flat = np.asarray(v.flatten().cast(pa.float64()).fill_null(0.0))
        at = np.cumsum(n) - n
        out = np.empty(len(n))
        for d in np.unique(n):
            rows = np.flatnonzero(n == d)
            x = flat[at[rows][:, None] + np.arange(d)] if d else np.repeat(q[None, :], len(rows), axis=0)
            m = min(x.shape[1], len(q))
            if metric == "cosine" and m < x.shape[1]:  # the norm is that of the whole vector
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt(q @ q)
                    out[rows] = np.where(norm == 0, np.nan, x[:, :m] @ q[:m] / norm)
            else:
                out[rows] = of(x[:, :m], q[:m])
        return pa.array(out, mask=np.isnan(out) if metric == "cosine" else None)

    return F.arrow_udf(run, "double")


def pseudo_embedding(text: Column, dim: int) -> Column:
    """dim numbers from -1 to 1 out of SHA-256 digests of the text and a counter."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    def word(c: Column, i: Column) -> Column:
        digest = F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lpad(F.hex(c), 8, "0"))), 256)
        return F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint") / F.lit(2147483648.0) - F.lit(1.0)

    counters = F.sequence(F.lit(0), F.lit((dim + 7) // 8 - 1))
    return F.slice(F.flatten(F.transform(counters, lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: word(c, i)))), 1, dim)
