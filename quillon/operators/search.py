"""Vector and lexical search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..shared import table
from . import filters

#: BM25's usual constants.
K1, B = 1.2, 0.75


def topk(df: DataFrame, query: Sequence[float], k: int, metric: str = "dot", id_col: str = "id", vector: str = "embedding", where: Column | None = None, order: Column | str | None = None) -> DataFrame:
    """df's k rows most similar to a query vector, with their score. Ties go to the lesser `order` (else id). A row without vector
    scores as the query itself does. Conditions are applied before the limit."""
    rows = df if where is None else df.where(where)
    scored = rows.withColumn("score", vectors.scorer(query, metric)(vector))
    return scored.orderBy(F.desc_nulls_last("score"), order if order is not None else F.col(id_col)).limit(k)


def batch_topk(df: DataFrame, queries: DataFrame, k: int, metric: str = "dot", id_col: str = "id", vector: str = "embedding", most_queries: int = 50_000) -> DataFrame:
    """(query, id, score, rank) of the k most similar rows for each of a bounded set of queries (query, vector).

    Every executor holds the queries (at most most_queries, counted first) and reads its share of df once, in blocks; only k candidates a
    query and task are shuffled. Vectors of another length than the query's, null or not finite, are left out; ties go to the lesser id.
    """
    held = queries.where("vector IS NOT NULL").limit(most_queries + 1).collect()
    if len(held) > most_queries:
        raise ValueError(f"more than {most_queries} queries; use the indexed search")
    kind = df.schema[id_col].dataType.simpleString()
    qkind = queries.schema["query"].dataType.simpleString()
    by: dict[int, tuple[list, np.ndarray]] = {}
    for n in {len(r.vector) for r in held}:
        some = [r for r in held if len(r.vector) == n]
        by[n] = ([r["query"] for r in some], np.array([r.vector for r in some], dtype=np.float64))
    shared = df.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {d: [] for d in shared.value}  # by dimension: queries, ids, scores

        def best(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of each query so far."""
            i, ids, s = (np.concatenate(x) for x in zip(*kept[d], strict=True))
            order = np.lexsort((ids, -s, i))
            i, ids, s = i[order], ids[order], s[order]
            first = np.searchsorted(i, i, side="left")
            top = np.arange(len(i)) - first < k
            kept[d] = [(i[top], ids[top], s[top])]
            return kept[d][0]

        for b in batches:
            ids, e = np.array(b.column(0).to_pylist()), b.column(1)
            n = np.asarray(e.value_lengths().fill_null(-1)) if len(e) else np.zeros(0)
            flat = np.asarray(e.flatten().cast(pa.float64()).fill_null(float("nan")))
            at = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int64)
            for d, (_, q) in shared.value.items():
                rows = np.flatnonzero(n == d)
                if not len(rows) or not d:
                    continue
                x = flat[at[rows][:, None] + np.arange(d)]
                for begin in range(0, len(q), QUERY_BLOCK):
                    y = q[begin : begin + QUERY_BLOCK]
                    with np.errstate(all="ignore"):
                        s = y @ x.T
                        if metric == "cosine":
                            s /= np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                        elif metric == "l2":
                            s = -np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] - 2 * s + (x * x).sum(axis=1)[None, :], 0))
                    s = np.round(s, 9)
                    s[~np.isfinite(s)] = -np.inf
                    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.finfo(float).max)
                    i, j = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                    kept[d].append((i + begin, ids[rows][j], s[i, j]))
                if sum(len(x[0]) for x in kept[d]) > 4 * k * len(q) + 100_000:
                    best(d)
        for d in kept:
            if kept[d]:
                i, ids, s = best(d)
                names = shared.value[d][0]
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i.tolist()], _TYPES[qkind]), pa.array(ids.tolist(), _TYPES[kind]), pa.array(s)], names=["query", "id", "score"])

    near = df.where(F.col(vector).isNotNull()).select(id_col, vector).mapInArrow(run, f"query {qkind}, id {kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


QUERY_BLOCK = 1024  # queries that meet a batch of vectors at once
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def rank_scores(hits: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """hits with scores n, n - 1 ... by position, at least 1; hits are already limited."""
    return hits.withColumn("score", F.greatest(F.lit(n) - F.row_number().over(Window.orderBy(*order)) + 1, F.lit(1)))


def rerank(hits: DataFrame, key: Column, position: str, limit: int = 0) -> DataFrame:
    """Hits by a key descending, at equal keys in their old order."""
    out = hits.orderBy(F.desc(key), position)
    return out.limit(limit) if limit > 0 else out


def at_least(hits: DataFrame, threshold: float | None) -> DataFrame:
    return hits if threshold is None else hits.where(F.col("score") >= threshold)


def search(stored: DataFrame, records: DataFrame, query: Sequence[float], top_k: int = 10, raw_filters: Mapping | None = None, threshold: float | None = None, mode: str = "exact", metric: str = "dot", include_metadata: bool = True) -> DataFrame:
    """A collection's search: active records unless the filter says otherwise, best first.

    stored: (id, embedding and the filterable fields as they were written), records: the authoritative rows (record_id and the
    same fields). mode `exact` applies all conditions before the limit; `compat` limits first, as the stores' clients do, then applies
    threshold, lifecycle and tags to the record each hit belongs to, so that fewer than top_k rows can come out; a hit without record stays.
    """
    raw = {"lifecycle_state": "active", **(raw_filters or {})}
    residual = {k: v for k, v in filters.coerce(raw).items() if k in ("lifecycle_state", "access_tags")}
    if mode == "exact":
        # vectors are scored where they lie; what meets the records is narrow
        scored = stored.withColumn("score", vectors.scorer(query, metric)("embedding")).drop("embedding")
        live = scored.join(records.where(filters.predicate(raw)).select("record_id"), scored["id"] == F.col("record_id"), "left_semi")
        hits = at_least(live.orderBy(F.desc_nulls_last("score"), "id").limit(top_k), threshold)
    else:
        hits = at_least(topk(stored.where(filters.predicate(filters.pushed(raw))), query, top_k, metric), threshold)
        known = records.select("record_id", *[F.col(k).alias(f"record_{k}") for k in residual])
        ok = filters.predicate(residual, lambda k: F.col(f"record_{k}"))
        hits = hits.join(known, hits["id"] == known["record_id"], "left").where(F.col("record_id").isNull() | ok).drop("record_id", *[f"record_{k}" for k in residual])
    return hits if include_metadata else hits.drop("metadata")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bm25(docs: DataFrame, query: str, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, lexical) of documents with at least one query term. One pass counts lengths and the query's terms; nothing is exploded."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    times = lambda term: F.size(F.filter("t", lambda x: x == term))
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("t")).select("id", F.size("t").alias("n"), *[times(y).alias(f"tf{i}") for i, y in enumerate(terms)])
    rows = table(rows, "terms")  # some numbers a document: texts are read and cut into words once
    counts = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    docs_n, mean = counts["docs"], counts["mean"] or 1.0
    parts = [
        F.log(F.lit(1 + (docs_n - counts[f"df{i}"] + 0.5) / (counts[f"df{i}"] + 0.5))) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("n") / mean))
        for i in range(len(terms))
    ]
    total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    return rows.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").select("id", total.alias("lexical"))


def hybrid(docs: DataFrame, query_text: str, query: Sequence[float], k: int, metric: str = "cosine", vector_k: int = 50) -> DataFrame:
    """(id, score): the best of lexical plus vector score; the vector part counts for its vector_k nearest."""
    near = topk(docs, query, vector_k, metric).select("id", F.col("score").alias("vector"))
    both = bm25(docs, query_text).join(near, "id", "full_outer")
    return both.select("id", (F.coalesce("lexical", F.lit(0.0)) + F.coalesce("vector", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


@dataclass(frozen=True)
class Capabilities:
    """What a store can do; fixed values follow in MATRIX."""

    hybrid: bool = False
    filters: bool = True
    delete_by_filter: bool = False
    max_metadata_bytes: int = 40_960
    max_batch_size: int = 100


MATRIX = {
    "chroma": Capabilities(), "qdrant": Capabilities(delete_by_filter=True), "weaviate": Capabilities(hybrid=True), "opensearch": Capabilities(hybrid=True, delete_by_filter=True),
    "pgvector": Capabilities(delete_by_filter=True), "infinity": Capabilities(delete_by_filter=True, max_metadata_bytes=65_536, max_batch_size=500),
}


def plan(top_k: int, raw_filters: Mapping | None, c: Capabilities) -> dict:
    """Mode, clamped k and the filters a store can take."""
    return {"mode": "hybrid" if c.hybrid else "vector", "top_k": max(1, min(top_k, c.max_batch_size)), "filters": dict(raw_filters or {}) if c.filters else {}}


def page(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows in order; a limit of 0 is the default of 100."""
    return df.orderBy(*order).offset(offset).limit(limit or 100)
