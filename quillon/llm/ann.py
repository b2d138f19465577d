"""Most similar vectors for every vector: an inverted multi-index.

A vector's two halves are quantised apart, each to the nearest of K centroids, so K * K cells of (first, second) partition a
collection; K grows with the collection. A query visits cells in order of the summed distance of its halves to the two centroids, which a heap yields one by one,
and the entries of the visited cells are reranked by their exact cosine. Cells of one first centroid lie together, so a query's vector travels once for each
first centroid that it visits, with the list of the second ones.

How many cells a query visits is measured for each collection when its centroids are made: for up to 256 vectors of the sample, the place of the cells of their true
neighbours (or, where a least cosine is asked for, of vectors made at exactly that cosine) in the heap's order; so many cells are visited as hold the share `recall` of them. The sample is
thinner than the collection and its neighbours farther, so the number is on the safe side. Where more than the share `whole` of the cells would be needed no index
helps: such a collection is one cell, searched whole and exactly.

Only the centroids and that number come from a sample (of at most sample_rows or 8 K vectors of a collection); every vector is indexed. Equal vectors of a
collection form one class: a class is searched once and stands in the index with its first k + 1 ids, which is all that any top k can show
of it, so copies of one vector cost nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, table, tasks_for

CELL_ROWS = 128  # entries that an average cell should have
WHOLE = -1  # stands for the first centroid in a collection that is searched whole, as one cell
BOOK_BYTES = 64 << 20  # centroids that are sent to the executors at once


def unit_vectors(df: DataFrame, extra: str | None = None) -> DataFrame:
    """(id, coll, q, vec) of usable rows of (id, coll, dim, embedding[, q]): vec is the unit vector as float32 bytes.

    Vectors that are null, of another dimension than dim, zero, or hold NaN or infinite numbers have no defined cosine and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, dim = b.column("embedding"), b.column("dim").to_numpy(zero_copy_only=False)
            n = np.asarray(e.value_lengths().fill_null(-1)) if len(e) else np.zeros(0)
            flat = np.asarray(e.flatten().cast(pa.float64()).fill_null(float("nan")))
            at = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int64)
            vec: list[bytes | None] = [None] * len(e)
            for d in np.unique(dim[n == dim]):
                rows = np.flatnonzero((n == d) & (dim == d))
                x = flat[at[rows][:, None] + np.arange(int(d))]
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge numbers neither vanish nor overflow
                    x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32) + np.float32(0)
                for r, v, ok in zip(rows, x, np.isfinite(x).all(axis=1), strict=True):
                    if ok:
                        vec[r] = v.tobytes()
            keep = pa.array([i for i, v in enumerate(vec) if v is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(keep), b.column("coll").take(keep), b.column("q").take(keep), pa.array(vec, pa.binary()).take(keep)], names=["id", "coll", "q", "vec"])

    q = F.lit(False) if extra is None else F.col(extra)
    return df.where("id IS NOT NULL AND coll IS NOT NULL AND dim IS NOT NULL AND embedding IS NOT NULL").select("id", "coll", F.col("dim").cast("int").alias("dim"), "embedding", q.alias("q")).mapInArrow(
        run, "id string, coll string, q boolean, vec binary"
    )


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of the rows of x, started from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[np.linspace(0, len(x) - 1, int((n == 0).sum()) + 2).astype(int)[1:-1]] if (n == 0).any() else c[n == 0]
    return c


def halves(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the rows' halves to the centroids."""
    h = a.shape[1]
    return tuple((y * y).sum(axis=1)[:, None] - 2 * y @ c.T + (c * c).sum(axis=1) for y, c in ((x[:, :h], a), (x[:, h:], b)))


def probes_for(x: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, min_cosine: float | None, recall: float, asked: int = 256) -> int:
    """Cells to visit so that the share `recall` of the sample's neighbours is met."""
    r = np.random.default_rng(0)
    q = r.choice(len(x), min(asked, len(x)), replace=False)
    home = [d.argmin(axis=1) for d in halves(x, a, b)]
    if min_cosine is None:
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -9
        near = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        asking = x[q]
    else:  # vectors at just that cosine in any direction
        u = r.normal(size=(len(q), x.shape[1]))
        u -= (u * x[q]).sum(axis=1)[:, None] * x[q]
        u /= np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None]
        asking, near = min_cosine * x[q] + np.sqrt(1 - min_cosine**2) * u, q[:, None]
    places = []
    for d1, d2, own in zip(*halves(asking, a, b), near, strict=True):
        o = np.sort(d2)
        places += [int(np.searchsorted(o, d1[home[0][n]] + d2[home[1][n]] - d1, side="left").sum()) for n in own]
    return int(np.quantile(places, recall, method="higher")) + 1


class Book(NamedTuple):
    """A collection's centroids, and how many cells a query visits (0: the collection is searched whole)."""

    first: np.ndarray
    second: np.ndarray
    probes: int


def codebooks(stored: DataFrame, k: int, min_cosine: float | None, recall: float, whole: float, sample_rows: int) -> DataFrame:
    """(coll, k, probes, a, b) of each collection of (coll, cls, vec), from a bounded sample; K follows the collection's size."""
    sizes = stored.groupBy("coll").agg(F.approx_count_distinct("cls", 0.02).alias("n"))
    sizes = bounded(sizes.withColumn("rows", F.greatest(F.lit(sample_rows), F.least(F.sqrt(F.col("n") / CELL_ROWS), F.lit(4096)) * 8)))
    some = stored.join(sizes, "coll").where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.col("rows") / F.col("n")) * (1 << 20)).dropDuplicates(["coll", "cls"])

    def train(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(p["vec"].sort_values()), dtype=np.float32).reshape(len(p), -1)
        many = min(int(np.clip(np.sqrt(p["n"].iloc[0] / CELL_ROWS), 2, 4096)), len(x))
        h = x.shape[1] // 2
        a, b = kmeans(x[:, :h], many), kmeans(x[:, h:], many)
        probes = probes_for(x.astype(np.float64), a, b, k, min_cosine, recall) if len(x) > k + 1 else many * many
        return pd.DataFrame({"coll": [key[0]], "k": [many], "probes": [probes if probes <= whole * many * many else 0], "a": [a.tobytes()], "b": [b.tobytes()]})

    return some.groupBy("coll").applyInPandas(train, "coll string, k int, probes int, a binary, b binary")


def nearest_cells(d1: np.ndarray, d2: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first `most` cells (i, j) in order of d1[i] + d2[j], by a heap over the sorted halves."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out = [(s1[0] + s2[0], 0, 0)], []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((o1[i], o2[j]))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _cells(df: DataFrame, books: DataFrame, home: bool) -> DataFrame:
    """A row for each first centroid to visit, with the second ones: df with (first, seconds); with home only the home cell. books is a written table;
    of more than BOOK_BYTES of centroids a share at a time is sent to the executors."""
    size = books.agg(F.sum(F.length("a") + F.length("b"))).first()[0] or 0
    shares = max(-(-size // BOOK_BYTES), 1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    parts = []
    for n in range(shares):
        mine = F.pmod(F.xxhash64("coll"), F.lit(shares)) == n
        rows = books.where(mine).collect()
        held = {r.coll: Book(*(np.frombuffer(c, dtype=np.float32).reshape(r.k, -1) for c in (r.a, r.b)), r.probes) for r in rows}
        shared = df.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                coll, vec = np.asarray(b.column("coll").to_pylist(), dtype=object), b.column("vec").to_pylist()
                at: list[int] = []
                first: list[int] = []
                seconds: list[list[int]] = []
                for c in set(coll.tolist()) & shared.value.keys():
                    rows, book = np.flatnonzero(coll == c), shared.value[c]
                    if not book.probes:
                        at += rows.tolist()
                        first += [WHOLE] * len(rows)
                        seconds += [[0]] * len(rows)
                        continue
                    x = np.frombuffer(b"".join(vec[r] for r in rows), dtype=np.float32).reshape(len(rows), -1)
                    d1, d2 = halves(x, book.first, book.second)
                    if home:
                        at += rows.tolist()
                        first += d1.argmin(axis=1).tolist()
                        seconds += [[j] for j in d2.argmin(axis=1).tolist()]
                        continue
                    for r, u, v in zip(rows.tolist(), d1, d2, strict=True):
                        by: dict[int, list[int]] = {}
                        for i, j in nearest_cells(u, v, book.probes):
                            by.setdefault(i, []).append(j)
                        at += [r] * len(by)
                        first += by.keys()
                        seconds += by.values()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(col.take(take) for col in b.columns), pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], names=[*b.schema.names, "first", "seconds"])

        parts.append((df.where(mine) if shares > 1 else df).mapInArrow(run, f"{kinds}, first int, seconds array<int>"))
    return reduce(DataFrame.unionByName, parts)


def _block(s: np.ndarray, n: int, least: float, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row (from `at` on), column and value of each row's n greatest values, and of those as great as the least of them, that reach `least`."""
    if s.shape[1] > n:
        edge = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(s >= np.maximum(edge, least)[:, None])
    else:
        i, j = np.nonzero(s >= least)
    return i + at, j, s[i, j]


def top_similar(vectors: DataFrame, k: int = 10, recall: float = 0.95, min_cosine: float | None = None, whole: float = 0.5, sample_rows: int = 8192, cell_rows: int = 65_536, visit_rows: int = 131_072, only_queries: bool = False) -> DataFrame:
    """(query, id, cosine, rank): for each query vector the k most similar stored vectors of its collection, rank from 1.

    vectors: (id, coll, q, vec) of unit_vectors(); q is false for stored vectors and true for those that only ask. With only_queries the
    stored vectors don't ask. An id never meets itself; an id that occurs with several vectors counts with the least of them. Ties go
    to the lesser id. With min_cosine only neighbours at least so similar are kept. recall is the share of the neighbours that the visited cells should hold; collections that
    need more than the share `whole` of their cells for it are searched whole. A cell of over cell_rows entries, or with over visit_rows queries to expect, is
    split over a grid of tasks. An empty input gives no rows.
    """
    one = vectors.groupBy("coll", "q", "id").agg(F.min("vec").alias("vec"))
    one = table(one.withColumn("cls", F.expr("unhex(md5(vec))")), "vectors")
    stored = one.where("NOT q")
    w = Window.partitionBy("coll", "cls").orderBy("id")
    heads = stored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)  # the limit is applied before the shuffle, too
    heads = heads.groupBy("coll", "cls").agg(F.min("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    books = table(codebooks(stored.select("coll", "cls", "vec"), k, min_cosine, recall, whole, sample_rows), "codebooks")
    entries = table(_cells(heads, books, True).select("*", F.col("seconds")[0].alias("second")).drop("seconds"), "entries")
    asking = one.where("q") if only_queries else one
    new = one.where("q").groupBy("coll", "cls").agg(F.min("vec").alias("vec")).join(entries.select("coll", "cls"), ["coll", "cls"], "left_anti")
    queries = entries.select("coll", "cls", "vec")
    queries = queries.join(one.where("q").select("coll", "cls"), ["coll", "cls"], "left_semi") if only_queries else queries
    queries = queries.unionByName(new)

    visits = _cells(queries, books, False).select("coll", "cls", "vec", "first", "seconds")
    targets = entries.select("coll", "first", "second", "cls", "vec")
    # queries to expect at a first centroid: as many of the collection's as it has of the entries, for each one that a query visits
    asks = asking.groupBy("coll").agg(F.count("*").alias("asks"))
    held = entries.groupBy("coll", "first").agg(F.count("*").alias("n"))
    expect = held.join(bounded(held.groupBy("coll").agg(F.sum("n").alias("all"))), "coll").join(bounded(asks), "coll").join(bounded(books.select("coll", F.least("k", F.greatest("probes", F.lit(1))).alias("firsts"))), "coll")
    grid = expect.select("coll", "first", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"), F.ceil(F.col("n") / F.col("all") * F.col("asks") * F.col("firsts") / visit_rows).cast("int").alias("vparts"))
    large = bounded(table(grid.where("parts > 1 OR vparts > 1"), "large-cells"))
    if large.isEmpty():
        visits, targets = (x.withColumns({"part": F.lit(0), "vpart": F.lit(0)}) for x in (visits, targets))
    else:
        own, every = (lambda c: F.pmod(F.xxhash64("cls"), F.coalesce(c, F.lit(1))).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)))
        visits = visits.join(large, ["coll", "first"], "left").withColumn("vpart", own("vparts")).withColumn("part", every("parts")).drop("parts", "vparts")
        targets = targets.join(large, ["coll", "first"], "left").withColumn("part", own("parts")).withColumn("vpart", every("vparts")).drop("parts", "vparts")

    least = -2.0 if min_cosine is None else min_cosine - 1e-5

    def rerank(p: pa.Table, e: pa.Table) -> pa.Table:
        i = j = np.zeros(0, dtype=np.int64)
        s = np.zeros(0)
        if len(p) and len(e):
            x = np.frombuffer(b"".join(p["vec"].to_pylist()), dtype=np.float32).reshape(len(p), -1)
            y = np.frombuffer(b"".join(e["vec"].to_pylist()), dtype=np.float32).reshape(len(e), -1)
            asked = p["seconds"].combine_chunks()
            who, what = np.repeat(np.arange(len(p)), np.asarray(asked.value_lengths())), np.asarray(asked.flatten())
            who = who[np.argsort(what, kind="stable")]
            what = np.sort(what)
            second = e["second"].to_numpy()
            order = np.argsort(second, kind="stable")
            second = second[order]
            found = []
            for cell in np.unique(second):
                q = who[np.searchsorted(what, cell) : np.searchsorted(what, cell, side="right")]
                own = order[np.searchsorted(second, cell) : np.searchsorted(second, cell, side="right")]
                z = y[own].astype(np.float64).T
                step = max(1, min(1024, (1 << 22) // len(own)))
                for at in range(0, len(q), step):
                    a, b, c = _block(x[q[at : at + step]].astype(np.float64) @ z, k + 1, least, at)
                    found.append((q[a], own[b], c))
            if found:
                i, j, s = (np.concatenate(z) for z in zip(*found, strict=True))
                order = np.lexsort((-s, i))  # of all cells here the k + 1 best of a query, and those as good as the least of them
                i, j, s = i[order], j[order], s[order]
                begin = np.searchsorted(i, i, side="left")
                edge = s[np.minimum(begin + k, np.searchsorted(i, i, side="right") - 1)]
                i, j, s = (z[s >= edge] for z in (i, j, s))
        who, at = np.unique(i, return_index=True)
        hits = pa.StructArray.from_arrays([pa.array(np.round(s, 9)), e["cls"].combine_chunks().take(pa.array(j))], names=["cosine", "other"])
        near = pa.ListArray.from_arrays(pa.array(np.append(at, len(i)), pa.int32()), hits)
        return pa.table([p["coll"].combine_chunks().take(pa.array(who)), p["cls"].combine_chunks().take(pa.array(who)), near], names=["coll", "cls", "near"])

    keys = ["coll", "first", "part", "vpart"]
    travels = expect.agg(F.sum(F.col("n") / F.col("all") * F.col("asks") * F.col("firsts"))).first()[0] or 0
    tasks = tasks_for(vectors.sparkSession, travels * 400)
    if tasks > int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        visits, targets = visits.repartition(tasks, *keys), targets.repartition(tasks, *keys)
    near = visits.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(rerank, "coll string, cls binary, near array<struct<cosine:double,other:binary>>")
    near = near.groupBy("coll", "cls").agg(F.flatten(F.collect_list("near")).alias("near"))
    edge = F.coalesce(F.get(F.sort_array(F.transform("near", lambda x: x["cosine"]), asc=False), F.lit(k)), F.lit(-9.0))
    best = near.withColumn("edge", edge).select("coll", "cls", F.explode(F.filter("near", lambda x: x["cosine"] >= F.col("edge"))).alias("x")).select("coll", "cls", "x.other", "x.cosine")
    ids = entries.select("coll", F.col("cls").alias("other"), "ids")
    # heads of the near classes in order; k + 1 ids are enough for every member of the asking class
    lists = best.join(ids, ["coll", "other"]).select("coll", "cls", "cosine", F.explode("ids").alias("id"))
    by = Window.partitionBy("coll", "cls").orderBy(F.desc("cosine"), "id")
    lists = lists.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("coll", "cls").agg(F.sort_array(F.collect_list(F.struct("n", "id", "cosine"))).alias("near"))
    members = asking.select("coll", "cls", F.col("id").alias("query"), "q")
    own = F.filter("near", lambda x: F.col("q") | (x["id"] != F.col("query")))
    return members.join(lists, ["coll", "cls"]).select("query", F.posexplode(F.slice(own, 1, k)).alias("i", "x")).select("query", "x.id", "x.cosine", (F.col("i") + 1).alias("rank"))


def collection_vectors(stored: DataFrame, requests: DataFrame, specs: DataFrame) -> DataFrame:
    """unit_vectors() of stored documents (collection in their JSON metadata) and search requests, at the dimension of their collection."""
    dims = bounded(specs.groupBy(F.col("name").alias("coll")).agg(F.max("embedding_dim").alias("dim")))
    s = stored.select("id", F.get_json_object("metadata", "$.collection").alias("coll"), "embedding", F.lit(False).alias("q"))
    r = requests.select(F.col("request_id").alias("id"), F.col("collection").alias("coll"), F.col("query_vector").alias("embedding"), F.lit(True).alias("q"))
    return unit_vectors(s.unionByName(r).join(dims, "coll"), "q")


def similar_pairs(vectors: DataFrame, k: int = 10, min_cosine: float = 0.94, **how) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b, with cosine at least min_cosine in which one is among the k most similar stored vectors of the other."""
    top = top_similar(vectors, k, min_cosine=min_cosine, **how).where(F.col("cosine") >= min_cosine - 1e-7)
    return top.select(F.least("query", "id").alias("id_a"), F.greatest("query", "id").alias("id_b")).where("id_a < id_b").distinct()
