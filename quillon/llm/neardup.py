"""Near-duplicate records: vantage-point trees over Hamming fingerprints.

1. Texts whose words are the same in the same order form one class; a class enters the search once, however many
   copies it has.
2. A class gets MinHash symbols of its distinct three-word runs. One bit of each of 128 symbols makes a fingerprint, so the Hamming
   distance of two fingerprints grows with 1 - likeness.
3. Whole-collection vantage trees prune nothing at a likeness of 0.5: fingerprints of strangers lie 64 +- 6 from any vantage point, less than the search
   radius apart from each other. The trees are therefore planted in shards: classes that agree in one segment of three MinHash symbols.
4. A shard is searched by a vantage-point tree: it is split at the median Hamming distance from a vantage fingerprint,
   and only members whose distance lies within the radius of the boundary are compared across it (triangle bound). Shards of up to LEAF
   members are leaves.
5. A shard with more than `shard_rows` members is cut, in order of distance from its vantage fingerprint, into blocks of that size, and only
   blocks nearer to each other than the radius meet, each pair of blocks in a task of its own.
6. Pairs within the radius are checked exactly by their runs, which are kept as 32-bit hashes (two texts of 100 runs see a run shared that isn't with
   a chance of 2e-6); no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import bounded, table, tasks_for
from . import words as W

SEGMENTS, ROWS, SHINGLE = 64, 3, 3
SYMBOLS = SEGMENTS * ROWS
HALF = 64  # bits in each half of a fingerprint
RADIUS = 51  # of 128 bits: unrelated texts differ in 64 +- 6, texts of likeness 0.5 in 32 +- 5
LEAF = 16


def keyed(df: DataFrame, id_col: str, text_col: str, min_words: int, runs: bool) -> DataFrame:
    """(id, cls) of each row whose text has min_words words or more, and where asked its distinct runs as sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, at = W.word_hashes(b.column(1).to_pylist())
            keep = [i for i in range(b.num_rows) if at[i + 1] - at[i] >= max(min_words, SHINGLE)]
            cols = [b.column(0).take(pa.array(keep, pa.int64())), pa.array([W.text_key(w[at[i] : at[i + 1]]) for i in keep], pa.binary())]
            if runs:
                grams = (W.ngram_hashes(w, SHINGLE) >> np.uint64(32)).astype(np.uint32)
                cols.append(pa.array([np.unique(grams[at[i] : at[i + 1] - SHINGLE + 1]).tobytes() for i in keep], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "cls", "runs"][: len(cols)])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"id {kind}, cls binary" + (", runs binary" if runs else ""))


def fingerprints(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each segment of the symbols (a row for each text), and the fingerprint's two halves."""
    n = np.array([len(r) // 4 for r in runs], dtype=np.int64)
    if not len(n):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((0, SEGMENTS), dtype=np.int64), none, none
    h = W.mix(np.frombuffer(b"".join(runs), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    m = W.minhash(h, np.cumsum(n) - n, SYMBOLS).astype(np.uint64)
    k = W.odd_constants(17, ROWS)
    segments = W.mix((W.mix(m).reshape(len(n), SEGMENTS, ROWS) * k).sum(axis=2, dtype=np.uint64) + np.arange(SEGMENTS, dtype=np.uint64))
    bits = W.mix(m[:, : 2 * HALF] + np.uint64(7)) & np.uint64(1)
    place = np.uint64(1) << np.arange(HALF, dtype=np.uint64)
    low, high = ((x * place).sum(axis=1, dtype=np.uint64) for x in (bits[:, :HALF], bits[:, HALF:]))
    return segments.view(np.int64), low.view(np.int64), high.view(np.int64)


def shards_of(classes: DataFrame) -> DataFrame:
    """(key, cid, low, high): each class (cid, runs) in its shards, one for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segments, low, high = fingerprints(b.column(1).to_pylist())
            cid = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(segments.ravel()), *(pa.array(np.repeat(x, SEGMENTS)) for x in (cid, low, high))], names=["key", "cid", "low", "high"])

    return classes.select("cid", "runs").mapInArrow(run, "key bigint, cid bigint, low bigint, high bigint")


def hamming(low: np.ndarray, high: np.ndarray, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j]).astype(np.int16)


def _across(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, out: list) -> None:
    for at in range(0, len(a), 512):
        x = a[at : at + 512, None]
        hit = np.nonzero(hamming(low, high, x, b[None, :]) <= radius)
        out.append((a[at : at + 512][hit[0]], b[hit[1]]))


def tree_pairs(low: np.ndarray, high: np.ndarray, members: np.ndarray, radius: int, out: list) -> None:
    """Appends to out the positions of all pairs of members within radius, found by a vantage-point tree."""
    todo = [members]
    while todo:
        m = todo.pop()
        if len(m) <= LEAF:
            i, j = np.triu_indices(len(m), 1)
            near = hamming(low, high, m[i], m[j]) <= radius
            out.append((m[i][near], m[j][near]))
            continue
        d = hamming(low, high, m[0], m)
        middle = int(np.median(d))
        inner = d <= middle
        if inner.all():  # no boundary splits them: all are as far from the vantage point
            _triangle(low, high, m, radius, out)
            continue
        todo += [m[inner], m[~inner]]
        a, b = m[inner & (d >= middle + 1 - radius)], m[~inner & (d <= middle + radius)]
        _across(low, high, a, b, radius, out)


def _triangle(low: np.ndarray, high: np.ndarray, m: np.ndarray, radius: int, out: list) -> None:
    for at in range(0, len(m), 512):
        rows = np.arange(at, min(at + 512, len(m)))
        hit = np.nonzero((hamming(low, high, m[rows][:, None], m[None, :]) <= radius) & (rows[:, None] < np.arange(len(m))[None, :]))
        out.append((m[rows][hit[0]], m[hit[1]]))


def shard_pairs(shards: DataFrame, radius: int, tasks: int) -> DataFrame:
    """(a, b), a < b, of the cids within radius in each shard. shards: (key, side, cid, low, high), each shard small; of a shard with sides 1 and 2 only
    pairs across count, of one with side 0 all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 5

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, side, cid, low, high = cols
            out: list = []
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(np.append(bounds, len(key)))
            low, high = low.view(np.uint64), high.view(np.uint64)
            sided = side[bounds] > 0
            large = (sizes > LEAF) | sided
            for b, n, two in zip(bounds[large], sizes[large], sided[large], strict=True):
                members = np.arange(b, b + n)
                if two:
                    _across(low, high, members[side[b : b + n] == 1], members[side[b : b + n] == 2], radius, out)
                else:
                    tree_pairs(low, high, members, radius, out)
            ends = np.repeat(bounds + sizes, sizes) * ~np.repeat(large, sizes) if len(key) else bounds
            i = np.arange(len(key))
            for step in range(1, LEAF):  # the leaves of all small shards at once
                i = i[i + step < ends[i]]
                if not len(i):
                    break
                near = hamming(low, high, i, i + step) <= radius
                out.append((i[near], i[near] + step))
            x = np.concatenate([cid[a] for a, _ in out]) if out else np.zeros(0, dtype=np.int64)
            y = np.concatenate([cid[b] for _, b in out]) if out else np.zeros(0, dtype=np.int64)
            xy = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            xy = xy[:, xy[0] != xy[1]]
            return pa.RecordBatch.from_arrays([pa.array(xy[0]), pa.array(xy[1])], names=["a", "b"])

        for b in batches:
            cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last shard may go on in the next batch
            rest = [c[last:] for c in cols]
            if last:
                yield found([c[:last] for c in cols])
        if len(rest[0]):
            yield found(rest)

    return shards.repartition(tasks, "key").sortWithinPartitions("key").select("key", "side", "cid", "low", "high").mapInArrow(run, "a bigint, b bigint")


def _blocks(shard: DataFrame, rows: int, radius: int) -> DataFrame:
    """Shards (key, side, cid, low, high) for pairs of blocks of the large shards (key, cid, low, high): a shard's members in order of distance from its
    vantage fingerprint, in blocks of about `rows`; each block meets itself and those within the radius. A row is copied once for each block it meets."""
    vantage = shard.groupBy("key").agg(F.min_by(F.struct("low", "high"), "cid").alias("v"), F.count("*").alias("n"))
    d = shard.join(vantage, "key").withColumn("d", F.expr("bit_count(low ^ v.low) + bit_count(high ^ v.high)"))
    # how many members lie nearer: a row for each distance of each shard
    nearer = d.groupBy("key", "d").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(nearer.withColumn("before", before), ["key", "d"])
    place = F.col("before") + F.col("c") * (F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) / (1 << 20))
    d = d.select("key", "cid", "low", "high", "d", F.floor(place / rows).alias("block"))
    reach = d.groupBy("key", "block").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    x, y = reach.alias("x"), reach.alias("y")
    meet = x.join(y, "key").where(F.col("x.block") <= F.col("y.block")).where(F.col("y.least") - F.col("x.most") <= radius)
    meet = meet.select("key", F.col("x.block").alias("bx"), F.col("y.block").alias("by"), F.xxhash64("key", "x.block", "y.block").alias("key2"))
    end = lambda c, side: F.struct(F.col(c).alias("block"), F.lit(side).cast("bigint").alias("side"))
    ends = meet.select("key", "key2", F.explode(F.when(F.col("bx") == F.col("by"), F.array(end("bx", 0))).otherwise(F.array(end("bx", 1), end("by", 2)))).alias("e"))
    return d.join(ends.select("key", "key2", "e.block", "e.side"), ["key", "block"]).select(F.col("key2").alias("key"), "side", "cid", "low", "high")


def candidate_pairs(classes: DataFrame, radius: int = RADIUS, shard_rows: int = 20_000) -> DataFrame:
    """Distinct (a, b) of the cids of classes (cid, runs) within the radius in some shard. Which shards are large, a sixteenth of the classes tells."""
    shards, tasks = shards_of(classes), tasks_for(classes.sparkSession, classes.count() * SEGMENTS * 40)
    some = shards_of(classes.where("pmod(cid, 16) = 0")).groupBy("key").count().where(F.col("count") > shard_rows / 16).select("key")
    large = bounded(table(some, "large"))
    whole = F.lit(0).cast("bigint").alias("side")
    if large.isEmpty():
        return shard_pairs(shards.select("key", whole, "cid", "low", "high"), radius, tasks).distinct()
    small = shards.join(large, "key", "left_anti").select("key", whole, "cid", "low", "high")
    hot = table(shards.join(large, "key", "left_semi"), "large-shards")
    many = hot.groupBy("key").count().agg(F.sum(F.col("count") * F.ceil(F.col("count") / shard_rows))).first()[0] or 0  # rows once copied to the blocks they meet
    return shard_pairs(small, radius, tasks).union(shard_pairs(_blocks(hot, shard_rows, radius), radius, tasks_for(classes.sparkSession, many * 40))).distinct()


def class_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, cls, first, size) has one row for each id and class, links (cls_a, cls_b) each pair of
    classes whose texts' likeness is at least the threshold.

    first is the least id of the class, size the number of its ids. Null texts, texts of fewer than min_words words and null ids take part in
    nothing; of an id that occurs with several texts, each counts. Rows that repeat an id and text count once.
    """
    classes = keyed(df, id_col, text_col, min_words, True).groupBy("cls").agg(F.first("runs").alias("runs"))
    classes = table(classes.withColumn("cid", F.conv(F.substring(F.hex("cls"), 1, 15), 16, 10).cast("bigint")), "classes")
    pairs = table(candidate_pairs(classes), "pairs")
    a, b = (classes.select(F.col("cid").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("runs").alias(f"runs_{x}")) for x in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for i, (p, q) in enumerate(zip(batch.column("runs_a").to_pylist(), batch.column("runs_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(p, dtype=np.uint32), np.frombuffer(q, dtype=np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    hit.append(i)
            yield batch.select(["cls_a", "cls_b"]).take(pa.array(hit, pa.int64()))

    # both sides grow with the data
    links = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("cls_a", "cls_b", "runs_a", "runs_b").mapInArrow(exact, "cls_a binary, cls_b binary").distinct()
    members = table(keyed(df, id_col, text_col, min_words, False).distinct(), "members")
    sizes = members.groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    return members.join(sizes, "cls").select("id", "cls", "first", "size"), table(links, "links")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, min_words: int = 20, spelled_out: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose texts' likeness is at least the threshold, equal texts included.

    A class of up to `spelled_out` copies is written as all its pairs. A larger class is written without loss as its first id
    with each other copy, and its links to other texts as links of that first id.
    """
    members, links = class_links(df, id_col, text_col, threshold, min_words)
    members = table(members, "members")
    speaks = members.where((F.col("size") <= spelled_out) | (F.col("id") == F.col("first")))
    x, y = speaks.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), speaks.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    between = links.join(x, "cls_a").join(y, "cls_b").select("x", "y")
    small = members.where((F.col("size") > 1) & (F.col("size") <= spelled_out))
    within = small.select("cls", F.col("id").alias("x")).join(small.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    star = members.where((F.col("size") > spelled_out) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    return (
        between.unionByName(within).unionByName(star).where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, min_words: int = 20) -> DataFrame:
    """One row for each id and class: (id, class_id, copies, links): class_id is the first id with the same words, copies how many ids
    have them, links to how many other classes its text is near."""
    members, links = class_links(df, id_col, text_col, threshold, min_words)
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(ends, "cls", "left").select("id", F.col("first").alias("class_id"), F.col("size").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
