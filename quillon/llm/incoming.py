"""New batches against everything accepted before: a stored segment index for edit distance.

A text stands for its words, of which each run of three is kept as a 32-bit hash (two texts of 100 runs see a run shared that isn't with a chance
of 2e-6). Its *sequence* is its distinct runs in the order in which they first occur: repetition adds nothing to it, as it adds
nothing to the likeness. With sequences of a and b runs, s of them shared, the likeness is s / (a + b - s). Where the shared runs keep their order, the
least number of insertions and deletions that turn one sequence into the other is a + b - 2 s, so a likeness of t or more is the same as a
distance of at most (a + b) (1 - t) / (1 + t): the bound.

The index stores, for each distinct text, a fixed number of disjoint segments that depends on its length alone (one of six words for each
six, evenly spaced) by length and position, in partitions of lengths between two powers of two. A batch's text probes with its six-word substrings; only
segments of texts whose length leaves room for the threshold are met, and the positions tell whether the pair can be within the bound. If so, it is accepted
by bounded edit distance; if not, or beyond the bound, a block may have moved, and the likeness itself decides.

A word put in, left out or replaced touches one segment and costs three to five runs of both texts together, weighed as the likeness weighs them: at a
likeness of 0.5 such edits touch at most a seventh of a stored text's runs in segments, of which it has a sixth, so some stay whole. Only where nearly all
edits are of two adjacent words in two segments, or nearly all segments are torn apart by moves, could none stay. Texts of under SHORT distinct
runs store all their substrings, and those of under half as many, which only repetitive texts have, each single run as well.

A batch is accepted by reading the index and the batch alone; what it adds is appended. No text of the history is read again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..shared import bounded, table
from . import words as W

SEGMENT, SPACING, SHORT, SHINGLE = 4, 6, 36, 3  # runs of a segment (six words), words for each segment, runs of a short sequence, words of a run
TEXTS, SPELLINGS = "cls binary, sid bigint, first bigint, length int, runs binary", "key binary, first bigint"
PLACE = "segment bigint, sid bigint, first bigint, length int, words int, start int"
SEGMENTS = f"band int, {PLACE}"
PLACES = [c.split()[0] for c in PLACE.split(", ")]


class Index(NamedTuple):
    """texts: each distinct text by its words, and the least ord at which it was accepted; segments: its segments by length and position; spellings: the
    least ord of each text, white space around it aside."""

    texts: DataFrame
    segments: DataFrame
    spellings: DataFrame

    def append_to(self, path: str) -> None:
        """Appends these tables to those stored below path, segments in a folder for each band of lengths."""
        self.texts.write.mode("append").parquet(f"{path}/texts")
        self.segments.write.mode("append").partitionBy("band").parquet(f"{path}/segments")
        self.spellings.write.mode("append").parquet(f"{path}/spellings")

    def union(self, other: Index) -> Index:
        return Index(*(a.unionByName(b) for a, b in zip(self, other, strict=True)))


def stored(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in (("texts", TEXTS), ("segments", SEGMENTS), ("spellings", SPELLINGS))))


def empty(spark: SparkSession) -> Index:
    return Index(*(spark.createDataFrame([], kind) for kind in (TEXTS, SEGMENTS, SPELLINGS)))


def run_hashes(texts: list[str | None], min_words: int) -> tuple[list[int], list[np.ndarray]]:
    """Of the texts with at least min_words words: their positions and the hashes of their runs of words."""
    w, at = W.word_hashes(texts)
    grams = (W.ngram_hashes(w, SHINGLE) >> np.uint64(32)).astype(np.uint32)
    keep = [i for i in range(len(texts)) if at[i + 1] - at[i] >= max(min_words, SHINGLE)]
    return keep, [grams[at[i] : at[i + 1] - SHINGLE + 1] for i in keep]


def sequence(runs: np.ndarray, length: int) -> np.ndarray:
    """The distinct runs, length in number, in the order of their first places."""
    return runs if len(runs) == length else runs[np.sort(np.unique(runs, return_index=True)[1])]


def pieces(runs: list[bytes], length: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's position, start, hash) of the distinct segments, or of every substring that can equal one; and each text's number of words."""
    n = np.array([len(r) // 4 for r in runs], dtype=np.int64)
    flat = np.frombuffer(b"".join(runs), dtype=np.uint32).astype(np.uint64)
    at = np.cumsum(n) - n
    k = W.odd_constants(29, SEGMENT + 1)
    whole = np.maximum(n - SEGMENT + 1, 0)
    many = whole if every else np.where(length < SHORT, whole, (n + SHINGLE - 1) // SPACING)
    row = np.repeat(np.arange(len(n)), many)
    no = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = no * (n[row] - SEGMENT) // np.maximum(many[row] - 1, 1)
    p = at[row] + start
    long = W.mix(sum(flat[p + j] * k[j] for j in range(SEGMENT))) if len(p) else np.zeros(0, dtype=np.uint64)
    few = np.where(length < SHORT // 2, n, 0)
    row_1 = np.repeat(np.arange(len(n)), few)
    start_1 = np.arange(len(row_1)) - np.repeat(np.cumsum(few) - few, few)
    single = W.mix(flat[at[row_1] + start_1] * k[SEGMENT] + np.uint64(1)) if len(row_1) else np.zeros(0, dtype=np.uint64)
    row, start, h = np.concatenate([row, row_1]), np.concatenate([start, start_1]).astype(np.int32), np.concatenate([long, single]).view(np.int64)
    if (n != length).any():  # of a segment that occurs twice in a text the first place counts
        order = np.lexsort((start, h, row))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
        row, start, h = (x[order[first]] for x in (row, start, h))
    return row, start, h, (n + SHINGLE - 1).astype(np.int32)


def sketch(rows: DataFrame, min_words: int) -> DataFrame:
    """(ord, cls, length, runs) of the rows (ord, text) with at least min_words words: runs in order, length the number of distinct ones. cls tells the texts' words apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keep, hashes = run_hashes(texts, min_words)
            runs = [x.tobytes() for x in hashes]
            cols = [b.column(0).take(pa.array(keep, pa.int64())), pa.array(map(xxhash.xxh3_128_digest, runs), pa.binary()), pa.array([len(np.unique(x)) for x in hashes], pa.int32()), pa.array(runs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["ord", "cls", "length", "runs"])

    return rows.select("ord", "text").where("ord IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "ord bigint, cls binary, length int, runs binary")


def cut(rows: DataFrame, ids: list[str], every: bool) -> DataFrame:
    """The segments (or, with every, all substrings) of rows (*ids, length, runs): (*ids, length, words, start, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(len(ids)).to_numpy()
            row, start, segment, words = pieces(b.column(len(ids) + 1).to_pylist(), n, every)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(ids) + 1)), pa.array(words[row]), pa.array(start), pa.array(segment)], names=[*ids, "length", "words", "start", "segment"])

    return rows.select(*ids, "length", "runs").mapInArrow(run, ", ".join(f"{i} bigint" for i in ids) + ", length int, words int, start int, segment bigint")


def spelt(rows: DataFrame) -> DataFrame:
    """(ord, key) of rows (ord, text): key tells texts apart, white space around them aside."""
    return rows.where("ord IS NOT NULL AND text IS NOT NULL").select("ord", F.unhex(F.md5(strip(F.col("text")))).alias("key"))


def added(sketched: DataFrame, spelt: DataFrame) -> Index:
    """The index of a batch alone, its texts written once."""
    texts = sketched.groupBy("cls").agg(F.min("ord").alias("first"), F.first("length").alias("length"), F.first("runs").alias("runs"))
    texts = table(texts.withColumn("sid", F.conv(F.substring(F.hex("cls"), 1, 15), 16, 10).cast("bigint")).select("cls", "sid", "first", "length", "runs"), "texts")
    segments = cut(texts, ["sid", "first"], False).withColumn("band", F.floor(F.log2("length")).cast("int")).select("band", *PLACES)
    return Index(texts, segments, spelt.groupBy("key").agg(F.min("ord").alias("first")))


def edits_between(x: np.ndarray, y: np.ndarray, most: float) -> int | None:
    """Least insertions and deletions of runs that turn x into y, or None when over `most`; no run occurs twice in either.

    The longest common subsequence of such sequences is the longest increasing one of y's places in x.
    """
    if abs(len(x) - len(y)) > most:
        return None
    order = np.argsort(x)
    at = np.minimum(np.searchsorted(x, y, sorter=order), len(x) - 1)
    place = order[at]
    place = place[x[place] == y]
    if len(x) + len(y) - 2 * len(place) > most:
        return None
    tails: list[int] = []
    for p in place.tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    d = len(x) + len(y) - 2 * len(tails)
    return d if d <= most else None


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 0.0


def hits(probing: DataFrame, segments: DataFrame, threshold: float, hot_rows: int = 2_000, salts: int = 64) -> DataFrame:
    """Distinct (ord, sid, near): a stored text accepted before `ord` that shares a segment with it and has a fitting length; near: whether some
    shared segment stands where a distance within the bound leaves it.

    probing: (ord, length, runs). Segments that over hot_rows texts share, which a sixteenth of them tells well enough, are spread over `salts` tasks.
    """
    probes = cut(probing, ["ord"], True).selectExpr("ord", "length AS b", "words AS words_b", "start AS q", "segment")
    frequent = segments.where("pmod(sid, 16) = 0").groupBy("segment").count().where(F.col("count") > hot_rows / 16).select("segment")
    frequent = table(frequent, "hot")
    on = ["segment"]
    if not frequent.isEmpty():
        frequent = bounded(frequent).withColumn("hot", F.lit(True))
        segments = segments.join(frequent, "segment", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
        probes = probes.join(frequent, "segment", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        on = ["segment", "salt"]
    fits = F.expr(f"first < ord AND length >= {threshold} * b - 1e-6 AND b >= {threshold} * length - 1e-6")
    shift = F.abs(F.col("q") - F.col("start")) + F.abs((F.col("words_b") - F.col("q")) - (F.col("words") - F.col("start")))
    near = shift <= (F.col("length") + F.col("b")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return probes.join(segments, on).where(fits).groupBy("ord", "sid").agg(F.max(near).alias("near"))


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (ord, near, runs, length, runs_2, length_2) those alike: (ord, edits), edits null where only the likeness tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, edits = [], []
            for i, (near, p, n, q, m) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                x, y = sequence(np.frombuffer(p, dtype=np.uint32), n), sequence(np.frombuffer(q, dtype=np.uint32), m)
                d = edits_between(x, y, (len(x) + len(y)) * (1 - threshold) / (1 + threshold) + 1e-6) if near else None
                if d is not None or likeness(x, y) >= threshold:
                    hit.append(i)
                    edits.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), pa.array(edits, pa.int32())], names=["ord", "edits"])

    return pairs.select("ord", "near", "runs", "length", "runs_2", "length_2").mapInArrow(run, "ord bigint, edits int")


def accept(index: Index, batch: DataFrame, threshold: float = 0.5, min_words: int = 20, **how) -> tuple[DataFrame, Index]:
    """(verdicts, additions): what was seen before in the index or in a row of lower ord of the batch, and what to append to the index.

    batch: (ord, text). verdicts: (ord, kind, edits) with a row for each ord seen before. kind is `exact` when an earlier text is equal but for surrounding white space, else
    `near` when the likeness to an earlier one is at least the threshold; edits is the least number of inserted and deleted runs to an earlier
    text where the edit distance tells, 0 for the same sequence, null where only a moved block's likeness does. Null texts, null ords and texts of fewer
    than min_words words are never reported and match nothing. Partitions of lengths that the batch can't meet are not read.
    """
    s, keys = table(sketch(batch, min_words), "batch"), spelt(batch)
    new = added(s, keys)
    known = table(index.texts.select("cls", "first").join(bounded(new.texts.select("cls")), "cls", "left_semi"), "known")
    texts = new.texts.join(known, "cls", "left_anti")
    segments = new.segments.join(known.select(F.conv(F.substring(F.hex("cls"), 1, 15), 16, 10).cast("bigint").alias("sid")), "sid", "left_anti")
    old_keys = table(index.spellings.join(bounded(new.spellings.select("key")), "key", "left_semi"), "old-keys")
    additions = Index(table(texts, "new-texts"), table(segments.select(*new.segments.columns), "new-segments"), table(new.spellings.join(old_keys.select("key"), "key", "left_anti"), "new-spellings"))

    # neither side of these joins is bounded
    rows = s.hint("merge").join(known.unionByName(additions.texts.select("cls", "first")).groupBy("cls").agg(F.min("first").alias("first")), "cls")
    same = rows.where("first < ord").select("ord", F.lit("near").alias("kind"), F.lit(0).alias("edits"))
    fresh = table(rows.where("first = ord").select("ord", "runs", "length"), "fresh")
    low, high = fresh.agg(F.min("length"), F.max("length")).first()
    old = index.segments.where(f"band BETWEEN {int(np.log2(max(low * threshold, 1)))} AND {int(np.log2(high / threshold))}") if low is not None else index.segments
    pairs = table(hits(fresh, old.select(*PLACES).unionByName(additions.segments.select(*PLACES)), threshold, **how), "hits")
    every = index.texts.unionByName(additions.texts).select("sid", F.col("runs").alias("runs_2"), F.col("length").alias("length_2"))
    near = verified(pairs.hint("merge").join(every, "sid").hint("merge").join(fresh, "ord"), threshold).select("ord", F.lit("near").alias("kind"), "edits")

    least = old_keys.unionByName(additions.spellings).groupBy("key").agg(F.min("first").alias("least"))
    exact = keys.join(s.select("ord"), "ord", "left_semi").join(least, "key").where("least < ord").select("ord", F.lit("exact").alias("kind"), F.lit(0).alias("edits"))
    return same.union(near).union(exact).groupBy("ord").agg(F.min("kind").alias("kind"), F.min("edits").alias("edits")), additions


def seed(history: DataFrame, min_words: int = 20) -> Index:
    """The index of a history (text) accepted before any batch: its ord is -1. Repeated rows count once."""
    rows = history.select(F.lit(-1).cast("bigint").alias("ord"), "text")
    index = added(sketch(rows, min_words), spelt(rows))
    return Index(index.texts, table(index.segments, "segments"), index.spellings)


def seen_before(history: DataFrame, incoming: DataFrame, threshold: float = 0.5, min_words: int = 20) -> DataFrame:
    """(ord, kind) of the incoming rows (ord, text) whose text was accepted before, in history (text) or in an incoming row of lower ord: the
    history's index, and one accept() for all batches, whose order ord keeps."""
    new = incoming.select(F.col("ord").cast("bigint").alias("ord"), "text")
    return accept(seed(history, min_words), new, threshold, min_words)[0].select("ord", "kind")
