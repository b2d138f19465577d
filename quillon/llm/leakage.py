"""Evaluation texts inside a training corpus: winnowed fingerprints.

Of every window of WINDOW consecutive k-grams (GRAM words each) the least hash is kept. Two texts that share
WINDOW + GRAM - 1 words in a row see the same window there and keep the same hash, so no such span is missed. A shared
hash is then extended word by word to both sides, and the span counts when it is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import table
from . import words as W

GRAM = 6


def winnow(texts: list[str | None], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, offsets, and the flat positions of the kept k-grams: any span of `span` shared words keeps one."""
    window = span - GRAM + 1
    w, at = W.word_hashes(texts)
    g = W.ngram_hashes(w, GRAM)
    if len(g) < window:
        return w, at, np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + np.arange(len(g) - window + 1)
    inside = np.repeat(at[1:], np.diff(at))[: len(least)] - np.arange(len(least)) >= span  # the window doesn't cross the text's end
    return w, at, np.unique(least[inside])


def shared_span(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Longest run of equal words through a[i] and b[j]: where it begins in a, and its length."""
    x, y = a[i::-1], b[j::-1]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    left = int(differ[0]) if len(differ) else n
    x, y = a[i:], b[j:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    right = int(differ[0]) if len(differ) else n
    return i - left + 1, left + right - 1 if left and right else 0


class _Items:
    """Fingerprints and words of the evaluation items, held by each worker."""

    def __init__(self, ids: list[int], texts: list[str | None], span: int):
        self.ids, self.span = ids, span
        self.w, self.at, kept = winnow(texts, span)
        grams = W.ngram_hashes(self.w, GRAM)[kept] if len(kept) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.hashes, self.kept = grams[order], kept[order]
        self.item = np.searchsorted(self.at, self.kept, side="right") - 1

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text's position, item's position, longest shared run) wherever a run is long enough."""
        w, at, kept = winnow(texts, self.span)
        if not len(kept) or not len(self.hashes):
            return []
        g = W.ngram_hashes(w, GRAM)[kept]
        lo, hi = np.searchsorted(self.hashes, g, "left"), np.searchsorted(self.hashes, g, "right")
        best: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(hi > lo):
            p = int(kept[k])
            t = int(np.searchsorted(at, p, side="right")) - 1
            a = w[at[t] : at[t + 1]]
            for q in range(int(lo[k]), int(hi[k])):
                i = int(self.item[q])
                n = shared_span(a, p - int(at[t]), self.w[self.at[i] : self.at[i + 1]], int(self.kept[q] - self.at[i]))[1]
                if n >= self.span:
                    best[t, i] = max(best.get((t, i), 0), n)
        return [(t, i, n) for (t, i), n in best.items()]


def _small_side(docs: DataFrame, ids: list[int], texts: list[str | None], span: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
    held: dict[int, _Items] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.get(span)
        if items is None:  # made once for each worker
            items = held[span] = _Items(*shared.value, span)
        for b in batches:
            found = items.leaks(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([t for t, _, _ in found], pa.int64())), pa.array([items.ids[i] for _, i, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int32())],
                names=["doc_id", "item_id", "words"],
            )

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, words int")


def _fingerprints(rows: DataFrame, id_name: str, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, at, kept = winnow(b.column(1).to_pylist(), span)
            g = W.ngram_hashes(w, GRAM)[kept] if len(kept) else np.zeros(0, dtype=np.uint64)
            t = np.searchsorted(at, kept, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(g.view(np.int64))], names=[id_name, "gram"])

    return rows.mapInArrow(run, f"{id_name} bigint, gram bigint").distinct()


def _joined(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    pairs = table(_fingerprints(docs, "doc_id", span).join(_fingerprints(items, "item_id", span), "gram").select("doc_id", "item_id").distinct(), "leak-pairs")
    both = pairs.join(docs.toDF("doc_id", "text_a"), "doc_id").join(items.toDF("item_id", "text_b"), "item_id").select("doc_id", "item_id", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            n = [max((x[2] for x in _Items([0], [y], span).leaks([t])), default=0) for t, y in zip(c["text_a"], c["text_b"], strict=True)]
            hit = pa.array([i for i, x in enumerate(n) if x >= span], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), b.column(1).take(hit), pa.array([x for x in n if x >= span], pa.int32())], names=["doc_id", "item_id", "words"])

    return both.mapInArrow(run, "doc_id bigint, item_id bigint, words int")


def leaked(docs: DataFrame, items: DataFrame, span: int = 12, small_mb: int = 64) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least `span` consecutive words of an item; words: the longest such run.

    docs (id, text) and items (id, text) by position. Evaluation material of up to small_mb MB of text, which is counted first, is sent to
    every executor, so the corpus is read once and never shuffled; more of it is joined by fingerprint. Null or short
    texts give nothing; a row for each pair of ids; span must be GRAM or more.
    """
    docs = docs.toDF("doc_id", "text").where("text IS NOT NULL").selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    items = items.toDF("item_id", "text").where("text IS NOT NULL").selectExpr("CAST(item_id AS bigint) AS item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= small_mb << 20:
        rows = items.collect()
        found = _small_side(docs, [r[0] for r in rows], [r[1] for r in rows], span)
    else:
        found = _joined(docs, items, span)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
