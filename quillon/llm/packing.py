"""Items of varying length in containers of fixed capacity: multiway differencing after Karmarkar and Karp.

Items are spread over shards of bounded size. In a shard every item starts as a partial partition of its own; again and
again the two partial partitions with the largest imbalance are merged so that the fullest windows of one meet the emptiest of the
other, which leaves near-equal windows. Their number is the least that can hold the items. Windows that fit and are full but for SLACK stay; the items of the others are
parted anew as long as that yields such windows. What differencing then leaves, which are mostly items of over half a window, is put by best fit, the largest first, and
the number of windows rises whenever the capacity is exceeded.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 0.002  # a window that fits stays if no more than this share of it is unused
YIELD = 0.02  # share of the windows that differencing must fill for another round
_ENCODERS: dict[str, object] = {}


def encoder(path: str, pattern: str):
    """A public byte-level BPE vocabulary (.tiktoken file) with its pattern of words, loaded once for each worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(id, tokens) of (id, text): a null text has 0 tokens. Lone surrogates and other invalid characters count as their replacement.

    vocabulary is a file of the driver's, which is sent to every executor; pattern is its tokenizer's pattern of words.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "tokens"])

    return df.mapInArrow(run, f"id {df.schema[0].dataType.simpleString()}, tokens bigint")


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and each window's sum, after multiway differencing into k windows."""
    # a node is an item or the union of two nodes; a partial partition is its non-empty windows, fullest first, as (sums, nodes)
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s, x = heapq.heappop(heap)
        _, _, t, y = heapq.heappop(heap)
        both = len(s) + len(t) - k
        if both > 0:  # the emptiest windows of one take the fullest of the other
            i, j = np.arange(len(s) - both, len(s)), np.arange(len(t) - 1, len(t) - 1 - both, -1)
            made = np.arange(len(left), len(left) + both)
            left += x[i].tolist()
            right += y[j].tolist()
            sums = np.concatenate([s[: len(s) - both], s[i] + t[j], t[: len(t) - both]])
            nodes = np.concatenate([x[: len(x) - both], made, y[: len(y) - both]])
        else:
            sums, nodes = np.concatenate([s, t]), np.concatenate([x, y])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        imbalance = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-imbalance, n, sums, nodes))
        n += 1
    window = np.full(len(sizes), -1, dtype=np.int64)
    if heap:
        for w, node in enumerate(heap[0][3]):
            todo = [int(node)]
            while todo:
                v = todo.pop()
                if v < len(sizes):
                    window[v] = w
                else:
                    todo += [left[v], right[v]]
    return window, heap[0][2] if heap else np.zeros(0, dtype=np.int64)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item: the largest first, each where it leaves the least space."""
    out = np.full(len(sizes), -1, dtype=np.int64)
    free: list[tuple[int, int]] = []
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        space, window = free.pop(at) if at < len(free) else (capacity, used)
        used += window == used
        out[i] = window
        insort(free, (space - size, window))
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item (each at most capacity): no window's sum exceeds the capacity."""
    out = np.full(len(sizes), -1, dtype=np.int64)
    full = sizes == capacity
    out[full] = np.arange(full.sum())
    rest, used = np.flatnonzero(~full), int(full.sum())
    while len(rest):
        window, sums = difference(sizes[rest], -(-int(sizes[rest].sum()) // capacity) or 1)
        keep = (sums <= capacity) & ((sums >= capacity * (1 - SLACK)) | (sums[0] <= capacity))
        if keep.sum() <= YIELD * len(sums):
            break
        number = np.cumsum(keep) - 1 + used
        stay = keep[window]
        out[rest[stay]] = number[window[stay]]
        used += int(keep.sum())
        rest = rest[~stay]
    out[rest] = best_fit(sizes[rest], capacity) + used
    return out


def pieces(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, size): an item that alone exceeds the capacity becomes full pieces and a rest, any other one piece."""
    n = np.maximum(-(-tokens // capacity), 1)
    item = np.repeat(np.arange(len(tokens)), n)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    return item, piece, np.minimum(tokens[item] - piece * capacity, capacity)


def packed(items: DataFrame, profiles: DataFrame, shard_rows: int = 3_000) -> DataFrame:
    """(profile, container, id, piece, first_token, tokens): every item of (id, tokens) in containers of each profile (profile, capacity_tokens).

    container is unique within a profile. An item over the capacity alone is split into pieces of the capacity and a rest; no other item is
    split. An item of no tokens stands in a container with tokens 0; null tokens count as 0. Repeated rows are items of their own. Profiles with
    a null or non-positive capacity are left out. An empty input gives no rows.
    """
    kind = items.schema["id"].dataType.simpleString()
    caps = [(r[0], r[1]) for r in profiles.select("profile", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1_001).collect()]
    if len(caps) > 1_000:
        raise ValueError("profiles are a few configured sizes: at most 1,000")
    schema = f"profile string, container bigint, id {kind}, piece int, first_token bigint, tokens bigint"
    if not caps:
        return items.sparkSession.createDataFrame([], schema)
    n = max(1, -(-items.count() // shard_rows))
    spread = items.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens")).withColumn("shard", F.pmod(F.hash(F.xxhash64("id"), F.monotonically_increasing_id()), F.lit(n)))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for profile, capacity in caps:
            item, piece, size = pieces(p["tokens"].to_numpy(), capacity)
            window = pack(size, capacity)
            out.append(pd.DataFrame({"profile": profile, "container": window * n + key[0], "id": p["id"].to_numpy()[item], "piece": piece, "first_token": piece * capacity, "tokens": size}))
        return pd.concat(out)

    # every shard is a unit of work of its own: small output must not gather them in one task
    tasks = min(n, 4 * items.sparkSession.sparkContext.defaultParallelism) if n < 10_000 else n // 4
    return spread.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, schema)
