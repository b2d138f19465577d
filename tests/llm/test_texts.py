"""Near-duplicates, new batches, leakage: against brute force, and on awkward input."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import incoming, leakage, neardup
from quillon.llm import words as W

VOCABULARY = [f"w{i}" for i in range(400)]


def texts(n, seed):
    """Texts of which many are edited copies of others."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split(" ")
            for _ in range(r.randint(0, 9)):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 2)] = r.choices(VOCABULARY, k=r.randint(0, 2))
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = w[k:] + w[:k]
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choices(VOCABULARY, k=r.randint(15, 90))))
    return out


ODD = [None, "", " ", "\n\n", "few words only", "x " * 30_000, "​", "Ä" * 5_000]


def brute_pairs(rows):
    out = set()
    w = {i: W.words(t) for i, t in rows}
    for i in w:
        for j in w:
            if i < j and min(len(w[i]), len(w[j])) >= 20 and W.likeness(w[i], w[j]) >= 0.5:
                out.add((i, j))
    return out


def table(spark, values):
    """With columns whose names clash with those used inside."""
    return spark.createDataFrame([(f"r{i:04}", t, "c", 1, "p", "q") for i, t in enumerate(values)], "rid string, body string, cls string, cid int, id string, text string")


def test_near_duplicates_equal_brute_force(spark):
    rows = texts(220, 1) + ODD
    df = table(spark, rows)
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df.union(df.limit(30)), "rid", "body").collect()}
    want = brute_pairs([(f"r{i:04}", t) for i, t in enumerate(rows)])
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 80


def test_pairs_at_the_threshold(spark):
    """2,000 pairs at a likeness of 0.50 to 0.55."""
    rows = []
    for k in range(2_000):
        w = [f"{k}x{i}" for i in range(60)]
        v = w[: 41 + k % 2] + [f"{k}z{i}" for i in range(19 - k % 2)]
        assert 0.5 <= W.likeness(w, v) <= 0.55
        rows += [" ".join(w), " ".join(v)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "rid bigint, body string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "rid", "body").collect()}
    want = {(i, i + 1) for i in range(0, 4_000, 2)}
    assert got <= want and len(got) >= 1_998


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicate_pairs(table(spark, ["x"]).limit(0), "rid", "body").count() == 0
    assert neardup.near_duplicate_groups(table(spark, ODD[:5]), "rid", "body").count() == 0


def test_many_copies_are_a_star(spark):
    rows = ["one two three " * 10 + "copy"] * 100 + ["one two three " * 10 + "other"]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(table(spark, rows), "rid", "body").collect()}
    assert got == {("r0000", f"r{i:04}") for i in range(1, 101)}
    groups = {r.id: (r.class_id, r.copies, r.links) for r in neardup.near_duplicate_groups(table(spark, rows), "rid", "body").collect()}
    assert groups["r0099"] == ("r0000", 100, 1) and groups["r0100"] == ("r0100", 1, 1)


def test_large_shards_are_cut_without_loss(spark):
    base = " ".join(VOCABULARY[:60])
    rows = [base + " " + " ".join(random.Random(i).choices(VOCABULARY, k=12)) for i in range(150)]
    classes = neardup.keyed(table(spark, rows), "rid", "body", 20, True).select(F.xxhash64("cls").alias("cid"), "runs").cache()
    whole, cut = ({tuple(r) for r in neardup.candidate_pairs(classes, shard_rows=n).collect()} for n in (20_000, 20))
    assert whole == cut and len(whole) > 1_000


def test_tree_finds_all_within_the_radius():
    import numpy as np

    r = np.random.default_rng(1)
    low, high = (r.integers(0, 1 << 48, 600, dtype=np.uint64) for _ in range(2))
    low[300:], high[300:] = low[:300] ^ np.uint64(5), high[:300]
    out = []
    neardup.tree_pairs(low, high, np.arange(600), 30, out)
    got = {tuple(sorted(p)) for a, b in out for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(600) for j in np.flatnonzero(neardup.hamming(low, high, i, np.arange(600)) <= 30).tolist() if j > i}
    assert got == want


def brute_seen(history, new):
    out, known = {}, [(t, W.words(t)) for t in history if t]
    for i, t in new:
        w = W.words(t)
        if len(w) >= 20:
            if any(t.strip() == x.strip() for x, _ in known):
                out[i] = "exact"
            elif any(len(v) >= 20 and W.likeness(w, v) >= 0.5 for _, v in known):
                out[i] = "near"
        if t:
            known.append((t, w))
    return out


def test_seen_before_equals_brute_force(spark):
    all_ = texts(260, 2)
    old, new = all_[:120] + ODD, [*all_[120:], *ODD, all_[3] + "  \n", " " + all_[130]]
    h = spark.createDataFrame([(f"h{i}", t, 1) for i, t in enumerate(old)], "uid string, text string, cls int")
    n = spark.createDataFrame([(f"n{i}", i, t, 1, 1) for i, t in enumerate(new)], "uid string, ord bigint, text string, cls int, segment int")
    got = {r.ord: r.kind for r in incoming.seen_before(h.union(h.limit(10)), n).collect()}
    assert got == brute_seen(old, list(enumerate(new)))
    assert incoming.seen_before(h.limit(0), n.limit(0)).count() == 0
    assert {r.ord: r.kind for r in incoming.seen_before(h.limit(0), n).collect()} == brute_seen([], list(enumerate(new)))


def test_common_segments_are_salted_without_loss(spark):
    common = " ".join(VOCABULARY[:40])
    rows = [common + " " + " ".join(random.Random(i).choices(VOCABULARY, k=20)) for i in range(60)]
    n = spark.createDataFrame(list(enumerate(rows)), "ord bigint, text string")
    i = incoming.added(incoming.sketch(n, 20), incoming.spelt(n))
    probing = i.texts.select(F.col("first").alias("ord"), "length", "runs")
    one, many = ({tuple(r) for r in incoming.hits(probing, i.segments, 0.5, hot, 4).collect()} for hot in (2_000, 5))
    assert one == many and one


def test_a_text_that_repeats_itself_is_seen(spark):
    text = VOCABULARY[:20]
    h = spark.createDataFrame([("a", " ".join(text))], "uid string, text string")
    n = spark.createDataFrame([("b", 1, " ".join(text * 4))], "uid string, ord bigint, text string")
    assert W.likeness(text, text * 4) == 0.9
    assert [(r.ord, r.kind) for r in incoming.seen_before(h, n).collect()] == [(1, "near")]


def test_no_hit_at_the_threshold_is_lost(spark):
    """Pairs at a likeness of 0.5 to 0.55, which a filter by fingerprint loses now and then."""
    old, new = [], []
    for k in range(3_000):
        w = [f"{k}x{i}" for i in range(60)]
        v = w[:42] + [f"{k}z{i}" for i in range(18)]
        assert 0.5 <= W.likeness(w, v) <= 0.55
        old.append(" ".join(w))
        new.append(" ".join(v))
    h = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(old)], "uid string, text string")
    n = spark.createDataFrame([(f"n{i}", i, t) for i, t in enumerate(new)], "uid string, ord bigint, text string")
    assert incoming.seen_before(h, n).count() == 3_000


def test_a_cycle_of_any_length_is_the_same(spark):
    """A short and a long text of one cycle of words share all their runs; so do texts of one and two distinct runs."""
    cycle = VOCABULARY[:30]
    old = [" ".join(cycle), "a " * 25, "b c " * 20]
    h, n = spark.createDataFrame([(t,) for t in old], "text string"), spark.createDataFrame([(1, " ".join(cycle * 6)), (2, "a " * 400), (3, "b c " * 11 + "b"), (4, "c d " * 20)], "ord bigint, text string")
    assert {r.ord: r.kind for r in incoming.seen_before(h, n).collect()} == {1: "near", 2: "near", 3: "near"}


def test_swapped_halves_are_told_by_the_likeness(spark):
    w = [f"s{i}" for i in range(80)]
    h = spark.createDataFrame([(" ".join(w),)], "text string")
    n = spark.createDataFrame([(1, " ".join(w[40:] + w[:40])), (2, " ".join([*w[:20], "new", *w[20:]])), (3, " ".join(w[:10]) + " other" * 70)], "ord bigint, text string")
    out, _ = incoming.accept(incoming.seed(h), n)
    assert {r.ord: r.edits for r in out.collect()} == {1: None, 2: 5}


def test_batches_read_the_stored_index_alone(spark, tmp_path):
    """Folding the batches over a stored index gives what one pass gives, with the history's own table gone."""
    import shutil

    all_ = texts(240, 6)
    spark.createDataFrame([(t,) for t in [*all_[:90], *ODD]], "text string").write.parquet(f"{tmp_path}/history")
    history = spark.read.parquet(f"{tmp_path}/history")
    new = [(i, t) for i, t in enumerate([*all_[90:], None, "", all_[95]])]
    want = {r.ord: r.kind for r in incoming.seen_before(history, spark.createDataFrame(new, "ord bigint, text string")).collect()}
    incoming.seed(history).append_to(f"{tmp_path}/index")
    shutil.rmtree(f"{tmp_path}/history")
    got = {}
    for at in range(0, len(new), 60):
        verdicts, more = incoming.accept(incoming.stored(spark, f"{tmp_path}/index"), spark.createDataFrame(new[at : at + 60], "ord bigint, text string"))
        got |= {r.ord: r.kind for r in verdicts.collect()}
        more.append_to(f"{tmp_path}/index")
    assert got == want and len(want) > 30
    assert incoming.stored(spark, f"{tmp_path}/index").texts.groupBy("cls").count().where("count > 1").isEmpty()


def test_edits_between_sequences():
    import numpy as np

    r = random.Random(3)
    for _ in range(500):
        x, y = (np.array(r.sample(range(9), r.randint(1, 8)), dtype=np.uint32) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            now = [i]
            for j, b in enumerate(y, 1):
                now.append(row[j - 1] if a == b else min(row[j], now[-1]) + 1)
            row = now
        k = r.randint(0, 12)
        assert incoming.edits_between(x, y, k) == (row[-1] if row[-1] <= k else None)


@pytest.mark.parametrize("small_mb", [64, -1])
def test_leaks_equal_brute_force(spark, small_mb):
    r = random.Random(5)
    items = [" ".join(r.choices(VOCABULARY, k=r.randint(5, 40))) for _ in range(40)] + [None, "", "w1 w1 " * 30]
    docs = []
    for _ in range(120):
        w = r.choices(VOCABULARY, k=r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            src = (r.choice(items[:40])).split()
            a = r.randrange(len(src))
            k = r.randrange(len(w) + 1)
            w[k:k] = src[a : a + r.randint(6, 25)]
        docs.append(" ".join(w).upper() + "!")
    docs += [*ODD, "w1, w1. " * 40]
    D = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    T = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = {}
    for j, t in enumerate(items):
        grams = {tuple(W.words(t)[i : i + 12]) for i in range(len(W.words(t)) - 11)}
        for i, d in enumerate(docs):
            w = W.words(d)
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want[i, j] = 1
    got = {(x.doc_id, x.item_id): x.words for x in leakage.leaked(D.union(D.limit(5)), T, small_mb=small_mb).collect()}
    assert set(got) == set(want) and want and all(n >= 12 for n in got.values())
    assert leakage.leaked(D.limit(0), T, small_mb=small_mb).count() == 0 and leakage.leaked(D, T.limit(0), small_mb=small_mb).count() == 0


def test_bounded_edit_distance():
    r = random.Random(7)
    for _ in range(2_000):
        a, b = (r.choices("abc", k=r.randint(0, 8)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        k = r.randint(0, 8)
        assert W.bounded_edit_distance(a, b, k) == (row[-1] if row[-1] <= k else None)
