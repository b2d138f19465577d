"""Vector search, packing, scanned text, personal data: recall, invariants and awkward input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, packing, pii, queries, scanned


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, coll string, dim int, embedding array<float>, q boolean")


def test_similar_vectors_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(900, 16))
    x = np.concatenate([base, base[:300] + 0.05 * r.normal(size=(300, 16))])
    rows = [(f"v{i:04}", "c" if i % 3 else "d", 16, v.tolist(), False) for i, v in enumerate(x)]
    odd = [("n0", "c", 16, None, False), ("n1", "c", 16, [], False), ("n2", "c", 16, [0.0] * 16, False), ("n3", "c", 16, [float("nan")] * 16, False), ("n4", "c", 16, [1.0] * 8, False), (None, "c", 16, [1.0] * 16, False), ("n5", None, 16, [1.0] * 16, False), ("q1", "c", 16, x[4].tolist(), True), ("q2", "e", 16, x[4].tolist(), True)]
    v = ann.unit_vectors(vectors(spark, rows + rows[:20] + odd), "q").cache()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    group = np.arange(1200) % 3 > 0
    s[group[:, None] != group[None, :]] = -9
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"v{i:04}", f"v{j:04}"))) for i in range(1200) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.94}
    got = {tuple(p) for p in ann.similar_pairs(v).collect()}
    asked = {p for p in got if p[0][0] == "q"} | {p for p in got if p[1][0] == "q"}
    assert {p for p in got if p not in asked} <= want and len(got - asked) >= 0.97 * len(want) and ("q1", "v0004") in asked
    top = {}
    for t in ann.top_similar(v.where("NOT q"), 10, whole=1.0, cell_rows=20, visit_rows=30).collect():
        top.setdefault(t["query"], set()).add(t.id)
    hit = np.mean([len(top[f"v{i:04}"] & {f"v{j:04}" for j in np.argsort(-s[i])[:10]}) / 10 for i in range(0, 1200, 7)])
    assert hit >= 0.9


def test_copies_of_one_vector(spark):
    rows = [(f"v{i:03}", "c", 4, [1.0, 2.0, 3.0, 4.0], False) for i in range(40)] + [("w", "c", 4, [1.0, 2.0, 3.0, 4.1], False)]
    out = ann.top_similar(ann.unit_vectors(vectors(spark, rows)), 3).collect()
    by = {q: [r.id for r in sorted((r for r in out if r["query"] == q), key=lambda r: r["rank"])] for q in ("v000", "v005", "w")}
    assert by == {"v000": ["v001", "v002", "v003"], "v005": ["v000", "v001", "v002"], "w": ["v000", "v001", "v002"]}


def test_no_vectors(spark):
    assert ann.similar_pairs(ann.unit_vectors(vectors(spark, []), "q")).count() == 0


def test_cells_come_in_order_of_distance():
    r = np.random.default_rng(1)
    a, b = r.random(6), r.random(5)
    cells = ann.nearest_cells(a, b, 30)
    assert len(set(cells)) == 30 and [a[i] + b[j] for i, j in cells] == sorted(a[i] + b[j] for i in range(6) for j in range(5))


def test_packing(spark):
    r = np.random.default_rng(3)
    for capacity in (50, 128, 1000):
        sizes = np.minimum(r.integers(0, 120, 400), capacity)
        w = packing.pack(sizes, capacity)
        assert w.min() >= 0 and np.bincount(w, weights=sizes).max() <= capacity
    df = spark.createDataFrame([(i, t) for i, t in enumerate([5, 0, None, 2_000, 512, 513, 7, 7])], "id bigint, tokens bigint")
    profiles = spark.createDataFrame([("a", 512), ("b", 64), ("c", None), ("d", 0), ("a", 512)], "profile string, capacity_tokens int")
    out = packing.packed(df.union(df.where("id = 6")), profiles).toPandas()
    assert set(out.profile) == {"a", "b"}
    assert (out.groupby(["profile", "container"]).tokens.sum() <= out.profile.map({"a": 512, "b": 64}).groupby([out.profile, out.container]).first()).all()
    assert out[(out.profile == "a") & (out.id == 3)].tokens.tolist().count(512) == 3 and out[(out.profile == "a") & (out.id == 3)].tokens.sum() == 2_000
    assert len(out[(out.profile == "a") & (out.id == 6)]) == 2 and len(out[(out.profile == "a") & (out.id == 4)]) == 1
    assert packing.packed(df.limit(0), profiles).count() == 0 and packing.packed(df, profiles.limit(0)).count() == 0


def test_packing_fills_containers():
    sizes = np.random.default_rng(4).lognormal(5, 1, 3_000).astype(int) + 1
    _, _, z = packing.pieces(sizes, 1024)
    w = packing.pack(z, 1024)
    assert z.sum() / ((w.max() + 1) * 1024) > 0.995


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id bigint, text string")
    out = {r.id: r.tokens for r in packing.token_counts(df, *queries.vocabulary()).collect()}
    assert out[1] == 2 and out[2] == out[3] == 0 and out[4] > 1


LEX = ["the", "adapter", "releases", "fingerprint", "federated", "statement", "of", "each", "archive", "while", "client", "time-boxed"]


def block(text, page=1, kind="paragraph", path=("Quiet Ledger Report",)):
    return {"text": text, "kind": kind, "page": page, "section_path": list(path)}


def test_scanned_lines_are_repaired():
    blocks = []
    for p in range(1, 6):
        other = f"{LEX[p]} {LEX[p + 2]} {LEX[p + 5]}"
        blocks += [block("Quiet Ledger Report", p), block(f"The {other} releases the feder-\nated fingerprint. While each c1ient of the\ntime-\nboxed archive releases the adapter.", p), block(str(p + 11), p), None, block(None, p)]
    lines = scanned.lines_of(blocks)
    feats = scanned.features(lines)
    chain = scanned.Chain.fit([(feats, scanned.evident_labels(lines, feats))] * 20)
    found, paragraphs = scanned.repair(lines, chain.label(feats), scanned.Lexicon(LEX))
    assert {f[0] for f in found if f[2] == "furniture"} == {5 * i for i in range(5)} | {5 * i + 2 for i in range(5)}
    assert (1, 0, "broken_word", "federated") in found and (1, 1, "misread_word", "client") in found
    assert (1, 2, "broken_word", "time-boxed") in found and "time-boxed archive" in paragraphs[0]
    assert "federated fingerprint" in paragraphs[0] and "client" in paragraphs[0] and "12" not in " ".join(paragraphs)
    assert scanned.lines_of(None) == [] and scanned.repair([], [], scanned.Lexicon([])) == ([], [])


def test_misreadings_are_undone_as_they_are_made():
    made, undone = scanned.Lexicon(LEX), scanned.Lexicon(LEX, most=0)
    forms = [*made.read, *LEX, "nothing", "c1ient", "fcdcratcd", ""]
    assert len(forms) > 500 and [undone.right(f) for f in forms] == [made.right(f) for f in forms]


def test_headings_are_no_furniture():
    """A section's heading stays though its number runs along with the pages; the header above it goes."""
    blocks = [block(f"Quiet Ledger Report\n{p} The archive", p, "heading", ("Quiet Ledger Report", "The archive")) for p in range(1, 6)] + [block("Page 7 of 9", 6)]
    lines = scanned.lines_of(blocks)
    feats = scanned.features(lines)
    assert [scanned.LABELS[y] for y in scanned.evident_labels(lines, feats)] == ["header", "body"] * 5 + ["number"]
    assert not any(f.startswith(scanned.EVIDENCE) for x in scanned.without_evidence(feats) for f in x)


@pytest.mark.parametrize(("line", "shape"), [("Page 3 of 9", "total"), ("12 / 30", "total"), ("Page 3", "word"), ("xviii", "Roman"), ("- 12 -", "dashed"), ("12", "bare"), ("words", "")])
def test_shapes_of_page_numbers(line, shape):
    assert scanned.number_shape(line) == shape


def test_scanned_tables_with_gaps(spark, sf):
    irs, lex = spark.read.parquet(f"{sf}/document_irs.parquet"), spark.read.parquet(f"{sf}/lexicon.parquet")
    odd = irs.withColumn("text_blocks", F.when(F.col("ir_id") % 3 == 0, F.lit(None)).when(F.col("ir_id") % 3 == 1, F.transform("text_blocks", lambda b: F.struct(b["text"].alias("text"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<string>").alias("section_path")))).otherwise(F.col("text_blocks")))
    assert scanned.found_noise(odd.withColumn("kind", F.lit("x")), lex).count() > 0
    assert scanned.found_noise(irs.limit(0), lex).count() == 0 and scanned.paragraphs(irs, lex.limit(0)).count() > 0


@pytest.mark.parametrize(("line", "n"), [("12", 12), ("- 12 -", 12), ("Page 3 of 9", 3), ("xviii", 18), ("12 / 30", 12), ("— l4", 14), ("Count of pages", None), ("", None), ("ill will", None)])
def test_page_numbers(line, n):
    assert scanned.page_number(line) == n


@pytest.fixture(scope="module")
def pii_model(sf):
    import pyarrow.parquet as pq

    people = pq.read_table(f"{sf}/user_directory.parquet").to_pylist()
    known = pii.Known([p["given_name"] for p in people], [p["family_name"] for p in people], [w["word"].lower() for w in pq.read_table(f"{sf}/lexicon.parquet").to_pylist()])
    texts = [t["text"] for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    return known, pii.fit(texts, known)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Please contact Brivik Sarnmere at brivik.sarnmere@quenby.example or call +44 7700 900188.", {("name", "Brivik Sarnmere"), ("email", "brivik.sarnmere@quenby.example"), ("phone", "+44 7700 900188")}),
        ("mail halmond-yarrgard [at] quenby [dot] example now", {("email", "halmond-yarrgard [at] quenby [dot] example")}),
        ("Contact Maria Gonzalez or John Smith today.", {("name", "Maria Gonzalez"), ("name", "John Smith")}),
        ("National insurance AB123456C, or AB 12 34 56 C.", {("id_number", "AB123456C"), ("id_number", "AB 12 34 56 C")}),
        ("She lives at 12 Oak Street, Springfield, CA 94110 now, he at 7 High Road, Leeds LS1 4AP.", {("address", "12 Oak Street, Springfield, CA 94110"), ("address", "7 High Road, Leeds LS1 4AP")}),
        ("SSN on page two: 666-25-4552.", {("id_number", "666-25-4552")}),
        ("The applicant lives at Flat 23, 112 Orchard Close, Hollowmere HO18 4QT and left (212) 555-0166 as a number.", {("address", "Flat 23, 112 Orchard Close, Hollowmere HO18 4QT"), ("phone", "(212) 555-0166")}),
        ("Wohnhaft: Erlenstraße 124, 00124 Kaltmoor, Ausweis 06789712851.", {("address", "Erlenstraße 124, 00124 Kaltmoor"), ("id_number", "06789712851")}),
        ("Invoice 4471-489-37 covers shelf 26. Build 2024.17.3 failed on node 10.28.4.17. The @cached decorator wraps recall@48.", set()),
    ],
)
def test_personal_data(pii_model, text, found):
    assert {(s.kind, text[s.start : s.end]) for s in pii.entities(text, *pii_model)} == found


@pytest.mark.parametrize("before", ["Das war die letzte Version. ", "We asked Mr. ", "It went to Prof. ", "See node QX7 ", "See QX_B ", "Filed under A1-"])
def test_names_after_capitals(pii_model, before):
    text = f"{before}Brivik Sarnmere about it."
    assert ("name", "Brivik Sarnmere") in {(s.kind, text[s.start : s.end]) for s in pii.candidates(text, pii_model[0])}
    if before[-1] == " ":
        assert pii.redacted(text, pii.entities(text, *pii_model)) == f"{before}[NAME] about it."


def test_redaction_keeps_the_rest(pii_model):
    text = "Ask Dr Torsel Yarrwick about it: 07700 900 160!"
    assert pii.redacted(text, pii.entities(text, *pii_model)) == "Ask Dr [NAME] about it: [PHONE]!"


def test_personal_data_of_odd_texts(spark, sf):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "1 " * 50_000, "x"), (4, "A B " * 20_000, "x"), (5, "a@b.example", "x"), (5, "a@b.example", "x"), (None, "a@b.example", "x")], "doc_id bigint, text string, kind string")
    people, lex = spark.read.parquet(f"{sf}/user_directory.parquet"), spark.read.parquet(f"{sf}/lexicon.parquet")
    assert pii.found_pii(docs, people, lex).where("doc_id = 5").count() in (0, 2)
    assert pii.found_pii(docs.limit(0), people.limit(0), lex.limit(0)).count() == 0
    assert pii.redact(docs, people, lex).count() == 6


def test_segmentation_is_the_best_of_all():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(200):
        spans = [pii.Span(a, a + r.randint(1, 6), r.choice(pii.KINDS), str(i)) for i, a in enumerate(r.randrange(90) for _ in range(9))]
        w = pii.Weights({str(i): r.uniform(-1, 2) for i in range(9)} | {f"{a}>{b} {n}": r.uniform(-0.5, 0.5) for a in pii.KINDS for b in pii.KINDS for n in ("near", "close", "far")})
        feats = [[s.form] for s in spans]

        def value(path):
            total, before = 0.0, None
            for i in path:
                total += w.score(feats[i]) + w.score(pii.between("", before, spans[i]))
                before = spans[i]
            return total

        best = 0.0
        for n in range(1, 10):
            for c in itertools.combinations(range(9), n):
                p = sorted(c, key=lambda i: spans[i].start)
                if all(spans[a].end <= spans[b].start for a, b in zip(p, p[1:], strict=False)):
                    best = max(best, value(p))
        assert value(pii.best_segmentation("", spans, feats, w)) == pytest.approx(best)


def test_top_of_large_tables(spark, tmp_path):
    """20,000 rows without any clusters, in 144 cells."""
    r = np.random.default_rng(8)
    x = r.normal(size=(20_050, 16)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]

    def best(asking, own):
        s = asking @ unit[:20_000].T
        if own is not None:
            s[np.arange(len(own)), own] = -9
        return [set(np.argpartition(-row, 10)[:10].tolist()) for row in s]

    kinds = "coll string, n bigint, id string, embedding array<float>"
    rows = spark.createDataFrame([("c", i, f"v{i:05}", v.tolist()) for i, v in enumerate(x)], kinds).cache()
    old, new = rows.where("n < 20000"), rows.where("n >= 20000")
    old.select(F.col("n").alias("vec_id"), "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    old.select("id", F.to_json(F.struct(F.col("coll").alias("collection"))).alias("metadata"), "embedding").write.parquet(f"{tmp_path}/stored_documents.parquet")
    new.select(F.col("id").alias("request_id"), F.col("coll").alias("collection"), F.col("embedding").alias("query_vector")).write.parquet(f"{tmp_path}/search_requests.parquet")
    spark.sql("SELECT 'c' AS name, 16 AS embedding_dim").write.parquet(f"{tmp_path}/collection_specs.parquet")
    got = {}
    for t in queries.p1_embeddings_topk(spark, str(tmp_path)).collect() + queries.p1_requests_topk(spark, str(tmp_path)).collect():
        got.setdefault(t["query"], set()).add(t.id)
    asked = np.arange(0, 20_000, 100)
    recall = lambda pairs: np.mean([len(a & b) / 10 for a, b in pairs])
    assert recall(zip([got[i] for i in asked.tolist()], best(unit[asked], asked), strict=True)) >= 0.93
    assert recall(zip([{int(i[1:]) for i in got[f"v{i:05}"]} for i in range(20_000, 20_050)], best(unit[20_000:], None), strict=True)) >= 0.9


def test_blocks_meet_once(spark):
    x = np.random.default_rng(9).normal(size=(300, 8))
    v = ann.unit_vectors(vectors(spark, [(f"v{i:03}", "c", 8, e.tolist(), False) for i, e in enumerate(x)]), "q")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    got = {}
    for t in ann.top_similar(v, 5, whole=0.0, cell_rows=64, visit_rows=50).collect():
        got.setdefault(t["query"], []).append((t["rank"], t.id))
    assert {q: [i for _, i in sorted(n)] for q, n in got.items()} == {f"v{i:03}": [f"v{j:03}" for j in np.argsort(-s[i])[:5]] for i in range(300)}


def test_recall_over_many_cells(spark, monkeypatch):
    """13,000 clustered vectors in 100 cells, of which less than a quarter is read; centroids sent in shares."""
    from quillon import shared

    monkeypatch.setattr(ann, "BOOK_BYTES", 4_000)
    monkeypatch.setattr(shared, "TASK_BYTES", 4 << 20)
    r = np.random.default_rng(10)
    x = r.normal(size=(400, 32))[r.integers(0, 400, 13_000)] + 0.45 * r.normal(size=(13_000, 32))
    v = ann.unit_vectors(vectors(spark, [(f"v{i:05}", "c" if i < 12_900 else "d", 32, e.tolist(), False) for i, e in enumerate(x)]), "q").cache()
    book = {b.coll: b for b in ann.codebooks(v.withColumn("cls", F.col("vec")), 10, None, 0.95, 0.5, 8192).collect()}
    assert book["c"].k == 10 and 0 < book["c"].probes < 25
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for t in ann.top_similar(v, 10).collect():
        got.setdefault(t["query"], set()).add(t.id)
    hit = []
    for i in range(0, 12_900, 29):
        s = unit[:12_900] @ unit[i]
        s[i] = -9
        hit.append(len(got[f"v{i:05}"] & {f"v{j:05}" for j in np.argpartition(-s, 10)[:10]}) / 10)
    assert np.mean(hit) >= 0.93
