"""What is counted or fitted comes from whole tables."""

from itertools import product

from pyspark.sql import functions as F

from quillon.llm import pii, scanned


def scanned_rows(spark, texts):
    blocks = "array<struct<text:string,kind:string,page:int,section_path:array<string>>>"
    return spark.createDataFrame([(i, [(t, "paragraph", 1, None)], ("engine", 0.9)) for i, t in enumerate(texts)], f"ir_id bigint, text_blocks {blocks}, provenance struct<ocr_engine:string,ocr_confidence:double>")


def test_capitals_of_every_scanned_document_count(spark):
    """Each of 1,000 documents has a name of its own, once read with a digit for its capital."""
    words = ["s" + "".join(x) for x in product("kpxj", repeat=5)][:1_000]
    irs = scanned_rows(spark, [f"We saw that {w.title()} and all of {w.title()} with 5{w[1:]} went." for w in words])
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    assert {(r.ir_id, r.fixed) for r in scanned.found_noise(irs, lexicon).where("kind = 'misread_word'").collect()} == {(i, w.title()) for i, w in enumerate(words)}


def test_every_line_is_counted_and_size_changes_no_model(spark):
    texts = ["First line\nsecond line.", "7", None, ""] * 300
    looked = scanned._looked(scanned_rows(spark, texts))
    assert looked.selectExpr("sum(size(looks))").first()[0] == 300 * 4
    chains = []
    for n in (1, 50):
        lines = scanned.lines_of([{"text": "Head\nfirst line\nsecond line.", "kind": "paragraph", "page": 1}, {"text": "4", "kind": "paragraph", "page": 1}])
        feats = scanned.features(lines)
        chains.append(scanned.Chain.fit([(feats, scanned.evident_labels(lines, feats))] * n))
    assert chains[0].w.keys() == chains[1].w.keys() and all(abs(chains[0].w[k] - chains[1].w[k]).max() < 0.05 for k in chains[0].w)


def test_words_of_every_document_are_learnt(spark):
    """Each of 3,500 documents has a word of its own, one of them is long."""
    words = ["q" + "".join(x) for x in product("abcdefghij", repeat=4)][:3_500]
    texts = [*(f"the {w} and its {w}" for w in words), "and the longwordofours " * 1_100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    people = spark.createDataFrame([("Torette", "Sarnova")], "given_name string, family_name string")
    known = pii.fit_model(docs, people, spark.createDataFrame([("word",)], "word string")).known
    assert [w for w in [*words, "longwordofours", "word"] if w not in known.vocabulary] == []


def test_every_person_is_known(spark):
    """110,000 persons: of their names, all of which the lexicon has, none is left in the vocabulary."""
    name = F.concat(F.lit("g"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    people = spark.range(110_000).select(F.initcap(name).alias("given_name"), F.lit("Sarnova").alias("family_name"))
    docs = spark.createDataFrame([(1, "a plain text")], "doc_id bigint, text string")
    known = pii.fit_model(docs, people, people.select(F.lower("given_name").alias("word")).union(spark.createDataFrame([("word",)], "word string"))).known
    left = [w for w in (r[0] for r in people.select(F.lower("given_name")).collect()) if w in known.vocabulary]
    assert left == [] and "word" in known.vocabulary


def test_all_shares_are_fitted_on(spark, sf, monkeypatch):
    """The mean over shares finds what one perceptron finds, however the table is cut."""
    docs, people, lexicon = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "user_directory", "lexicon"))
    find = lambda m: {tuple(r) for r in pii.found_pii(docs, people, lexicon, model=m).collect()}
    whole = pii.fit_model(docs, people, lexicon)
    monkeypatch.setattr(pii, "SHARD_DOCS", 12)
    models = [pii.fit_model(docs.repartition(n), people, lexicon) for n in (3, 7)]
    assert models[0].weights == models[1].weights != whole.weights
    one, many = find(whole), find(models[0])
    assert one and len(one & many) >= 0.95 * len(one | many)


def test_a_cue_for_other_numbers_holds_in_its_sentence():
    known = pii.Known((), (), ())
    for text, told in (("It closes the invoice.\n\nRegards,\nP. Korvier\n07700 900918", ""), ("Paid with invoice 07700 900918", "other"), ("It closes. Phone: 07700 900918", "phone")):
        e = pii.example(text, known)
        assert {t for s, t in zip(e.spans, e.told, strict=True) if s.kind == "phone"} == {told}
