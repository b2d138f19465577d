import hashlib
import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import identity as I
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import catalog, filters


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given_uri", "normal"),
    [(" HTTP://Example.COM/Folder/File.PDF/ ", "http://example.com/Folder/File.PDF"), (" HTTP://A/B/ ", "http://a/B"), ("HTTP://X/", "http://x"), ("plain/path//", "plain/path"), ("http://h/p?q=1#frag", "http://h/p?q=1"), ("", "")],
)
def test_normalise_uri(spark, given_uri, normal):
    assert one(spark, I.normalise_uri(F.lit(given_uri))) == normal


def test_doc_id_ignores_spelling(spark):
    h = F.lit("a" * 64)
    assert one(spark, I.doc_id(F.lit("HTTP://X/"), h)) == one(spark, I.doc_id(F.lit("http://x"), F.upper(h)))


def test_uuid5(spark):
    assert one(spark, I.uuid5(str(uuid.NAMESPACE_URL), F.lit("items:é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "items:é"))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"]), max_size=30), min_size=20, max_size=40))
def test_strip_and_hash_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip(F.col("t")).alias("s"), I.content_hash(F.col("t")).alias("h"))
    for r in df.collect():
        want = texts[r.i].strip()
        assert r.s == want and r.h == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "chunker", "parts"),
    [
        ("abcd", lambda c: T.chunk_fixed(c, 2), ["ab", "cd"]), ("", lambda c: T.chunk_fixed(c, 2), [""]), ("a\n\nb", lambda c: T.chunk_recursive(c, 500), ["a", "b"]), ("abc", lambda c: T.chunk_recursive(c, 2), ["ab", "c"]),
        ("a. b.", T.chunk_semantic, ["a", "b"]), ("a. b. cdefg", lambda c: T.chunk_semantic(c, 5), ["a. b. cdefg"]), ("", lambda c: T.chunk_semantic(c, 5), [""]), ("a\r\n\r\n b \n\n", T.paragraph_blocks, ["a", "b"]),
    ],
)
def test_chunkers(spark, text, chunker, parts):
    assert one(spark, chunker(F.lit(text))) == parts


def test_tables(spark):
    row = spark.sql("SELECT named_struct('headers', array('a', 'b'), 'rows', array(array('1'), array('2', '3', '4')), 'page', cast(null AS int), 'locator', 'x') AS t, named_struct('headers', cast(array() AS array<string>), 'rows', array(array('1', '<')), 'page', 1, 'locator', '') AS u")
    r = row.select(T.table_markdown(F.col("t")).alias("m"), T.table_text(F.col("t")).alias("x"), T.table_html(F.col("u")).alias("h"), T.table_json(F.col("t")).alias("j"), T.table_markdown(F.col("u")).alias("n")).first()
    assert r.m == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert r.x == "a\tb\n1\n2\t3\t4"
    assert "<td><</td>" in r.h and "<thead>" not in r.h
    assert json.loads(r.j) == {"records": [{"a": "1"}, {"a": "2", "b": "3", "col_2": "4"}], "page": None, "locator": "x"}
    assert r.n.startswith("| col_0 | col_1 |")


@pytest.mark.parametrize(("mode", "chars", "scanned", "enabled"), [("auto", 50, 0.0, False), ("auto", 50, 0.5, True), ("auto", 500, 0.9, False), ("force", 9999, 0.0, True), ("disabled", 1, 1.0, False), ("other", 1, 1.0, True)])
def test_ocr_decision(spark, mode, chars, scanned, enabled):
    assert one(spark, T.ocr_decision(mode, F.lit(chars), F.lit(scanned)))["enabled"] is enabled


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(0.5))
    assert one(spark, V.dot(a, b)) == 3.0
    assert one(spark, V.cosine(a, F.array(F.lit(0.0)))) is None
    with pytest.raises(ValueError):
        V.pseudo_embedding(F.lit("x"), 0)


def test_pseudo_embedding_follows_its_definition(spark):
    digest = b"".join(hashlib.sha256("é".encode() + i.to_bytes(4, "big")).digest() for i in range(2))
    want = [int.from_bytes(digest[i : i + 4], "big") / 2**31 - 1 for i in range(0, 40, 4)]
    assert one(spark, V.pseudo_embedding(F.lit("é"), 10)) == pytest.approx(want)


def test_filters(spark):
    assert filters.coerce({"tenant_id": "t", "x": 1, "is_latest": False, "namespace": "", "access_tags": [" a ", ""]}) == {"tenant_id": "t", "is_latest": False, "access_tags": ("a",)}
    assert "access_tags" not in filters.pushed({"access_tags": ["finance"], "tenant_id": "t"})
    df = spark.createDataFrame([("t", ["finance", "legal"]), (None, None), ("t", [])], "tenant_id string, access_tags array<string>")
    assert df.where(filters.predicate({"tenant_id": "t", "access_tags": ["finance"]})).count() == 1
    assert df.where(filters.predicate({"access_tags": ["finance", "ops"]})).count() == 0
    assert df.where(filters.predicate({})).count() == 3


def test_options_and_names(spark):
    assert catalog.options("pgvector", {"probes": 0})["probes"] == 1
    assert catalog.options("nowhere", {"a": 1}) == {"a": 1}
    assert one(spark, I.class_name(F.lit("my_docs-a_weAv"))) == "MyDocsAWeAv"
    assert one(spark, I.class_name(F.lit("__"))) == "Collection"
    with pytest.raises(catalog.ConfigError):
        catalog.check_spec(" ", 4)
