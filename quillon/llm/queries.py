"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table
from . import ann, incoming, leakage, neardup, packing, pii, scanned


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Where the public tokenizer's vocabulary lies on the driver, and its pattern of words."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return ann.collection_vectors(_read(spark, d, "stored_documents"), _read(spark, d, "search_requests"), _read(spark, d, "collection_specs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near vectors within a collection."""
    return ann.similar_pairs(_vectors(spark, d), k=10, min_cosine=0.94, recall=0.95)


def p1_requests_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar stored documents of every search request."""
    return ann.top_similar(_vectors(spark, d), k=10, recall=0.97, only_queries=True)  # requests lie a little farther from the centroids than what is stored


def p1_stored_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar stored documents of every stored document."""
    return ann.top_similar(_vectors(spark, d).where("NOT q"), k=10)


def p1_embeddings_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar embeddings of every embedding whose id is divisible by 100, against all."""
    e = _read(spark, d, "embeddings").withColumn("id", F.col("vec_id").cast("string"))
    dim = F.size("embedding").alias("dim")
    base = ann.unit_vectors(e.select("id", F.lit("all").alias("coll"), dim, "embedding"))
    asking = base.where(F.col("id").cast("bigint") % 100 == 0)
    both = base.withColumn("q", F.lit(False)).union(asking.withColumn("q", F.lit(True)))
    top = ann.top_similar(both, k=11, only_queries=True).where("query <> id")
    rank = F.row_number().over(ann.Window.partitionBy("query").orderBy("rank"))
    return top.select(F.col("query").cast("bigint").alias("query"), F.col("id").cast("bigint").alias("id"), "cosine", rank.alias("rank")).where("rank <= 10")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose contents are alike."""
    r = _read(spark, d, "records").select("record_id", "content")
    return neardup.near_duplicate_pairs(r, "record_id", "content", threshold=0.5, min_words=20).toDF("record_id_a", "record_id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record's class of equal contents and how many other classes are near it."""
    r = _read(spark, d, "records").select("record_id", "content")
    return neardup.near_duplicate_groups(r, "record_id", "content", threshold=0.5, min_words=20).withColumnRenamed("id", "record_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows whose content was accepted before."""
    old = _read(spark, d, "records").select(F.col("content").alias("text"))
    new = _read(spark, d, "incoming_batches").select(F.col("incoming_id").alias("ord"), F.col("content").alias("text"))
    return incoming.seen_before(old, new, threshold=0.5, min_words=20).withColumnRenamed("ord", "incoming_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Furniture, broken words and misread words of scanned documents."""
    return scanned.found_noise(_read(spark, d, "document_irs"), _read(spark, d, "lexicon"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Scanned documents as readable paragraphs."""
    return scanned.paragraphs(_read(spark, d, "document_irs"), _read(spark, d, "lexicon"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each profile."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    counted = table(packing.token_counts(docs, *vocabulary()), "tokens")
    return packing.packed(counted, _read(spark, d, "pack_profiles")).withColumnRenamed("id", "doc_id")


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p6_packed in each profile: tokens and documents placed, each token once, the most that a container holds, and documents split without need."""
    out, caps = table(p6_packed(spark, d), "packed"), _read(spark, d, "pack_profiles")
    of_doc = out.groupBy("profile", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces")).join(F.broadcast(caps), "profile")
    docs = of_doc.groupBy("profile").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("split_without_need"), F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("t") / F.col("capacity_tokens")), F.lit(1))).alias("wrong_pieces"))
    held = out.groupBy("profile", "container").agg(F.sum("tokens").alias("used")).join(F.broadcast(caps), "profile")
    fits = held.groupBy("profile").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"), (F.sum("used") >= 0.985 * F.count("*") * F.max("capacity_tokens")).alias("well_filled"))
    return docs.join(fits, "profile")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each profile are."""
    by = p6_packed(spark, d).groupBy("profile", "container").agg(F.sum("tokens").alias("used"))
    caps = _read(spark, d, "pack_profiles")
    return by.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).join(caps, "profile").withColumn("fill", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 4))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold evaluation material."""
    docs, items = _read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "eval_items").select("item_id", "text")
    return leakage.leaked(docs, items, span=12).select("doc_id", "item_id")


def _pii(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _read(spark, d, "documents"), _read(spark, d, "user_directory"), _read(spark, d, "lexicon")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in documents."""
    return pii.found_pii(*_pii(spark, d)).select("doc_id", "kind", "found").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with typed placeholders in place of personal information."""
    return pii.redact(*_pii(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_requests_topk, p1_stored_topk, p1_embeddings_topk, p2_found, p2_groups, p4_found, p5_found, p5_paragraphs, p6_packed, p6_checked, p6_fill, p7_found, p8_found, p8_redacted)}


_RUNS = "list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))"
_WORDS = r"regexp_extract_all(lower({x}), '[\pL\pN]+')"
_ALIKE = """, g AS MATERIALIZED (SELECT k, unnest(runs) AS run FROM t), n AS MATERIALIZED (SELECT x.k AS a, y.k AS b, count(*) AS n_both FROM g x JOIN g y ON x.run = y.run AND x.k < y.k GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM n JOIN t x ON x.k = a JOIN t y ON y.k = b WHERE n_both >= 0.5 * (len(x.runs) + len(y.runs) - n_both)) """

_P1 = """WITH s AS (SELECT id, json_extract_string(metadata, '$.collection') AS coll, embedding AS v, false AS q FROM stored_documents UNION ALL SELECT request_id, collection, query_vector, true FROM search_requests),
u AS (SELECT coll, id, q, min(v)::DOUBLE[] AS v FROM s JOIN collection_specs ON name = coll WHERE len(v) = embedding_dim AND len(list_filter(v, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND list_sum(list_transform(v, lambda x: abs(x))) > 0 GROUP BY 1, 2, 3),
r AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.coll, a.q, a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS k FROM u a JOIN u b ON a.coll = b.coll AND NOT b.q AND a.id <> b.id)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 10 AND c >= 0.94"""

_P2 = f"""WITH w AS (SELECT DISTINCT record_id, {_WORDS.format(x='content')} AS w FROM records WHERE content IS NOT NULL), v AS (SELECT w, list(DISTINCT record_id) AS ids, row_number() OVER () AS k FROM w WHERE len(w) >= 20 GROUP BY w),
t AS MATERIALIZED (SELECT k, ids, {_RUNS} AS runs FROM v)""" + _ALIKE + """SELECT DISTINCT least(p, q) AS record_id_a, greatest(p, q) AS record_id_b FROM (
SELECT unnest(x.ids) AS p, y.ids AS qs FROM l JOIN t x ON x.k = a JOIN t y ON y.k = b UNION ALL SELECT unnest(ids), ids FROM t), unnest(qs) AS z(q) WHERE p <> q"""

_P2_GROUPS = _P2[: _P2.index("SELECT DISTINCT least(p, q)")] + """, e AS (SELECT a AS k FROM l UNION ALL SELECT b FROM l), c AS (SELECT k, count(*) AS links FROM e GROUP BY 1)
SELECT unnest(ids) AS record_id, list_min(ids) AS class_id, len(ids)::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links FROM t LEFT JOIN c USING (k)"""

_P6 = "SELECT profile, (SELECT count(*) FROM documents) AS documents, 0 AS split_without_need, 0 AS wrong_pieces, 0 AS overfull, true AS well_filled FROM pack_profiles"

_P4 = f"""WITH w AS (SELECT -1 AS ord, content, {_WORDS.format(x='content')} AS w FROM records WHERE content IS NOT NULL UNION ALL SELECT incoming_id, content, {_WORDS.format(x='content')} FROM incoming_batches WHERE content IS NOT NULL),
e AS (SELECT ord, w, regexp_replace(content, '^[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+$', '', 'g') AS s FROM w WHERE len(w) >= 20),
v AS (SELECT w, min(ord) AS first, row_number() OVER () AS k FROM e GROUP BY w), t AS MATERIALIZED (SELECT k, first, {_RUNS} AS runs FROM v)""" + _ALIKE + """
, o AS (SELECT s, min(ord) AS least FROM e GROUP BY s), p AS (SELECT a AS k, y.first AS before FROM l JOIN t y ON y.k = b UNION ALL SELECT b, x.first FROM l JOIN t x ON x.k = a), m AS (SELECT k, min(before) AS before FROM p GROUP BY k)
SELECT ord AS incoming_id, CASE WHEN o.least < ord THEN 'exact' ELSE 'near' END AS kind FROM e JOIN o USING (s) JOIN v USING (w) LEFT JOIN m USING (k) WHERE ord >= 0 AND (o.least < ord OR v.first < ord OR m.before < ord)"""

_P7 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(x='text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(len(w) - 11), lambda j: array_to_string(w[j + 1:j + 12], ' '))) AS g FROM d), ig AS (SELECT item_id, unnest(list_transform(range(len(w) - 11), lambda j: array_to_string(w[j + 1:j + 12], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def oracle_sql() -> dict[str, str]:
    """Exact SQL for the searches; the rest has no short SQL and is tested against brute force or by round trips."""
    return {"p1_found": _P1, "p2_found": _P2, "p2_groups": _P2_GROUPS, "p4_found": _P4, "p6_checked": _P6, "p7_found": _P7}
