"""The queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions import vectors as V
from ..operators import catalog as C
from ..operators import filters, history, lifecycle, search
from ..sources import parsers, payloads

NOW = "2025-06-01T00:00:00Z"
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _first(df: DataFrame) -> list[float]:
    """The vector of vec_id 0: one row."""
    return df.where("vec_id = 0").select("embedding").first()[0]


# vector search

_Q = "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, {score} AS score FROM embeddings, q) "
_DOT = "list_inner_product(embedding::DOUBLE[], q.v)"


def _embeddings_topk(spark: SparkSession, d: str, k: int, metric: str, where=None) -> DataFrame:
    e = read(spark, d, "embeddings")
    return search.topk(e, _first(e), k, metric, id_col="vec_id", where=where).select("vec_id", F.round("score", 6).alias("score"))


@query(_Q.format(score=_DOT) + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_dot(spark, d):
    return _embeddings_topk(spark, d, 10, "dot")


@query(_Q.format(score="list_cosine_similarity(embedding::DOUBLE[], q.v)") + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark, d):
    return _embeddings_topk(spark, d, 10, "cosine")


@query(_Q.format(score="-list_distance(embedding::DOUBLE[], q.v)") + "SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_l2(spark, d):
    return _embeddings_topk(spark, d, 10, "l2")


@query(_Q.format(score=_DOT) + "SELECT vec_id, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return _embeddings_topk(spark, d, 10, "dot", filters.any_key({"label": 3}))


@query(_Q.format(score=_DOT) + ", t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, round(score, 6) AS score FROM t WHERE t.score >= 0.2")
def score_threshold(spark, d):
    e = read(spark, d, "embeddings")
    return search.at_least(search.topk(e, _first(e), 50, id_col="vec_id"), 0.2).select("vec_id", F.round("score", 6).alias("score"))


@query(_Q.format(score=_DOT) + ", t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, round(score, 6) AS score FROM t WHERE label = 3")
def post_filter_underfill(spark, d):
    e = read(spark, d, "embeddings")
    return search.topk(e, _first(e), 50, id_col="vec_id").where(filters.any_key({"label": 3})).select("vec_id", F.round("score", 6).alias("score"))


_BATCH = """SELECT * FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_{f}(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_{f}(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""


def _batch(spark, d, metric: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.batch_topk(e, asked, 10, metric, id_col="vec_id").withColumn("score", F.round("score", 6))


@query(_BATCH.format(f="inner_product"))
def vector_topk_batch(spark, d):
    return _batch(spark, d, "dot")


@query(_BATCH.format(f="cosine_similarity"))
def vector_topk_batch_cosine(spark, d):
    return _batch(spark, d, "cosine")


@query(_Q.format(score=_DOT) + "SELECT vec_id, greatest(10 - row_number() OVER (ORDER BY score DESC, vec_id) + 1, 1)::INT AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10)")
def rank_score(spark, d):
    e = read(spark, d, "embeddings")
    return search.rank_scores(search.topk(e, _first(e), 10, id_col="vec_id"), 10, [F.desc("score"), "vec_id"]).select("vec_id", F.col("score").cast("int").alias("score"))


@query(_Q.format(score=_DOT) + ", t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, label, round(score, 6) AS score FROM t ORDER BY label DESC, t.score DESC, vec_id LIMIT 5")
def rerank_limit(spark, d):
    e = read(spark, d, "embeddings")
    hits = search.topk(e, _first(e), 50, id_col="vec_id").withColumn("position", -F.col("score"))
    return search.rerank(hits, F.col("label"), F.struct("position", "vec_id"), 5).select("vec_id", "label", F.round("score", 6).alias("score"))


_WORDS = "[((('0x' || substr(sha256(encode(text) || unhex(printf('%08X', c))), i * 8 + 1, 8))::UBIGINT)::DOUBLE / 2147483648.0 - 1.0) FOR c IN range(2) FOR i IN range(8)]"
_PSEUDO = "SELECT doc_id, c * 8 + i AS position, round((('0x' || substr(sha256(encode(text) || unhex(printf('%08X', c))), i * 8 + 1, 8))::BIGINT)::DOUBLE / 2147483648.0 - 1.0, 6) AS value FROM documents, (SELECT unnest(range(2))::INT AS c), (SELECT unnest(range(8))::INT AS i) WHERE text IS NOT NULL AND c * 8 + i < 12"


@query(_PSEUDO)
def pseudo_embedding(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(V.pseudo_embedding(F.col("text"), 12)).alias("position", "value")).withColumn("value", F.round("value", 6))


_LIVE = """WITH r AS (SELECT record_id, bool_or(lifecycle_state = 'active') AS live FROM records GROUP BY 1),
q AS (SELECT embedding::DOUBLE[] AS v FROM stored_documents WHERE len(embedding) = 64 AND json_extract_string(metadata, '$.collection') = 'kb_articles' ORDER BY id LIMIT 1),
s AS (SELECT DISTINCT id, embedding FROM stored_documents WHERE len(embedding) = 64 AND json_extract_string(metadata, '$.collection') = 'kb_articles' AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true)),
h AS (SELECT id, list_inner_product(embedding::DOUBLE[], q.v) AS score FROM s, q) """


def _kb(spark, d) -> tuple[DataFrame, DataFrame, list[float]]:
    s = read(spark, d, "stored_documents").where((F.size("embedding") == 64) & (F.get_json_object("metadata", "$.collection") == "kb_articles"))
    query = s.orderBy("id").select("embedding").first()[0]
    s = s.where(~F.exists("embedding", F.isnan)).select("id", "embedding").distinct()
    r = read(spark, d, "records").groupBy("record_id").agg(F.max(F.col("lifecycle_state") == "active").alias("live")).select("record_id", F.when(F.col("live"), "active").otherwise("deleted").alias("lifecycle_state"))
    return s, r, query


@query(_LIVE + "SELECT id, round(score, 6) AS score FROM h JOIN r ON id = record_id WHERE live ORDER BY h.score DESC, id LIMIT 10")
def search_exact(spark, d):
    s, r, q = _kb(spark, d)
    return search.search(s, r, q, 10).select("id", F.round("score", 6).alias("score"))


@query(_LIVE + ", t AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 50) SELECT id, round(score, 6) AS score FROM t LEFT JOIN r ON id = record_id WHERE t.score >= 0.1 AND (record_id IS NULL OR live)")
def search_compat(spark, d):
    s, r, q = _kb(spark, d)
    s = s.withColumn("lifecycle_state", F.lit("active"))  # as written first; the store never learns of later states
    return search.search(s, r, q, 50, threshold=0.1, mode="compat").select("id", F.round("score", 6).alias("score"))


_BM25 = r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, len(t) AS n, len(list_filter(t, lambda x: x = 'archive')) AS a, len(list_filter(t, lambda x: x = 'checkpoint')) AS b FROM t),
st AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS lexical
FROM c, st WHERE a > 0 OR b > 0"""


@query(_BM25)
def lexical_scores(spark, d):
    return search.bm25(read(spark, d, "documents").where("text IS NOT NULL"), "archive checkpoint", "doc_id", "text").withColumn("lexical", F.round("lexical", 6))


# filters, listing, counting

_META = "SELECT DISTINCT record_id, metadata.tenant_id AS tenant_id, lifecycle_state, metadata.chunk_index AS chunk_index FROM records"


def _records(spark, d) -> DataFrame:
    r = read(spark, d, "records")
    return r.select("record_id", "content", "lifecycle_state", *[F.col(f"metadata.{c}").alias(c) for c in ("tenant_id", "namespace", "doc_id", "source_uri", "is_latest", "access_tags", "chunk_index", "supersedes", "created_at", "ttl_days", "source_hash", "content_hash", "ocr_provider", "ocr_engine", "page", "page_number", "section", "section_path", "parser_provider")])


@query("SELECT record_id, metadata.tenant_id AS tenant_id FROM records WHERE metadata.tenant_id = 'tnt-wexcombe' AND lifecycle_state = 'active' AND metadata.is_latest = true")
def filtered_records(spark, d):
    return _records(spark, d).where(filters.predicate({"tenant_id": "tnt-wexcombe", "lifecycle_state": "active", "is_latest": True, "unknown": 1})).select("record_id", "tenant_id")


_TAGS = f"list_filter(list_transform(coalesce(metadata.access_tags, []), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"SELECT t.tag, count(*) AS n FROM (SELECT unnest([x for x in {_TAGS}]) AS tag FROM records) t GROUP BY 1")
def tag_counts(spark, d):
    tags = F.filter(F.transform("access_tags", T.strip), lambda x: x != "")
    return _records(spark, d).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"WITH top AS (SELECT min(tag) AS tag FROM (SELECT unnest({_TAGS}) AS tag FROM records)) SELECT record_id FROM records, top WHERE list_contains({_TAGS}, top.tag)")
def tag_containment(spark, d):
    r = _records(spark, d)
    tag = r.select(F.explode(F.filter(F.transform("access_tags", T.strip), lambda x: x != "")).alias("t")).agg(F.min("t")).first()[0]
    return r.where(filters.has_tags(F.col("access_tags"), (tag,))).select("record_id")


@query("SELECT doc_id, tenant_id FROM documents WHERE tenant_id = 'tnt-quenby'")
def tenant_isolation(spark, d):
    return filters.tenant_only(read(spark, d, "documents"), "tnt-quenby").select("doc_id", "tenant_id")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 25 OFFSET 50")
def list_page(spark, d):
    return search.page(read(spark, d, "embeddings"), ["vec_id"], 50, 25).select("vec_id", "label")


@query("SELECT count(*) AS n FROM records WHERE lifecycle_state IS DISTINCT FROM 'deleted'")
def count_live(spark, d):
    return lifecycle.count(_records(spark, d))


@query("SELECT least(count(*), 100) AS n FROM records WHERE metadata.tenant_id = 'tnt-quenby'")
def count_filtered_cap(spark, d):
    return lifecycle.count(_records(spark, d), {"tenant_id": "tnt-quenby"}, compat=True)


@query("SELECT count(*) AS n FROM records WHERE metadata.tenant_id = 'tnt-quenby'")
def count_filtered(spark, d):
    return lifecycle.count(_records(spark, d), {"tenant_id": "tnt-quenby"})


@query("SELECT tenant_id, role, role = 'admin' AS may_admin, role IN ('admin', 'editor') AS may_write, role IN ('admin', 'editor', 'guest') AS may_read FROM (SELECT DISTINCT tenant_id FROM user_directory), (SELECT unnest(['admin', 'editor', 'guest', 'nobody']) AS role)")
def access_rights(spark, d):
    policy = F.struct(F.array(F.lit("guest")).alias("readers"), F.array(F.lit("editor")).alias("writers"), F.array(F.lit("admin")).alias("admins"))
    roles = read(spark, d, "user_directory").select("tenant_id").distinct().select("tenant_id", F.explode(F.array(*map(F.lit, ("admin", "editor", "guest", "nobody")))).alias("role"))
    return roles.select("tenant_id", "role", *[filters.may(F.col("role"), a, policy).alias(f"may_{a}") for a in ("admin", "write", "read")])


# identities

_URI_RX = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def _uri_sql(u: str) -> str:
    s = strip_sql(u)
    g = [f"regexp_extract({s}, '{_URI_RX}', {i})" for i in range(1, 5)]
    return f"CASE WHEN regexp_matches({s}, '{_URI_RX}') THEN lower({g[0]}) || '://' || lower({g[1]}) || rtrim({g[2]}, '/') || {g[3]} ELSE rtrim({s}, '/') END"


@query(f"SELECT doc_id, sha256({strip_sql('text')}) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256(text) AS source_hash FROM documents WHERE text IS NOT NULL")
def source_hash(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", I.source_hash(F.col("text")).alias("source_hash"))


@query(f"SELECT DISTINCT metadata.source_uri AS source_uri, {_uri_sql('metadata.source_uri')} AS normal FROM records")
def normalise_uri(spark, d):
    return _records(spark, d).select("source_uri", I.normalise_uri(F.col("source_uri")).alias("normal")).distinct()


_DOC_ID = f"sha256({_uri_sql('source_uri')} || '|' || lower(sha256({strip_sql('content')})))"


@query(f"SELECT incoming_id, {_DOC_ID} AS doc_id, sha256({_DOC_ID} || '|' || chunk_index) AS record_id FROM incoming_batches WHERE content IS NOT NULL")
def chunk_identity(spark, d):
    rows = read(spark, d, "incoming_batches").where("content IS NOT NULL")
    doc = I.doc_id(F.col("source_uri"), I.content_hash(F.col("content")))
    return rows.select("incoming_id", doc.alias("doc_id"), "chunk_index").select("incoming_id", "doc_id", I.record_id(F.col("doc_id"), F.col("chunk_index")).alias("record_id"))


_SOURCE_TYPE = "CASE WHEN lower(source_uri) LIKE 'http://%' OR lower(source_uri) LIKE 'https://%' THEN 'web' WHEN lower(source_uri) LIKE 'file://%' THEN 'file' WHEN lower(source_uri) LIKE 'api://%' THEN 'api' ELSE 'other' END"
_FILE = r"regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_uri, '^[A-Za-z][A-Za-z0-9+.\-]*:', ''), '^//[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)"


@query(f"SELECT ir_id, {_SOURCE_TYPE} AS source_type, {_FILE} AS filename, CASE lower(regexp_extract({_FILE}, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'png' THEN 'image/png' WHEN 'docx' THEN '{I.MEDIA_TYPES['docx']}' WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' END AS mime_type FROM document_irs")
def source_kind(spark, d):
    name = I.filename(F.col("source_uri"))
    return read(spark, d, "document_irs").select("ir_id", I.source_type(F.col("source_uri")).alias("source_type"), name.alias("filename"), I.media_type(name).alias("mime_type"))


@query("SELECT name, array_to_string(list_transform(list_filter(regexp_split_to_array(name, '[-_]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS class_name, CASE WHEN coalesce(namespace, '') <> '' THEN namespace || ':' || name ELSE name END AS spec_key, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*') AS is_identifier FROM collection_specs")
def collection_names(spark, d):
    n = F.col("name")
    return read(spark, d, "collection_specs").select("name", I.class_name(n).alias("class_name"), I.spec_key(F.col("namespace"), n).alias("spec_key"), I.is_identifier(n).alias("is_identifier"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') <> '' THEN source || ':' || tenant_id ELSE tenant_id END AS namespace_key FROM documents WHERE tenant_id IS NOT NULL")
def namespace_keys(spark, d):
    return read(spark, d, "documents").where("tenant_id IS NOT NULL").select("doc_id", I.namespace_key(F.col("tenant_id"), F.col("source")).alias("namespace_key"))


# text

_DOCS = "FROM documents WHERE text IS NOT NULL"


def _text(spark, d) -> DataFrame:
    return read(spark, d, "documents").where("text IS NOT NULL")


def _parts_sql(lst: str) -> str:
    return f"list_filter(list_transform({lst}, lambda p: {strip_sql('p')}), lambda p: p <> '')"


@query("SELECT doc_id, i AS chunk_index, substr(text, i * 200 + 1, 200) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest((length(text) + 199) // 200, 1)))::INT AS i FROM documents WHERE text IS NOT NULL)")
def chunk_fixed(spark, d):
    return _text(spark, d).select("doc_id", F.posexplode(T.chunk_fixed(F.col("text"), 200)).alias("chunk_index", "chunk"))


_PARA = _parts_sql("string_split(text, chr(10) || chr(10))")


def _unnested(expr: str) -> str:
    return f"SELECT doc_id, (unnest(range(len(c))))::INT AS chunk_index, unnest(c) AS chunk FROM (SELECT doc_id, {expr} AS c {_DOCS})"


@query(_unnested(f"CASE WHEN len({_PARA}) > 1 THEN {_PARA} WHEN length(text) <= 500 THEN [text] ELSE list_transform(range((length(text) + 499) // 500), lambda i: substr(text, (i * 500 + 1)::BIGINT, 500)) END"))
def chunk_recursive(spark, d):
    return _text(spark, d).select("doc_id", F.posexplode(T.chunk_recursive(F.col("text"), 500)).alias("chunk_index", "chunk"))


_SENT = _parts_sql("string_split(replace(text, chr(10), ' '), '.')")


@query(_unnested(f"CASE WHEN len({_SENT}) > 0 THEN {_SENT} ELSE [text] END"))
def chunk_semantic(spark, d):
    return _text(spark, d).select("doc_id", F.posexplode(T.chunk_semantic(F.col("text"))).alias("chunk_index", "chunk"))


@query(_unnested(_parts_sql("string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10))")))
def paragraph_blocks(spark, d):
    return _text(spark, d).select("doc_id", F.posexplode(T.paragraph_blocks(F.col("text"))).alias("chunk_index", "chunk"))


@query(f"SELECT doc_id, array_to_string({_PARA}, chr(10) || chr(10)) AS converted {_DOCS}")
def convert_paragraphs(spark, d):
    return _text(spark, d).select("doc_id", T.convert_paragraphs(F.col("text")).alias("converted"))


@query("SELECT doc_id, " + strip_sql(f"regexp_replace(text, '{WS}+', ' ', 'g')") + f" AS converted {_DOCS}")
def convert_whitespace(spark, d):
    return _text(spark, d).select("doc_id", T.convert_whitespace(F.col("text")).alias("converted"))


_LINES = _parts_sql(r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')")


@query(f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS converted {_DOCS}")
def convert_lines(spark, d):
    return _text(spark, d).select("doc_id", T.convert_lines(F.col("text")).alias("converted"))


@query(f"SELECT doc_id, contains(text, '```') OR contains(text, '<table') OR contains(text, '|---|') AS marked {_DOCS}")
def do_not_split_marker(spark, d):
    return _text(spark, d).select("doc_id", T.has_marker(F.col("text")).alias("marked"))


_TABLES = "(SELECT ir_id, unnest(range(len(table_blocks)))::INT AS pos, unnest(table_blocks) AS t FROM document_irs)"
_HEAD = "CASE WHEN len(coalesce(t.headers, [])) > 0 THEN t.headers ELSE list_transform(range(coalesce(len(t.rows[1]), 0)), lambda i: 'col_' || i) END"
_CELLS = "list_transform({r}, lambda c: coalesce(c, ''))"


def _tables(spark, d) -> DataFrame:
    return read(spark, d, "document_irs").select("ir_id", F.posexplode("table_blocks").alias("pos", "t"))


@query(f"SELECT ir_id, pos, {strip_sql('array_to_string(list_concat(CASE WHEN len(coalesce(t.headers, [])) > 0 THEN [array_to_string(' + _CELLS.format(r='t.headers') + ', chr(9))] ELSE [] END, list_transform(t.rows, lambda r: array_to_string(' + _CELLS.format(r='r') + ', chr(9)))), chr(10))')} AS rendered FROM {_TABLES}")
def table_text(spark, d):
    return _tables(spark, d).select("ir_id", "pos", T.render_table(F.col("t"), "table_as_text").alias("rendered"))


@query(f"SELECT ir_id, pos, array_to_string(list_concat(['| ' || array_to_string({_CELLS.format(r='h')}, ' | ') || ' |', '| ' || array_to_string(list_transform(h, lambda x: '---'), ' | ') || ' |'], list_transform(t.rows, lambda r: '| ' || array_to_string(list_transform(range(len(h)), lambda i: coalesce(r[i + 1], '')), ' | ') || ' |')), chr(10)) AS rendered FROM (SELECT *, {_HEAD} AS h FROM {_TABLES})")
def table_markdown(spark, d):
    return _tables(spark, d).select("ir_id", "pos", T.render_table(F.col("t")).alias("rendered"))


@query(f"SELECT ir_id, pos, array_to_string(list_concat(['<table>'], CASE WHEN len(coalesce(t.headers, [])) > 0 THEN ['  <thead><tr>' || array_to_string(list_transform(t.headers, lambda x: '<th>' || coalesce(x, '') || '</th>'), '') || '</tr></thead>'] ELSE [] END, ['  <tbody>'], list_transform(t.rows, lambda r: '    <tr>' || array_to_string(list_transform(r, lambda x: '<td>' || coalesce(x, '') || '</td>'), '') || '</tr>'), ['  </tbody>', '</table>']), chr(10)) AS rendered FROM {_TABLES}")
def table_html(spark, d):
    return _tables(spark, d).select("ir_id", "pos", T.render_table(F.col("t"), "table_as_html").alias("rendered"))


@query(f"SELECT ir_id, array_to_string(list_filter(list_transform(text_blocks, lambda b: b.text), lambda t: {strip_sql('t')} <> ''), chr(10) || chr(10)) AS text FROM document_irs")
def full_text(spark, d):
    return read(spark, d, "document_irs").select("ir_id", T.full_text(F.col("text_blocks")).alias("text"))


@query("SELECT doc_id, coalesce(n_chars < 200 AND (doc_id % 10) / 10.0 >= 0.5, false) AS enabled, CASE WHEN coalesce(n_chars < 200 AND (doc_id % 10) / 10.0 >= 0.5, false) THEN 'auto_triggered' ELSE 'auto_not_required' END AS reason FROM documents")
def ocr_decision(spark, d):
    return read(spark, d, "documents").select("doc_id", T.ocr_decision("auto", F.col("n_chars"), F.col("doc_id") % 10 / 10.0).alias("o")).select("doc_id", "o.enabled", "o.reason")


@query("SELECT ir_id, coalesce(quality['confidence'], 1.0) >= 0.8 AS passed FROM document_irs")
def quality_gate(spark, d):
    return read(spark, d, "document_irs").select("ir_id", T.quality_passed(F.col("quality"), 0.8).alias("passed"))


@query(f"SELECT ir_id, length({strip_sql('x')}) >= 500 AND len(list_filter(text_blocks, lambda b: b.kind = 'heading' OR coalesce(starts_with({strip_sql('b.text')}, '#') AND length({strip_sql('b.text')}) > 1, false))) > 0 AS passed FROM (SELECT *, array_to_string(list_filter(list_transform(text_blocks, lambda b: b.text), lambda t: {strip_sql('t')} <> ''), chr(10) || chr(10)) AS x FROM document_irs)")
def quality_invariants(spark, d):
    return read(spark, d, "document_irs").select("ir_id", T.invariants_passed(F.col("text_blocks"), F.col("table_blocks"), F.lit(500), F.lit(True), F.lit(False)).alias("passed"))


# lifecycle

_E = "coalesce({s}, '') = ''"
_UTC_RX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|\+00:00)$"


def _validate_sql() -> str:
    m = lambda f: strip_sql(f"metadata.{f}")
    given = lambda f: f"coalesce({m(f)}, '') <> ''"
    missing = ", ".join(f"CASE WHEN coalesce({m(f)}, '') = '' THEN '{f}' END" for f in ("created_at", "doc_id", "lifecycle_state", "source_uri"))
    checks = [f"CASE WHEN len(mi) > 0 THEN 'missing: ' || array_to_string(mi, ', ') END", f"CASE WHEN {given('source_type')} AND {m('source_type')} NOT IN ('web', 'file', 'api', 'database', 'other') THEN 'invalid source_type' END", f"CASE WHEN {given('lifecycle_state')} AND {m('lifecycle_state')} NOT IN ('active', 'deleted', 'superseded', 'archived') THEN 'invalid lifecycle_state' END"]
    checks += [f"CASE WHEN {given(f)} AND NOT (regexp_matches({m(f)}, '{_UTC_RX}') AND try_cast({m(f)} AS TIMESTAMPTZ) IS NOT NULL) THEN 'invalid {f} (must be UTC RFC3339)' END" for f in ("created_at", "ingested_at")]
    checks += [f"CASE WHEN {given(f)} AND NOT regexp_matches({m(f)}, '^[0-9a-fA-F]+$') THEN 'invalid {f} (must be hex)' END" for f in ("content_hash", "source_hash")]
    checks.append("CASE WHEN metadata.ocr_confidence < 0 OR metadata.ocr_confidence > 1 THEN 'invalid ocr_confidence' END")
    return f"SELECT record_id, array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), '; ') AS errors FROM (SELECT *, list_filter([{missing}], lambda x: x IS NOT NULL) AS mi FROM records)"


@query(_validate_sql())
def validate_metadata(spark, d):
    r = read(spark, d, "records")
    m = {f: F.col(f"metadata.{f}") for f in ("doc_id", "source_uri", "lifecycle_state", "created_at", "source_type", "ingested_at", "content_hash", "source_hash", "ocr_confidence")}
    return r.select("record_id", F.array_join(lifecycle.validation_errors(m), "; ").alias("errors"))


@query("""WITH a AS (SELECT record_id, metadata m, coalesce(nullif(metadata.ocr_provider, ''), metadata.ocr_engine) AS op, coalesce(nullif(metadata.section_path, ''), metadata.section) AS sp, coalesce(nullif(metadata.section, ''), metadata.section_path) AS se, coalesce(metadata.page, metadata.page_number) AS pg FROM records)
SELECT record_id, coalesce(nullif(op, ''), 'scanner') AS ocr_provider, coalesce(pg, 1) AS page, coalesce(nullif(sp, ''), 'appendix') AS section_path, coalesce(nullif(coalesce(nullif(se, ''), 'appendix'), ''), 'appendix') AS section, coalesce(nullif(m.parser_provider, ''), 'internal') AS parser_provider FROM a""")
def provenance_merge(spark, d):
    r = _records(spark, d)
    cols = {c: F.col(c) for c in ("ocr_provider", "ocr_engine", "page", "page_number", "section", "section_path", "parser_provider")}
    m = lifecycle.merge_provenance(cols, {"ocr_provider": F.lit("scanner"), "page": F.lit(1), "section_path": F.lit("appendix"), "parser_provider": F.lit("internal")})
    return r.select("record_id", *[m[c].alias(c) for c in ("ocr_provider", "page", "section_path", "section", "parser_provider")])


_BATCHES = """WITH base AS (SELECT 'd' || (doc_id % 300) AS doc_id, 'r' || doc_id AS record_id, (doc_id % 3)::INT AS chunk_index, doc_id AS seq, doc_id % 5 = 0 AS late FROM documents),
ex AS (SELECT * FROM base WHERE NOT late), nw AS (SELECT * FROM base WHERE late UNION ALL SELECT doc_id, record_id, chunk_index, seq + 100000000, late FROM base WHERE seq % 10 = 1),
lastw AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1),
kept AS (SELECT l.doc_id, l.record_id, l.chunk_index, coalesce(e.seq, l.seq) AS seq FROM lastw l LEFT JOIN ex e USING (record_id)),
bc AS (SELECT doc_id, chunk_index, max_by(record_id, seq) AS a FROM nw GROUP BY 1, 2), bd AS (SELECT doc_id, min_by(record_id, seq) AS b FROM nw GROUP BY 1)
SELECT e.record_id, e.doc_id, e.seq, CASE WHEN b IS NOT NULL THEN 'superseded' ELSE 'active' END AS lifecycle_state, b IS NULL AS is_latest, CASE WHEN b IS NOT NULL THEN coalesce(a, b) END AS supersedes
FROM ex e LEFT JOIN bd USING (doc_id) LEFT JOIN bc ON bc.doc_id = e.doc_id AND bc.chunk_index = e.chunk_index WHERE e.record_id NOT IN (SELECT record_id FROM kept)
UNION ALL SELECT record_id, doc_id, seq, 'active', true, NULL FROM kept"""


@query(_BATCHES)
def upsert_supersede(spark, d):
    i = F.col("doc_id")
    base = read(spark, d, "documents").select(
        F.concat(F.lit("d"), i % 300).alias("doc"), F.concat(F.lit("r"), i).alias("record_id"), (i % 3).cast("int").alias("chunk_index"), i.alias("seq"),
        F.lit("active").alias("lifecycle_state"), F.lit(True).alias("is_latest"), F.lit(None).cast("string").alias("supersedes"), (i % 5 == 0).alias("late"),
    ).withColumnRenamed("doc", "doc_id")
    batch = base.where("late").unionByName(base.where("seq % 10 = 1").withColumn("seq", F.col("seq") + 100000000))
    return lifecycle.upsert(base.where("NOT late").drop("late"), batch.drop("late")).select("record_id", "doc_id", "seq", "lifecycle_state", "is_latest", "supersedes")


@query("SELECT record_id, CASE WHEN metadata.tenant_id = 'tnt-quenby' THEN 'deleted' ELSE lifecycle_state END AS lifecycle_state, CASE WHEN metadata.tenant_id = 'tnt-quenby' THEN false ELSE metadata.is_latest END AS is_latest FROM records")
def soft_delete(spark, d):
    return lifecycle.soft_delete(_records(spark, d), F.col("tenant_id") == "tnt-quenby").select("record_id", "lifecycle_state", "is_latest")


@query("SELECT count(*) FILTER (metadata.tenant_id = 'tnt-quenby' AND lifecycle_state = 'active') AS deleted FROM records")
def delete_by_filter(spark, d):
    return lifecycle.delete_by_filter(_records(spark, d), {"tenant_id": "tnt-quenby", "lifecycle_state": "active"})[1]


_EXPIRED = "coalesce(TIMESTAMPTZ '2025-06-01 00:00:00+00' >= try_cast(CASE WHEN regexp_matches(metadata.created_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN metadata.created_at ELSE metadata.created_at || 'Z' END AS TIMESTAMPTZ) + to_days(CASE WHEN {ttl} IS NOT NULL THEN greatest({ttl}, 0) END), false)"


@query(f"SELECT record_id, {_EXPIRED.format(ttl='metadata.ttl_days')} AS expired FROM records")
def ttl_expired(spark, d):
    return _records(spark, d).select("record_id", lifecycle.ttl_expired(F.col("created_at"), F.col("ttl_days"), NOW).alias("expired"))


@query(f"SELECT record_id FROM records WHERE {_EXPIRED.format(ttl='coalesce(metadata.ttl_days, 180)')}")
def purge_candidates(spark, d):
    return lifecycle.purge_candidates(_records(spark, d), 180, NOW).select("record_id")


@query(f"SELECT record_id, coalesce(lower({strip_sql('lifecycle_state')}) IN ('deleted', 'superseded', 'archived'), false) AND metadata.is_latest IS NOT DISTINCT FROM false AS safe FROM records")
def purge_safe(spark, d):
    return _records(spark, d).select("record_id", lifecycle.purge_safe(F.col("lifecycle_state"), F.col("is_latest")).alias("safe"))


_P3 = r"""WITH t AS (SELECT *, regexp_matches(trim(ingested_at), '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$') AS ok FROM metadata_updates WHERE record_id IS NOT NULL),
u AS (SELECT record_id, epoch_us(try_cast(CASE WHEN regexp_matches(trim(ingested_at), '([Zz]|[+-]\d{2}:?\d{2})$') THEN trim(ingested_at) ELSE trim(ingested_at) || 'Z' END AS TIMESTAMPTZ)) AS us, received_at, update_id, {s} AS state, is_latest, coalesce(supersedes, '') AS sup FROM t WHERE ok),
l AS (SELECT * FROM u WHERE us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, us ORDER BY received_at DESC, update_id DESC) = 1),
c AS (SELECT *, row_number() OVER w = 1 OR lag(state) OVER w IS DISTINCT FROM state OR lag(is_latest) OVER w IS DISTINCT FROM is_latest OR lag(sup) OVER w IS DISTINCT FROM sup AS begins FROM l WINDOW w AS (PARTITION BY record_id ORDER BY us))
SELECT record_id, (row_number() OVER (PARTITION BY record_id ORDER BY us))::INT AS version_no, us AS valid_from_us FROM c WHERE begins""".replace("{s}", f"lower({strip_sql('lifecycle_state')})")


@query(_P3)
def p3_found(spark, d):
    """Versions of each record's lifecycle attributes."""
    return history.metadata_history(read(spark, d, "metadata_updates")).select("record_id", F.col("version_no").cast("int").alias("version_no"), "valid_from_us")


# versions, jobs, comparison, payloads


@query("""WITH g AS (SELECT user_id AS collection, event_id AS seq, (64 + (event_id % 2) * 32)::INT AS dim, ['b', 'a', event_type] AS fields, 'm' || (user_id % 3) AS model FROM events),
s AS (SELECT *, sha256(dim || '|' || array_to_string(list_sort(fields), ',') || '|' || model) AS signature FROM g),
c AS (SELECT *, (lag(signature) OVER (PARTITION BY collection ORDER BY seq) IS DISTINCT FROM signature)::INT AS changed FROM s)
SELECT collection, seq, signature, (sum(changed) OVER (PARTITION BY collection ORDER BY seq))::BIGINT AS version FROM c""")
def schema_versions(spark, d):
    e = read(spark, d, "events")
    g = e.select(F.col("user_id").alias("collection"), F.col("event_id").alias("seq"), (64 + F.col("event_id") % 2 * 32).cast("int").alias("dim"), F.array(F.lit("b"), F.lit("a"), "event_type").alias("fields"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"))
    return C.versions(g).select("collection", "seq", "signature", "version")


@query("SELECT name AS collection, embedding_dim <> 64 AS dimension_changed, false AS model_changed, distance_metric <> 'cosine' AS fields_changed, embedding_dim <> 64 AS re_embed FROM collection_specs")
def migration_plan(spark, d):
    s = read(spark, d, "collection_specs")
    old = s.select(F.col("name").alias("collection"), F.col("embedding_dim").alias("dim"), F.array("distance_metric").alias("fields"), F.lit("m").alias("model"))
    return C.migration(old, old.withColumn("dim", F.lit(64)).withColumn("fields", F.array(F.lit("cosine"))))


@query("SELECT event_type AS provider_id, count(*) AS total, count(*) FILTER (user_id % 3 > 0) AS ok, round(count(*) FILTER (user_id % 3 > 0) / count(*), 6) AS success_ratio, round(coalesce(avg(value) FILTER (user_id % 3 > 0), 0), 6) AS mean_parse_time_ms, round(coalesce(avg((event_id % 2)::DOUBLE) FILTER (user_id % 3 > 0), 0), 6) AS quality_invariant_pass_rate FROM events GROUP BY 1")
def comparison_summary(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("provider_id"), F.when(F.col("user_id") % 3 > 0, "ok").otherwise("error").alias("status"), F.col("value").alias("parse_time_ms"), (F.col("event_id") % 2).cast("double").alias("quality_invariant_pass_rate"))
    out = C.comparison(e)
    return out.select("provider_id", "total", "ok", *[F.round(c, 6).alias(c) for c in ("success_ratio", "mean_parse_time_ms", "quality_invariant_pass_rate")])


@query("SELECT event_id, round(CASE WHEN event_id % 7 <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (user_id % 9) / (event_id % 7))) END, 6) AS progress, CASE WHEN event_id % 7 <= 0 OR user_id % 9 = 0 THEN 'queued' WHEN (user_id % 9) / (event_id % 7) >= 1 THEN 'completed' ELSE 'running' END AS status FROM events")
def job_status(spark, d):
    done, total = F.col("user_id") % 9, F.col("event_id") % 7
    return read(spark, d, "events").select("event_id", F.round(C.progress(done, total), 6).alias("progress"), C.job_status(done, total).alias("status"))


@query("SELECT event_type AS key, round(sum(value), 2) AS total, max_by(value, event_id) AS last FROM events GROUP BY 1")
def metrics(spark, d):
    return C.metrics(read(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("seq"))).withColumn("total", F.round("total", 2))


_HITS = "SELECT vec_id AS payload_id, 0 AS pos, 'v' || vec_id AS id, round(label / 16.0, 6) AS score, 'text ' || label AS content, '{\"n\":' || label || '}' AS metadata, 'D' AS dialect FROM embeddings"


def _dialect(spark, d, dialect: str, make) -> DataFrame:
    e = read(spark, d, "embeddings")
    v, s = F.concat(F.lit("v"), F.col("vec_id")), (F.col("label") / 16.0)
    t, m = F.concat(F.lit("text "), F.col("label")), F.struct(F.col("label").alias("n"))
    return payloads.normalised(e.select(F.col("vec_id").alias("payload_id"), F.to_json(make(v, s, t, m)).alias("payload")), dialect).withColumn("score", F.round("score", 6)).withColumn("dialect", F.lit(dialect))


@query(" UNION ALL ".join(_HITS.replace("'D'", f"'{x}'") for x in payloads.DIALECTS))
def normalise_payload(spark, d):
    st, ar = F.struct, F.array
    shapes = {
        "portable": lambda v, s, t, m: st(ar(st(v.alias("id"), s.alias("score"), t.alias("content"), m.alias("metadata"))).alias("results")),
        "chroma": lambda v, s, t, m: st(ar(ar(v)).alias("ids"), ar(ar(1 - s)).alias("distances"), ar(ar(t)).alias("documents"), ar(ar(m)).alias("metadatas")),
        "qdrant": lambda v, s, t, m: st(ar(st(F.lit("x").alias("id"), s.alias("score"), st(v.alias("external_id"), t.alias("text"), m.alias("metadata")).alias("payload"))).alias("result")),
        "weaviate": lambda v, s, t, m: st(ar(st(v.alias("external_id"), t.alias("text"), m.alias("metadata"), st((1 - s).alias("distance")).alias("_additional"))).alias("objects")),
        "opensearch": lambda v, s, t, m: st(st(ar(st(v.alias("_id"), s.alias("_score"), st(t.alias("text"), m.alias("metadata")).alias("_source"))).alias("hits")).alias("hits")),
        "pgvector": lambda v, s, t, m: st(ar(st(v.alias("id"), s.alias("score"), t.alias("content"), m.alias("metadata"))).alias("rows")),
    }
    out = None
    for name in payloads.DIALECTS:
        part = _dialect(spark, d, name, shapes[name])
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, CASE WHEN m IN ('application/pdf', 'application/x-pdf', 'application/msword', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/html', 'application/xhtml+xml') THEN true WHEN starts_with(m, 'text/') THEN false ELSE true END AS accepted FROM (SELECT doc_id, split_part(lower(trim(coalesce(mime_type, ''))), ';', 1) AS m FROM documents)")
def parser_input_gate(spark, d):
    return read(spark, d, "documents").select("doc_id", parsers.accepts(F.lit(""), F.col("mime_type")).alias("accepted"))


@query("SELECT ir_id, r.ref AS ref, CASE WHEN lower(r.ref) LIKE '%.png' THEN 'image/png' WHEN lower(r.ref) LIKE '%.webp' THEN 'image/webp' WHEN lower(r.ref) LIKE '%.gif' THEN 'image/gif' ELSE 'image/jpeg' END AS mime_type FROM (SELECT ir_id, unnest(artefact_refs) AS r FROM document_irs)")
def image_types(spark, d):
    refs = read(spark, d, "document_irs").select("ir_id", F.explode("artefact_refs").alias("r"))
    return refs.select("ir_id", "r.ref", parsers.image_type(F.col("r.ref")).alias("mime_type"))


@query(f"SELECT ir_id, '## ' || {strip_sql('b.text')} AS text, b.page AS page FROM (SELECT ir_id, unnest(list_filter(text_blocks, lambda x: x.kind = 'heading')) AS b FROM document_irs) WHERE {strip_sql('b.text')} <> ''")
def toc_headings(spark, d):
    irs = read(spark, d, "document_irs")
    toc = F.transform(F.filter("text_blocks", lambda b: b["kind"] == "heading"), lambda b: F.struct(b["text"].alias("title"), F.lit(2).alias("level"), b["page"].alias("page_id")))
    payload = F.to_json(F.struct(F.struct(toc.alias("table_of_contents")).alias("metadata")))
    return irs.select("ir_id", F.explode(parsers.toc_blocks(payload)).alias("b")).select("ir_id", "b.text", "b.page")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'not_found' WHEN 2 THEN 'timeout' WHEN 3 THEN 'busy' ELSE 'other' END AS error_kind, 'j' || event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' END AS ended FROM events")
def service_answers(spark, d):
    k, m = F.col("event_id") % 5, F.col("event_id") % 4
    message = F.when(k == 0, "CUDA out of memory").when(k == 1, "status 404 here").when(k == 2, "ReadTimeout").when(k == 3, "HTTP 429").otherwise("odd")
    job = F.to_json(F.struct(F.struct(F.concat(F.lit("j"), F.col("event_id")).alias("request_id")).alias("result")))
    status = F.when(m == 0, " Canceled").when(m == 1, "DONE").otherwise("waiting")
    ended = C.async_status(status, m >= 2, m == 2, F.lit(False))
    return read(spark, d, "events").select("event_id", parsers.error_kind(message).alias("error_kind"), parsers.job_id(job).alias("job_id"), ended.alias("ended"))


@query("SELECT ir_id, pos, page FROM (SELECT *, row_number() OVER (PARTITION BY ir_id ORDER BY pos) AS n, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY ir_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT ir_id, unnest(range(len(text_blocks)))::INT AS pos, unnest(text_blocks, recursive := true) FROM document_irs)) WHERE before < 1500 AND n <= 6")
def pages_until_enough(spark, d):
    b = read(spark, d, "document_irs").select(F.col("ir_id").alias("doc"), F.posexplode("text_blocks").alias("pos", "b"))
    return parsers.pages_until(b.select("doc", F.col("pos").alias("page"), "b.text", F.col("b.page").alias("real")), 1_500, 6).select(F.col("doc").alias("ir_id"), F.col("page").alias("pos"), F.col("real").alias("page"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import pipelines  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import pipelines  # noqa: F401

    return dict(_SQL)
