"""Search results in the JSON dialects of several stores, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIALECTS = ("portable", "chroma", "qdrant", "weaviate", "opensearch", "pgvector")


def _list(text: Column) -> Column:
    """text if it is a JSON array, else null."""
    return F.when(F.ltrim(text).startswith("["), text)


def _first_list(text: Column) -> Column:
    """A JSON array, or that under an object's first key; null for others and for empty ones."""
    inside = F.try_element_at(F.map_values(F.from_json(F.when(F.ltrim(text).startswith("{"), text), "map<string,string>")), F.lit(1))
    return F.nullif(F.coalesce(_list(text), _list(inside)), F.lit("[]"))


def _items(dialect: str) -> Column:
    """The JSON array of a payload's hits."""
    at = lambda p: F.get_json_object("payload", p)
    inside = {
        "portable": [at("$.results")],
        "qdrant": [_list(at("$.result")), at("$.result.points")],
        "weaviate": [_first_list(at("$.data.Get")), _first_list(at("$.objects"))],
        "opensearch": [at("$.hits.hits")],
        "pgvector": [at("$.rows")],
    }
    return F.coalesce(_list(F.col("payload")), *[_list(x) for x in inside.get(dialect, [])])


def normalised(payloads: DataFrame, dialect: str) -> DataFrame:
    """(payload_id, pos, id, score, content, metadata) of (payload_id, payload): metadata as JSON text.

    A payload may be a bare list of hits as well as a store's answer; hits that are no objects are left out, metadata that is no object
    is empty, a missing score 0, distances become 1 - distance. A payload that is null or no JSON of the dialect gives no rows.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    j = lambda p: F.get_json_object("item", p)
    score = F.coalesce(j("$.score").try_cast("double"), F.lit(0.0))
    plain = (j("$.id"), score, F.coalesce(j("$.content"), j("$.payload.content")), F.coalesce(j("$.metadata"), j("$.payload.metadata")))
    own = {
        "qdrant": (F.coalesce(j("$.payload.external_id"), j("$.id")), score, j("$.payload.text"), j("$.payload.metadata")),
        "weaviate": (F.coalesce(j("$.external_id"), j("$._additional.id")), 1 - F.coalesce(j("$._additional.distance").try_cast("double"), F.lit(1.0)), j("$.text"), j("$.metadata")),
        "opensearch": (j("$._id"), F.coalesce(j("$._score").try_cast("double"), F.lit(0.0)), j("$._source.text"), j("$._source.metadata")),
    }
    bare = _list(F.col("payload")).isNotNull()
    listed = payloads.select("payload_id", bare.alias("bare"), F.posexplode(F.from_json(_items(dialect), "array<string>")).alias("pos", "item")).where(F.ltrim("item").startswith("{"))
    parts = own.get(dialect, plain)
    if dialect == "opensearch":  # a bare list is a portable one
        parts = tuple(F.when(F.col("bare"), p).otherwise(q) for p, q in zip(plain, parts, strict=True))
    hits = listed.select("payload_id", "pos", *[p.alias(n) for p, n in zip(parts, ("id", "score", "content", "metadata"), strict=True)])
    if dialect == "chroma":
        kind = "array<array<string>>"
        get = lambda k: F.try_element_at(F.from_json(F.when(~bare, F.get_json_object("payload", f"$.{k}")), kind), F.lit(1))
        z = F.arrays_zip(get("ids").alias("i"), F.coalesce(get("distances"), F.array().cast("array<string>")).alias("d"), F.coalesce(get("documents"), F.array().cast("array<string>")).alias("c"), F.coalesce(get("metadatas"), F.array().cast("array<string>")).alias("m"))
        rows = payloads.select("payload_id", F.posexplode(z).alias("pos", "x"))
        columns = rows.select("payload_id", "pos", F.col("x.i").alias("id"), (1 - F.coalesce(F.col("x.d").try_cast("double"), F.lit(1.0))).alias("score"), F.col("x.c").alias("content"), F.col("x.m").alias("metadata"))
        hits = hits.unionByName(columns.where("id IS NOT NULL"))
    return hits.withColumns({"content": F.coalesce("content", F.lit("")), "metadata": F.when(F.ltrim("metadata").startswith("{"), F.col("metadata")).otherwise("{}")})


def record(payloads: DataFrame, dialect: str) -> DataFrame:
    """(payload_id, record_id, content, metadata, lifecycle_state) of payloads that are a single record each."""
    j = lambda p: F.get_json_object("payload", p)
    if dialect == "portable":
        rows = payloads.where(F.ltrim("payload").startswith("{")).select("payload_id", F.coalesce(j("$.record_id"), j("$.id"), F.lit("")).alias("record_id"), F.coalesce(j("$.content"), F.lit("")).alias("content"), F.coalesce(j("$.metadata"), F.lit("{}")).alias("metadata"), j("$.lifecycle_state").alias("_state"))
    else:
        one = payloads.select("payload_id", F.concat(F.lit("["), "payload", F.lit("]")).alias("payload"))
        rows = normalised(one, dialect).select("payload_id", F.col("id").alias("record_id"), "content", "metadata", F.get_json_object("metadata", "$.lifecycle_state").alias("_state"))
    return rows.withColumn("lifecycle_state", F.coalesce("_state", F.lit("active"))).drop("_state")


def to_page_content(records: DataFrame) -> DataFrame:
    """(page_content, metadata), as one family of frameworks names them."""
    return records.select(F.col("content").alias("page_content"), "metadata")


def to_text(records: DataFrame) -> DataFrame:
    """(text, metadata), as another one does."""
    return records.select(F.col("content").alias("text"), "metadata")


def from_page_content(documents: DataFrame) -> DataFrame:
    """(content, metadata) of the first family's documents; a null text is empty."""
    return documents.select(F.coalesce("page_content", F.lit("")).alias("content"), "metadata")


def from_text(nodes: DataFrame) -> DataFrame:
    """(content, metadata) of the other's nodes."""
    return nodes.select(F.coalesce("text", F.lit("")).alias("content"), "metadata")
