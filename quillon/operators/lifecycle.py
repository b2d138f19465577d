"""Records through their life: validation, provenance, upsert, supersession, deletion, expiry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import strip, without_nul
from ..schemas import LIFECYCLE_STATES, METADATA, REQUIRED, SOURCE_TYPES
from . import filters

_UTC = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|\+00:00)\z"


def provenance_patch(columns: Mapping[str, Column]) -> Column:
    """A map of the columns with a value: null and empty text are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False))))


def chunk_metadata(m: dict[str, Column], chunk_index: Column, chunk: Column, tokens: Column) -> dict[str, Column]:
    """A document's metadata columns as one of its chunks has them: hash and ids of its own, the document's source hash (else its content hash, else the chunk's)."""
    own = identity.content_hash(chunk)
    source = F.coalesce(*[F.nullif(m[c], F.lit("")) for c in ("source_hash", "content_hash")], own)
    doc = _filled(m["doc_id"], identity.doc_id(m["source_uri"], source))
    return m | {
        "doc_id": doc, "record_id": identity.record_id(doc, chunk_index), "chunk_id": _filled(m["chunk_id"], chunk_index.cast("string")), "chunk_index": chunk_index,
        "content_hash": own, "source_hash": source, "token_count": tokens, "is_latest": F.coalesce(m["is_latest"], F.lit(True)),
    }


def canonical(metadata: Column) -> Column:
    """A map of metadata as a struct of the known fields and the rest as extras; values that don't fit their field's type are null."""
    known = [f.split(" ", 1) for f in METADATA.split(", ")][:-1]
    names = [n for n, _ in known]

    def value(n: str, t: str) -> Column:
        v = F.try_element_at(metadata, F.lit(n))
        return F.from_json(v, t) if t.startswith("array") else v.try_cast(t)

    return F.struct(*[value(n, t).alias(n) for n, t in known], F.map_filter(metadata, lambda k, _: ~k.isin(*names)).alias("extras"))


def flattened(m: Column) -> Column:
    """A canonical struct as one map of text, extras counting before fields of their name; null, empty text and empty lists are left out."""
    known = [f.split(" ", 1) for f in METADATA.split(", ")][:-1]
    pairs = [F.struct(F.lit(n).alias("key"), (F.when(F.size(m[n]) > 0, F.to_json(m[n])) if t.startswith("array") else m[n].cast("string")).alias("value")) for n, t in known]
    extras = F.coalesce(m["extras"], F.create_map().cast("map<string,string>"))
    fields = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"] != "", F.lit(False)) & ~F.map_contains_key(extras, p["key"])))
    return F.map_concat(fields, F.map_filter(extras, lambda _, v: F.coalesce(v != "", F.lit(False))))


def is_utc(c: Column) -> Column:
    """RFC 3339 in UTC that names an existing instant."""
    return F.coalesce(c.rlike(_UTC) & c.try_cast("timestamp").isNotNull(), F.lit(False))


def empty(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def validation_errors(m: Column, size: Column | None = None, most_bytes: int = 65_536) -> Column:
    """What is wrong with a metadata struct, in the order of the checks; size: bytes of its JSON, where known."""
    given = lambda f: F.coalesce(strip(m[f]) != "", F.lit(False))
    missing = F.array_compact(F.array(*[F.when(empty(m[f]), F.lit(f)) for f in sorted(REQUIRED)]))
    checks = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        F.when(given("source_type") & ~strip(m["source_type"]).isin(*SOURCE_TYPES), "invalid source_type"),
        F.when(given("lifecycle_state") & ~strip(m["lifecycle_state"]).isin(*LIFECYCLE_STATES), "invalid lifecycle_state"),
    ]
    checks += [F.when(given(f) & ~is_utc(strip(m[f])), f"invalid {f} (must be UTC RFC3339)") for f in ("created_at", "ingested_at")]
    checks += [F.when(given(f) & ~strip(m[f]).rlike(r"\A[0-9a-fA-F]+\z"), f"invalid {f} (must be hex)") for f in ("content_hash", "source_hash")]
    checks.append(F.when((m["ocr_confidence"] < 0) | (m["ocr_confidence"] > 1), "invalid ocr_confidence"))
    if size is not None:
        checks.append(F.when(size >= most_bytes, F.concat(F.lit("metadata_too_large:"), size)))
    return F.array_compact(F.array(*checks))


def json_bytes(text: Column) -> Column:
    """Bytes of a compact JSON text once written with ASCII escapes and a space after each separator; 0 for null."""
    characters = F.char_length(text)
    ascii_ = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    beyond = F.char_length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))  # two escapes each
    outside = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")  # without escapes, then without strings
    separators = F.char_length(F.regexp_replace(outside, "[^,:]", ""))
    return F.coalesce(ascii_ + 6 * (characters - ascii_) + 6 * beyond + separators, F.lit(0))


def _filled(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


def merge_provenance(m: dict[str, Column], patch: dict[str, Column]) -> dict[str, Column]:
    """Metadata columns with the gaps filled: first each of two names of one thing by the other, then from the patch, then by name again."""
    pairs = (("ocr_provider", "ocr_engine"), ("section_path", "section"))
    out = dict(m)

    def by_name() -> None:
        for a, b in pairs:
            out[a], out[b] = _filled(out[a], out[b]), _filled(out[b], out[a])
        out["page_number"], out["page"] = F.coalesce(out["page_number"], out["page"]), F.coalesce(out["page"], out["page_number"])

    by_name()
    for k, v in patch.items():
        out[k] = F.coalesce(out[k], v) if k in ("page", "page_number", "ocr_confidence", "ocr_applied") else _filled(out[k], v)
    by_name()
    return out


#: Columns that normalised() reads; one that is missing counts as null.
_READ = {c: "string" for c in ("content", "source_uri", "doc_id", "record_id", "chunk_id", "source_hash", "document_content_hash", "doc_content_hash", "content_hash", "lifecycle_state", "created_at", "ingested_at", "source_type", "embedding_model", "chunker_version", "collection", "namespace", "ocr_provider", "ocr_engine", "section", "section_path")} | {"chunk_index": "int", "is_latest": "boolean", "page": "int", "page_number": "int", "ocr_confidence": "double"}


def normalised(rows: DataFrame, now: str, collection: str | None = None, namespace: str | None = None) -> DataFrame:
    """Rows made ready for the store: no NUL characters, provenance under both names, defaults, hashes and ids.

    Given hashes and ids are kept. A document is identified by its source hash, else a hash of the whole document, else the content's. now (RFC 3339) stands for a missing
    created_at, chunk_id (0 by default) for a missing chunk_index. A null content counts as empty; a chunk_id that is no number gives a null chunk_index, and a missing address a null doc_id, which checked() refuses.
    Columns that are missing are added.
    """
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _READ.items() if c not in rows.columns])
    text = without_nul(F.coalesce("content", F.lit("")))
    m = merge_provenance({c: F.col(c) for c in ("ocr_provider", "ocr_engine", "section", "section_path", "page", "page_number")}, {})
    rows = rows.withColumns({"content": text, "content_hash": _filled(F.col("content_hash"), identity.content_hash(text)), **m, "collection": F.coalesce("collection", F.lit(collection)), "namespace": F.coalesce("namespace", F.lit(namespace))})
    basis = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("source_hash", "document_content_hash", "doc_content_hash")], F.col("content_hash"))
    chunk = F.coalesce("chunk_id", F.lit("0"))
    rows = rows.withColumns({"doc_id": _filled(F.col("doc_id"), identity.doc_id(F.col("source_uri"), basis)), "source_hash": F.coalesce("source_hash", basis), "chunk_id": chunk, "chunk_index": F.coalesce("chunk_index", chunk.try_cast("int"))})
    rows = rows.withColumn("record_id", _filled(F.col("record_id"), identity.record_id(F.col("doc_id"), F.col("chunk_index"))))
    return rows.withColumns({
        "lifecycle_state": F.coalesce("lifecycle_state", F.lit("active")), "is_latest": F.coalesce("is_latest", F.lit(True)), "created_at": F.coalesce("created_at", F.lit(now)),
        "embedding_model": F.coalesce("embedding_model", F.lit("unspecified")), "chunker_version": F.coalesce("chunker_version", F.lit("v1")),
    })


def errors_of(rows: DataFrame) -> Column:
    """All that is wrong with a normalised row, with the size of its metadata (all columns but content and embedding)."""
    size = json_bytes(F.to_json(F.struct(*[c for c in rows.columns if c not in ("content", "embedding", "seq")])))
    number = F.when(F.col("chunk_index").isNull(), F.lit("chunk_index is no number"))
    return F.concat(F.array_compact(F.array(number)), validation_errors({c: F.col(c) for c in rows.columns}, size))


def checked(rows: DataFrame) -> DataFrame:
    """Normalised rows if all of them are valid, else ValueError: one bad row keeps the whole batch out."""
    bad = rows.select(errors_of(rows).alias("e")).where("size(e) > 0").limit(5).collect()
    if bad:
        raise ValueError("invalid metadata: " + " | ".join("; ".join(r.e) for r in bad))
    return rows


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by order; a partial aggregate, so a key with many rows costs one row a task."""
    cols = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*")


def upsert(existing: DataFrame, batch: DataFrame, key: str = "record_id", doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """existing with a batch written: rows of a document that the batch brings anew are superseded, rows with a key of the batch replaced.

    Both have the columns key, doc, order, chunk_index, lifecycle_state, is_latest, supersedes and any others, alike. Of several batch rows of a
    key the last counts; a replaced row keeps its place in the order. A superseded row names the record that follows it: the batch's last of its chunk index, else the
    batch's first of the document. Rows of one batch never supersede each other. Null keys match nothing.
    """
    new = last_of(batch, key, order)
    old_place = existing.groupBy(key).agg(F.min(order).alias("_place"))
    placed = new.join(old_place, key, "left").withColumn(order, F.coalesce("_place", order)).drop("_place")
    by_chunk = batch.groupBy(doc, F.coalesce("chunk_index", F.lit(0)).alias("_c")).agg(F.max_by(key, order).alias("_a"))
    by_doc = batch.groupBy(doc).agg(F.min_by(key, order).alias("_b"))
    rest = existing.join(new.select(key), key, "left_anti").join(by_doc, doc, "left").withColumn("_c", F.coalesce("chunk_index", F.lit(0))).join(by_chunk, [doc, "_c"], "left")
    gone = F.col("_b").isNotNull()
    rest = rest.withColumns({
        "lifecycle_state": F.when(gone, F.lit("superseded")).otherwise(F.col("lifecycle_state")),
        "is_latest": F.when(gone, F.lit(False)).otherwise(F.col("is_latest")),
        "supersedes": F.when(gone, F.coalesce("_a", "_b")).otherwise(F.col("supersedes")),
    })
    return rest.select(*existing.columns).unionByName(placed.select(*existing.columns))


def soft_delete(records: DataFrame, where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return records.withColumns({"lifecycle_state": F.when(hit, F.lit("deleted")).otherwise(F.col("lifecycle_state")), "is_latest": F.when(hit, F.lit(False)).otherwise(F.col("is_latest"))})


def hard_delete(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    return records.join(ids.select(key), key, "left_anti")


def update(records: DataFrame, changes: DataFrame, key: str = "record_id", insert_absent: bool = False, order: str | None = None) -> DataFrame:
    """records with the non-null columns of changes put in, of several rows of a key the last by order (without one, the greatest); absent keys are ignored or inserted.

    Provenance fields that a record has are kept: a change only fills their gaps.
    """
    kept = {"parser_provider", "parser_version", "ocr_provider", "ocr_engine", "ocr_confidence", "page", "page_number", "section", "section_path", "table_id", "chunk_kind"}
    other = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*other), order) if order else F.max(F.struct(*other))
    new = changes.groupBy(key).agg(last.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(f"_{c}") for c in other])
    joined = records.join(new, key, "full_outer" if insert_absent else "left")
    return joined.select(*[F.coalesce(c, f"_{c}") if c in kept and c in other else F.coalesce(f"_{c}", c).alias(c) if c in other else F.col(c) for c in records.columns]).toDF(*records.columns)


def delete_by_filter(records: DataFrame, raw: Mapping | None) -> tuple[DataFrame, DataFrame]:
    """The records after soft deletion, and (deleted) how many matched; an empty filter matches all."""
    hit = filters.predicate(raw)
    return soft_delete(records, hit), records.agg(F.count_if(hit).alias("deleted"))


def count(records: DataFrame, raw: Mapping | None = None, compat: bool = False) -> DataFrame:
    """(n): without a filter the rows that aren't deleted, with one those that match; compat: at most 100 of the latter, as a client's list call has it."""
    if not raw:
        return records.agg(F.count_if(F.coalesce(F.col("lifecycle_state") != "deleted", F.lit(True))).alias("n"))
    n = F.count_if(filters.predicate(raw))
    return records.agg((F.least(n, F.lit(100)) if compat else n).alias("n"))


def expires_at(created_at: Column, ttl_days: Column) -> Column:
    t = F.when(created_at.rlike(r"(Z|[+-]\d{2}:\d{2})\z"), created_at).otherwise(F.concat(created_at, F.lit("Z"))).try_cast("timestamp")
    days = ttl_days.try_cast("int")
    return t + F.make_dt_interval(days=F.when(days.isNotNull(), F.greatest(days, F.lit(0))))


def ttl_expired(created_at: Column, ttl_days: Column, now: str) -> Column:
    """The time to live is over at now; without one, or with a bad date, never. Dates without zone are UTC."""
    return F.coalesce(F.lit(now).cast("timestamp") >= expires_at(created_at, ttl_days), F.lit(False))


def purge_safe(state: Column, is_latest: Column) -> Column:
    return F.coalesce(F.lower(strip(state)).isin("deleted", "superseded", "archived"), F.lit(False)) & is_latest.eqNullSafe(F.lit(False))


def should_purge(created_epoch: Column, now_epoch: Column, days: Column) -> Column:
    return now_epoch - created_epoch > F.greatest(days, F.lit(0)) * 86_400


def purge_candidates(records: DataFrame, retention_days: int, now: str) -> DataFrame:
    """Records whose own time to live, or else the general one, is over, in any state."""
    return records.where(ttl_expired(F.col("created_at"), F.coalesce("ttl_days", F.lit(retention_days)), now))


def in_order(records: DataFrame, *by: str) -> DataFrame:
    """Adds seq, the place in insertion order, by partitions that follow each other; no task sees more than its own rows."""
    sorted_rows = records.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    counts = sorted_rows.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_before")
    return sorted_rows.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(before), "_p").withColumn("seq", F.coalesce("_before", F.lit(0)) + F.expr("_id & 8589934591")).drop("_id", "_p", "_before")


def verified_ids(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, verified): whether a group's ids are all there and no two are equal; a group of any size costs one row a task and distinct id."""
    per = rows.groupBy(key, id_col).agg(F.count("*").alias("_n"))
    bad = (F.col("_n") > 1) | empty(F.col(id_col))
    return per.groupBy(key).agg((F.count_if(bad) == 0).alias("verified"))


def capped(n: Column, most: int) -> Column:
    """A count as a store reports it that can't count beyond its search limit."""
    return F.least(n, F.lit(most).cast("bigint"))
