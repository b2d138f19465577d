"""Filters, vectors, metadata and rows as several stores write them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

#: Metadata that one store keeps in columns of their own.
STATIC_COLUMNS = ("tenant_id", "source_uri", "source_type", "lifecycle_state", "created_at", "doc_id", "chunk_id", "content_hash", "embedding_model", "chunker_version", "is_latest")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def json_contains(document: Column, asked: Mapping) -> Column:
    """Containment of a JSON document: every key of `asked` is there with a value that contains the one asked for; of arrays each element asked for is in some
    element; numbers are equal as numbers, all else only to its own type. False for a null or broken document."""

    def inside(v: Column, want: object) -> Column:
        kind = F.schema_of_variant(v)
        if isinstance(want, Mapping):
            return kind.startswith("OBJECT") & _all([inside(F.try_variant_get(v, f"$['{k}']", "variant"), x) for k, x in want.items()])
        if isinstance(want, (list, tuple)):
            items = F.try_variant_get(v, "$", "array<variant>")
            some = lambda x: F.exists(items, lambda e: F.coalesce(inside(e, x), F.lit(False)))
            return kind.startswith("ARRAY") & _all([some(x) for x in want])
        if want is None:
            return kind == "VOID"
        if isinstance(want, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(want))
        if isinstance(want, (int, float)):
            return (kind.startswith("BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(v, "$", "double") == F.lit(float(want)))
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(want)))

    return F.coalesce(inside(F.try_parse_json(document), dict(asked)), F.lit(False))


def where_clause(asked: Mapping) -> dict:
    """One condition as it is, several joined by $and."""
    return dict(asked) if len(asked) <= 1 else {"$and": [{k: v} for k, v in asked.items()]}


def must_clause(asked: Mapping) -> dict:
    return {"must": [{"key": f"metadata.{k}", "match": {"value": v}} for k, v in asked.items()]} if asked else {}


def term_clauses(asked: Mapping) -> list[dict]:
    return [{"term": {f"metadata.{k}": v}} for k, v in asked.items()]


def of_clause(clause: Mapping | list, field=F.col) -> Column:
    """The condition that a where, must or term clause stands for."""
    if isinstance(clause, list):
        pairs = [(k.removeprefix("metadata."), v) for c in clause for k, v in c["term"].items()]
    elif "must" in clause:
        pairs = [(c["key"].removeprefix("metadata."), c["match"]["value"]) for c in clause["must"]]
    else:
        pairs = [kv for c in clause.get("$and", [clause]) for kv in c.items()]
    return _all([filters.equals(field(k), v) for k, v in pairs])


def expression(asked: Mapping | None) -> str:
    """SQL condition over static columns and record_id (also named id); other keys are left out, and without any it is always true."""

    def literal(v: object) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    names = [("record_id" if k == "id" else k, v) for k, v in (asked or {}).items()]
    return " and ".join(f"{k} = {literal(v)}" for k, v in names if k in STATIC_COLUMNS or k == "record_id") or "record_id = record_id"


def vector_literal(v: Column) -> Column:
    """A vector as text with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def metadata_object(text: Column) -> Column:
    """JSON text if it is an object, else {}."""
    return F.coalesce(F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text), F.lit("{}"))


def flat_value(c: Column, kind: str) -> Column:
    """A metadata value as text for stores that take scalars alone: null is empty, containers are JSON."""
    return F.coalesce(F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string"), F.lit(""))


def static_row(rows: DataFrame, metadata: Column) -> DataFrame:
    """(record_id, content, metadata_json, the static columns as text) of rows (record_id, content) with metadata as a map: a missing value is empty text."""
    m = F.map_concat(F.map_filter(metadata, lambda k, _: k != "record_id"), F.create_map(F.lit("record_id"), F.coalesce(F.try_element_at(metadata, F.lit("record_id")), F.col("record_id"))))
    ordered = F.map_from_entries(F.sort_array(F.map_entries(m)))
    return rows.select("record_id", "content", F.to_json(ordered).alias("metadata_json"), *[F.coalesce(F.try_element_at(metadata, F.lit(c)), F.lit("")).alias(c) for c in STATIC_COLUMNS])


def output_rows(output: Column) -> Column:
    """Rows (array of maps) of an answer that lists objects, or lists of objects to be merged, the later ones counting."""
    one = "map<string,string>"
    none = F.array().cast(f"array<{one}>")

    def merged(parts: Column) -> Column:
        return F.aggregate(parts, F.create_map().cast(one), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m))

    def row(item: Column) -> Column:
        many = F.when(F.ltrim(item).startswith("["), F.filter(F.from_json(item, "array<string>"), lambda x: F.ltrim(x).startswith("{")))
        return F.when(many.isNotNull(), merged(F.transform(many, lambda x: F.from_json(x, one)))).when(F.ltrim(item).startswith("{"), F.from_json(item, one))

    items = F.from_json(F.when(F.ltrim(output).startswith("["), output), "array<string>")
    return F.coalesce(F.filter(F.transform(items, row), lambda m: m.isNotNull()), none)


def row_metadata(row: Column, known: Column) -> Column:
    """A row's metadata_json if that is an object, else what is known of it, else {}."""
    text = F.try_element_at(row, F.lit("metadata_json"))
    return F.coalesce(F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text), known, F.lit("{}"))


def metric_name(metric: str) -> str:
    """A metric's name with a capital, as one store has it."""
    return metric.capitalize()


def space_score(distance: Column) -> Column:
    """Score of a distance: its complement to 1; a missing distance counts as 1."""
    return F.lit(1.0) - F.coalesce(distance, F.lit(1.0))


def bulk_lines(rows: DataFrame, index: str, id_col: str = "id") -> DataFrame:
    """(line): for each row the action and the document of a bulk request, as newline-delimited JSON; to be written per partition."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).alias("_id")).alias("index")))
    return rows.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*[c for c in rows.columns if c != id_col])), F.lit("\n")).alias("line"))
