"""Documents into records: parsed, rendered, decided upon, cut into chunks, described, written."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from ..shared import table
from ..sources import acquire
from .store import Client

#: What a layout service is asked for at each quality.
PRESETS = {
    "fast": {"parse_backend": "pipeline", "parse_method": "txt", "formula_enable": False, "table_enable": False, "return_middle_json": False, "return_images": False},
    "balanced": {"parse_backend": "pipeline", "parse_method": "auto", "formula_enable": False, "table_enable": False, "return_middle_json": False, "return_images": False},
    "best": {"parse_backend": "hybrid-auto-engine", "parse_method": "auto", "formula_enable": True, "table_enable": True},
}
PRESET_PARSER = "mineru"
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>,page:int,locator:string>>"


@dataclass(frozen=True)
class Options:
    """How documents are ingested."""

    parser_chain: Sequence[str] = (acquire.INTERNAL,)
    parser_options: Mapping[str, Mapping] = field(default_factory=dict)
    quality: str = ""
    ocr_enabled: bool | None = None
    page_fallback_target_chars: int | None = None
    page_fallback_max_pages: int | None = None
    parser_provider: str = ""
    ocr_mode: str = "disabled"
    ocr_provider: str = ""
    ocr_min_chars: int = 200
    ocr_min_scanned_ratio: float = 0.5
    table_policy: str = "table_as_markdown"
    table_json_shape: str = "records"
    chunk_unit: str = "characters"
    chunk_size: int = 800


def effective_chain(o: Options) -> list[str]:
    """The parsers in order: a preferred one comes first and the internal one last."""
    chain, first = list(o.parser_chain) or [acquire.INTERNAL], o.parser_provider.strip()
    if not first:
        return chain
    rest = [p for p in chain if p != first]
    return [first, *rest, *([acquire.INTERNAL] if acquire.INTERNAL not in (first, *rest) else [])]


def effective_options(o: Options, chain: Sequence[str]) -> dict[str, dict]:
    """Each parser's options: explicit ones count before those of the quality, recognition and page settings before both."""
    out = {k: dict(v) for k, v in o.parser_options.items()}
    for p in chain:
        if p == acquire.INTERNAL:
            continue
        own = out.setdefault(p, {})
        if p == PRESET_PARSER:
            own |= {k: v for k, v in PRESETS.get(o.quality.strip().lower(), {}).items() if k not in own}
            settings = {
                "parse_method": None if o.ocr_enabled is None else "ocr" if o.ocr_enabled else "txt",
                "page_fallback_target_chars": None if o.page_fallback_target_chars is None else max(o.page_fallback_target_chars, 0),
                "page_fallback_max_pages": None if o.page_fallback_max_pages is None else max(o.page_fallback_max_pages, 1),
            }
            own |= {k: v for k, v in settings.items() if v is not None}
    return out


def rendered(blocks: Column, tables: Column, policy: str = "table_as_markdown", shape: str = "records") -> Column:
    """A document's text followed by its tables, each in the form of the policy, with blank lines between."""
    body = text.strip(text.full_text(blocks))
    shown = F.transform(F.coalesce(tables, F.array().cast(TABLES)), lambda t: text.render_table(t, policy, shape))
    return text.strip(F.array_join(F.filter(F.concat(F.array(body), shown), lambda x: F.coalesce(text.strip(x) != "", F.lit(False))), "\n\n"))


def named(docs: DataFrame) -> DataFrame:
    """docs (source_uri, filename, data) with filename and mime_type settled: a nameless document takes its address's name, a nameless address the file's."""
    uri = F.coalesce(F.nullif("source_uri", F.lit("")), F.concat(F.lit("file://"), "filename"))
    from_uri = identity.filename(uri)
    name = F.when(F.col("filename").isin("document.bin", "inline.txt") & (from_uri != ""), from_uri).otherwise(F.col("filename"))
    return docs.withColumns({"source_uri": uri, "filename": name, "mime_type": F.coalesce(identity.media_type(name), identity.media_type(from_uri))})


def chunk_records(irs: DataFrame, o: Options, now: str, prefix: Column | None = None, chunker: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records of parsed documents (source_uri, parser_provider, parser_version, text_blocks, table_blocks, quality and any others, which are kept):
    (record_id, content, chunk_id and the metadata), ids numbered behind the prefix within each document."""
    policy = o.table_policy.strip().lower()
    policy = policy if policy in text.TABLE_POLICIES else "table_as_markdown"
    docs = irs.withColumn("_text", rendered(F.col("text_blocks"), F.col("table_blocks"), policy, o.table_json_shape))
    ratio = F.coalesce(F.try_element_at("quality", F.lit("scanned_ratio")), F.lit(0.0))
    ocr = text.ocr_decision(o.ocr_mode, F.char_length("_text"), ratio, o.ocr_provider, o.ocr_min_chars, o.ocr_min_scanned_ratio)
    cut = text.clean(chunker(F.col("_text")) if chunker else text.chunk_recursive(F.col("_text"), max(o.chunk_size, 32)))
    kept = [c for c in irs.columns if c not in ("text_blocks", "table_blocks", "quality")]
    rows = docs.select(*kept, ocr.alias("_ocr"), F.posexplode(cut).alias("_i", "content"))
    default = {"tenant_id": F.lit("default"), "source_type": identity.source_type(F.col("source_uri")), "lifecycle_state": F.lit("active"), "created_at": F.lit(now)}
    extra = {c: F.coalesce(F.col(c), v) if c in kept else v for c, v in default.items()}
    more = {"ocr_mode": F.col("_ocr.mode"), "ocr_applied": F.col("_ocr.enabled"), "ocr_reason": F.col("_ocr.reason"), "table_policy": F.lit(policy), "table_json_shape": F.lit(o.table_json_shape), "chunk_unit": F.lit(o.chunk_unit)}
    number = F.col("_i").cast("string")
    ids = {"record_id": F.concat(prefix if prefix is not None else F.lit("r"), F.lit("-"), number), "chunk_id": number}
    return rows.withColumns({**extra, **more, **ids}).drop("_ocr", "_i")


def ingest_documents(client: Client, collection: str, docs: DataFrame, o: Options | None = None, prefix: Column | None = None, registry: acquire.Registry | None = None, chunker: Callable[[Column], Column] | None = None, on_checkpoint: Callable[[str, int], None] | None = None) -> DataFrame:
    """Ingests documents (source_uri, filename, data and any metadata columns) and returns the ids written. RuntimeError if no parser takes some document.

    on_checkpoint hears of each stage (acquire, parse, chunk, upsert) when it begins, with 0, and when it ends, with the number of documents, chunks or records.
    """
    o, tell = o or Options(), on_checkpoint or (lambda stage, n: None)
    tell("acquire", 0)
    acquired = table(named(docs), "acquired")
    n = acquired.count()
    tell("acquire", n)
    tell("parse", 0)
    parsed = table(acquire.parse(acquired, effective_chain(o), registry), "parsed")
    failed = parsed.where("error IS NOT NULL").select("error").limit(1).collect()
    if failed:
        raise RuntimeError(failed[0].error)
    tell("parse", n)
    blocks = F.transform("blocks", lambda t: F.struct(t.alias("text"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("page"), F.array().cast("array<string>").alias("section_path")))
    irs = parsed.select(*[c for c in acquired.columns if c != "data"], F.col("provider_id").alias("parser_provider"), F.col("provider_version").alias("parser_version"), blocks.alias("text_blocks"), F.lit(None).cast(TABLES).alias("table_blocks"), F.lit(None).cast("map<string,double>").alias("quality"))
    tell("chunk", 0)
    rows = table(chunk_records(irs, o, client.now, prefix, chunker), "chunks")
    tell("chunk", rows.count())
    tell("upsert", 0)
    ids = client.upsert_records(collection, rows)
    tell("upsert", ids.count())
    return ids


def text_records(texts: DataFrame, collection: str, chunker: Callable[[Column], Column], converter: Callable[[Column], Column], now: str, prefix: Column | None = None) -> DataFrame:
    """Records of plain texts (text): converted and cut, the chunks as they are, blank ones too."""
    p = prefix if prefix is not None else F.lit("r")
    rows = texts.select(p.alias("_p"), F.posexplode(chunker(converter(F.col("text")))).alias("_i", "content"))
    i = F.col("_i").cast("string")
    return rows.select(
        F.concat("_p", F.lit("-"), i).alias("record_id"), "content", F.lit("default").alias("tenant_id"), F.concat(F.lit(f"ingestion://{collection}/"), "_p", F.lit("/"), i).alias("source_uri"),
        F.lit("other").alias("source_type"), F.lit("active").alias("lifecycle_state"), F.lit(now).alias("created_at"),
    )


def ingest_text(client: Client, collection: str, texts: DataFrame, chunker: Callable[[Column], Column], converter: Callable[[Column], Column], prefix: Column | None = None) -> DataFrame:
    return client.upsert_records(collection, text_records(texts, collection, chunker, converter, client.now, prefix))
