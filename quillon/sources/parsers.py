"""What parser services take and return, as column expressions: input gates, answers, errors, page by page results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: What a layout parser accepts, and words in the messages of services.
ACCEPTED_TYPES = ("application/pdf", "application/x-pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html", "application/xhtml+xml")
ACCEPTED_EXTENSIONS = ("pdf", "doc", "docx", "html", "htm")
OUT_OF_MEMORY = ("out of memory",)
TIMED_OUT = ("readtimeout", "connecttimeout", "timed out")
BUSY = (
    "worker busy", "provider busy", "too many requests", "queue wait exceeded", "http 429", "http 503", "readerror", "connecterror", "connecttimeout",
    "readtimeout", "pooltimeout", "remoteprotocolerror", "service unavailable", "connection reset", "connection refused",
)


def accepts(filename: Column, mime_type: Column) -> Column:
    """By media type if it is telling, else by extension; a file without either is tried."""
    mime = F.split(F.lower(strip(F.coalesce(mime_type, F.lit("")))), ";")[0]
    ext = F.regexp_extract(F.lower(strip(F.coalesce(filename, F.lit("")))), r"\.([^.]+)$", 1)
    return F.when(mime.isin(*ACCEPTED_TYPES), True).when(mime.startswith("text/"), False).when(ext != "", ext.isin(*ACCEPTED_EXTENSIONS)).otherwise(True)


def image_type(ref: Column) -> Column:
    r = F.lower(strip(ref))
    return F.when(r.endswith(".png"), "image/png").when(r.endswith(".webp"), "image/webp").when(r.endswith(".gif"), "image/gif").otherwise("image/jpeg")


def image_refs(images: Column) -> Column:
    """Of a map from reference to Base64 text, with or without a data: prefix, the valid ones as (ref, encoding, mime_type, data_base64, byte_size)."""
    bare = F.transform(F.map_entries(images), lambda e: F.struct(e["key"].alias("key"), F.regexp_replace(e["value"], r"\Adata:[^,]*,", "").alias("value")))
    valid = F.filter(bare, lambda e: F.coalesce((strip(e["key"]) != "") & (strip(e["value"]) != "") & e["value"].rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(e["value"]) % 4 == 0), F.lit(False)))
    return F.transform(valid, lambda e: F.struct(e["key"].alias("ref"), F.lit("base64").alias("encoding"), image_type(e["key"]).alias("mime_type"), e["value"].alias("data_base64"), F.octet_length(F.unbase64(e["value"])).cast("bigint").alias("byte_size")))


def answer_images(payload: Column) -> Column:
    """image_refs() of a service's answer (JSON): `images` at the top if it is an object, else below `result`."""
    top, below = F.get_json_object(payload, "$.images"), F.get_json_object(payload, "$.result.images")
    found = F.when(F.ltrim(top).startswith("{"), top).otherwise(below)
    return image_refs(F.coalesce(F.from_json(found, "map<string,string>"), F.create_map().cast("map<string,string>")))


def toc_blocks(payload: Column) -> Column:
    """Headings of a service's answer (JSON), from metadata.table_of_contents, or where metadata is no object from result.metadata.table_of_contents: as many # as their level, 1 to 6."""
    kind = "array<struct<title:string,level:string,page_id:string>>"
    top = F.coalesce(F.ltrim(F.get_json_object(payload, "$.metadata")).startswith("{"), F.lit(False))
    toc = F.when(top, F.get_json_object(payload, "$.metadata.table_of_contents")).otherwise(F.get_json_object(payload, "$.result.metadata.table_of_contents"))
    entries = F.filter(F.coalesce(F.from_json(toc, kind), F.array().cast(kind)), lambda e: F.coalesce(strip(e["title"]) != "", F.lit(False)))

    def block(e: Column) -> Column:
        level = F.coalesce(F.nullif(e["level"].try_cast("int"), F.lit(0)), F.lit(1))
        title = strip(e["title"])
        text = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(level, F.lit(6)))), F.lit(" "), title)
        return F.struct(text.alias("text"), F.lit("heading").alias("kind"), e["page_id"].try_cast("int").alias("page"), F.array(title).alias("section_path"))

    return F.transform(entries, block)


def answer_text(payload: Column, keys: tuple[str, ...] = ("output", "markdown", "text", "content")) -> Column:
    """The first non-blank of the keys, at the top, then below `result`."""
    paths = [f"$.{k}" for k in keys] + [f"$.result.{k}" for k in keys]
    return F.coalesce(*[F.when(strip(F.get_json_object(payload, p)) != "", F.get_json_object(payload, p)) for p in paths], F.lit(""))


def job_id(payload: Column) -> Column:
    """job_id, request_id or id of a submission's answer, at the top, then below `result`; null if there is none."""
    paths = [f"{at}.{k}" for at in ("$", "$.result") for k in ("job_id", "request_id", "id")]
    return F.coalesce(*[F.when(strip(F.get_json_object(payload, p)) != "", F.get_json_object(payload, p)) for p in paths])


def _any(message: Column, words: tuple[str, ...]) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | m.contains(w)
    return out


def error_kind(message: Column) -> Column:
    """What went wrong at a service: memory, not_found, timeout, busy or other; null without a message."""
    m = F.lower(message)
    missing = F.concat(F.lit(" "), m, F.lit(" ")).contains(" 404 ") | m.contains("404 page not found")
    return F.when(message.isNull(), None).when(_any(message, OUT_OF_MEMORY), "memory").when(missing, "not_found").when(_any(message, TIMED_OUT), "timeout").when(_any(message, BUSY), "busy").otherwise("other")


def goes_async(size_bytes: Column, threshold_s: float, bytes_per_s: float = 250_000.0, explicit: bool | None = None) -> Column:
    """Whether a document is parsed asynchronously: as told, else when the estimated time exceeds the threshold."""
    return F.lit(explicit) if explicit is not None else size_bytes / max(bytes_per_s, 1.0) > threshold_s


def pages_until(pages: DataFrame, target_chars: int, max_pages: int = 1_000_000) -> DataFrame:
    """Pages (doc, page, text) up to the one at which a document's text reaches target_chars."""
    w = Window.partitionBy("doc").orderBy("page")
    before = F.coalesce(F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_before", before).withColumn("_n", F.row_number().over(w)).where((F.col("_before") < target_chars) & (F.col("_n") <= max_pages)).drop("_before", "_n")


def layout_text(payload: Column) -> Column:
    """Text of a layout service's answer: text or markdown even if blank, the first result's contents, else content or output."""
    at = lambda p: F.get_json_object(payload, p)
    filled = lambda c: F.when(strip(c) != "", c)
    first = F.try_element_at(F.map_values(F.from_json(F.when(F.ltrim(at("$.results")).startswith("{"), at("$.results")), "map<string,string>")), F.lit(1))
    below = [filled(F.get_json_object(first, f"$.{k}")) for k in ("md_content", "markdown", "text", "content")]
    return F.coalesce(at("$.text"), at("$.markdown"), *below, filled(at("$.content")), filled(at("$.output")), F.lit(""))


def health_state(payload: Column) -> Column:
    """busy or ready, by a service's word, by what waits, or when all its workers are taken and no queue has room."""
    n = lambda k: F.greatest(F.coalesce(F.get_json_object(payload, f"$.{k}").try_cast("int"), F.lit(0)), F.lit(0))
    word = F.coalesce(F.lower(strip(F.get_json_object(payload, "$.status"))), F.lit(""))
    room = (n("queue_max") > 0) & (n("waiting") < n("queue_max"))
    busy = word.isin("overloaded", "degraded_busy") | (n("waiting") > 0) | ((n("max_concurrent") > 0) & (n("inflight") >= n("max_concurrent")) & ~room)
    return F.when(busy, "busy").otherwise("ready")


def probe_busy(payload: Column) -> Column:
    """Whether a service that answered its probe is busy, by its flag or its word."""
    flag = F.lower(strip(F.coalesce(F.get_json_object(payload, "$.busy"), F.lit("")))).isin("1", "true", "yes", "on", "busy")
    return flag | F.coalesce(F.lower(strip(F.get_json_object(payload, "$.status"))).isin("busy", "degraded_busy", "overloaded"), F.lit(False))


def envelope(body: Column) -> Column:
    """The JSON of an answer that may be a stream of events: its last data line that is JSON, else the whole body if that is, else {}."""
    lines = F.transform(F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: strip(x).startswith("data:")), lambda x: strip(F.substring(strip(x), F.lit(6), F.char_length(x))))
    good = F.filter(lines, lambda x: (x != "") & (x != "[DONE]") & F.try_parse_json(x).isNotNull())
    plain = F.when(F.try_parse_json(body).isNotNull(), body)
    return F.when(F.ltrim(body).startswith("{"), F.coalesce(plain, F.lit("{}"))).otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), plain, F.lit("{}")))


def form_options(options: dict) -> dict[str, str]:
    """What a layout parser's form takes: format, pagination (on by default) and a page range if there is one."""
    paginate = options.get("paginate_output")
    on = True if paginate is None else str(paginate).strip().lower() in ("1", "true", "yes", "on")
    out = {"output_format": str(options.get("output_format") or "markdown"), "paginate_output": "true" if on else "false"}
    pages = str(options.get("page_range") or "").strip()
    return out | ({"page_range": str(options["page_range"])} if pages else {})


def service_url(base: str, value: str) -> str:
    """An absolute address as it is, a path below the base; nothing for nothing."""
    v = value.strip()
    return v if not v or v.startswith(("http://", "https://")) else f"{base}/{v.removeprefix('/')}"


#: Options that a layout service takes, and what spares memory.
REQUEST_KEYS = ("output_dir", "lang_list", "formula_enable", "table_enable", "server_url", "return_md", "return_middle_json", "return_model_output", "return_content_list", "return_images", "response_format_zip", "start_page_id", "end_page_id")
SPARE = {"formula_enable": False, "table_enable": False, "return_middle_json": False, "return_images": False}
VARIANTS = (("pipeline", "auto"), ("pipeline", "ocr"), ("vlm-auto-engine", "auto"), ("hybrid-auto-engine", "auto"))


def requests(backend: str, method: str, options: dict) -> list[dict]:
    """Requests to try in order: as asked, then sparing memory, then by other backends; none twice."""
    first = {"backend": backend, "parse_method": method} | {k: options[k] for k in REQUEST_KEYS if options.get(k) is not None}
    spare = first | SPARE
    out: list[dict] = []
    for r in (first, spare, *(spare | {"backend": b, "parse_method": m} for b, m in VARIANTS)):
        if r not in out:
            out.append(r)
    return out


def pages_apply(filename: Column, mime_type: Column) -> Column:
    """Whether a document can be parsed page by page."""
    return F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)) | F.coalesce(strip(F.lower(mime_type)) == "application/pdf", F.lit(False))
