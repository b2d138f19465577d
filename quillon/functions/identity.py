"""Deterministic identities: hashes, addresses, names, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Media types by file extension.
MEDIA_TYPES = {
    "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "text/xml",
    "doc": "application/msword", "odt": "application/vnd.oasis.opendocument.text", "rtf": "application/rtf", "svg": "image/svg+xml", "tar": "application/x-tar", "tif": "image/tiff", "tiff": "image/tiff",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "zip": "application/zip",
}
_URI = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def content_hash(text: Column) -> Column:
    return F.sha2(strip(text).cast("binary"), 256)


def source_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def normalise_uri(uri: Column) -> Column:
    """Scheme and host in lower case, no slashes at the path's end, no fragment; other addresses only lose slashes at their end."""
    u = strip(uri)
    g = [F.coalesce(F.regexp_extract(u, "(?s)" + _URI, i), F.lit("")) for i in range(1, 5)]
    return F.when(u.rlike("(?s)" + _URI), F.concat(F.lower(g[0]), F.lit("://"), F.lower(g[1]), F.regexp_replace(g[2], r"/+\z", ""), g[3])).otherwise(F.regexp_replace(u, r"/+\z", ""))


def doc_id(uri: Column, hash_: Column) -> Column:
    return F.sha2(F.concat(normalise_uri(uri), F.lit("|"), F.lower(strip(hash_))).cast("binary"), 256)


def record_id(doc: Column, chunk_index: Column, *legacy: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc, chunk_index.cast("string"), *legacy).cast("binary"), 256)


def source_type(uri: Column) -> Column:
    u = F.lower(uri)
    return F.when(u.startswith("http://") | u.startswith("https://"), "web").when(u.startswith("file://"), "file").when(u.startswith("api://"), "api").otherwise("other")


def filename(uri: Column) -> Column:
    """Last part of the address's path, percent-decoded; empty if there is none."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"^//[^/?#]*", ""), r"[?#].*$", "")
    name = F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def media_type(name: Column) -> Column:
    """Media type by a file name's extension; null for others."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext)


def class_name(name: Column, default: str = "Collection") -> Column:
    """Words of a collection's name, each with a capital, as one word."""
    words = F.filter(F.split(name, "[-_]"), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))), "")
    return F.when(made == "", default).otherwise(made)


def namespace_key(tenant: Column, base: Column) -> Column:
    t, b = strip(tenant), strip(F.coalesce(base, F.lit("")))
    return F.when(b != "", F.concat(b, F.lit(":"), t)).otherwise(t)


def spec_key(namespace: Column, name: Column) -> Column:
    return F.when(F.coalesce(namespace, F.lit("")) != "", F.concat(namespace, F.lit(":"), name)).otherwise(name)


def is_identifier(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")


def schema_signature(dim: Column, fields: Column, model: Column) -> Column:
    return F.sha2(F.concat(dim.cast("string"), F.lit("|"), F.array_join(F.sort_array(fields), ","), F.lit("|"), model).cast("binary"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) in a namespace given as UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    nibble = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))
