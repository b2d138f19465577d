"""Types of the data model. Filterable fields stand at the top level of stored records, so that Parquet can filter by them."""

from __future__ import annotations

#: Canonical metadata fields in order, with their types.
METADATA = (
    "doc_id string, record_id string, chunk_id string, chunk_index int, supersedes string, is_latest boolean, tenant_id string, namespace string, source_uri string, source_type string, "
    "filename string, mime_type string, size_bytes bigint, content_hash string, source_hash string, created_at string, ingested_at string, lifecycle_state string, ttl_days int, app_id string, "
    "user_id string, session_id string, profile string, collection string, embedding_model string, embedding_dim int, chunker string, chunker_version string, token_count int, "
    "access_tags array<string>, pii_present boolean, parser_name string, parser_version string, parser_provider string, ocr_provider string, ocr_engine string, ocr_applied boolean, "
    "ocr_confidence double, page int, page_number int, page_range string, section string, section_path string, table_id string, table_title string, chunk_kind string, extras map<string,string>"
)
RECORD = f"record_id string, content string, metadata struct<{', '.join(f.replace(' ', ':', 1) for f in METADATA.split(', '))}>, lifecycle_state string"
#: What metadata must have, and the values some of it may take.
SOURCE_TYPES = ("web", "file", "api", "database", "other")
LIFECYCLE_STATES = ("active", "deleted", "superseded", "archived")
REQUIRED = ("doc_id", "source_uri", "lifecycle_state", "created_at")


class StoreError(Exception):
    """Any failure of this library's own."""


class ConfigError(StoreError):
    """A setting is missing or wrong."""


class InvalidRequestError(StoreError):
    """Arguments that no store could serve."""


class BackendUnavailableError(StoreError):
    """A remote service doesn't answer."""


class ParserTimeoutError(StoreError):
    """A parser took longer than it may."""
