"""Metadata filters: equality on known fields and containment of access tags."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fields that filters may name.
SCALAR_FIELDS = ("tenant_id", "namespace", "app_id", "user_id", "session_id", "doc_id", "source_uri", "lifecycle_state", "is_latest", "profile")
_EMPTY = ("", None, [], (), {})


def coerce(raw: Mapping | None) -> dict:
    """Known fields with a value, and access_tags as a tuple; other keys are dropped."""
    raw = raw or {}
    out = {k: raw[k] for k in SCALAR_FIELDS if k in raw and not any(raw[k] is e or (raw[k] == e and type(raw[k]) is type(e)) for e in _EMPTY)}
    tags = raw.get("access_tags")
    tags = [tags] if isinstance(tags, str) else tags or ()
    if kept := tuple(t.strip() for t in map(str, tags) if t.strip()):
        out["access_tags"] = kept
    return out


def pushed(raw: Mapping | None) -> dict:
    """The part of a filter that stores evaluate: scalars without tags."""
    return {k: v for k, v in coerce(raw).items() if k != "access_tags"}


def equals(c: Column, value: object) -> Column:
    return F.coalesce(c == F.lit(value), F.lit(False))


def has_tags(tags: Column, asked: tuple[str, ...]) -> Column:
    """All tags asked for are among the stripped tags."""
    have = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip), lambda t: t != "")
    return F.size(F.array_except(F.array(*map(F.lit, asked)), have)) == 0


def predicate(raw: Mapping | None, field=F.col) -> Column:
    """Conjunction of a filter's conditions; a missing value satisfies none. field(name) gives a field's column."""
    f = coerce(raw)
    conditions = [has_tags(field(k), v) if k == "access_tags" else equals(field(k), v) for k, v in f.items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_key(filters: Mapping | None, field=F.col) -> Column:
    """Equality on any key, as a store's own filter has it."""
    return reduce(lambda a, b: a & b, [equals(field(k), v) for k, v in (filters or {}).items()], F.lit(True))


def tenant_only(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    return df.where(equals(F.col(column), tenant))


def may(role: Column | str, action: str, policy: Column) -> Column:
    """Whether a role may read, write or administer: administrators may write, writers may read."""
    r = F.lit(role) if isinstance(role, str) else role
    levels = {"admin": ("admins",), "write": ("writers", "admins"), "read": ("readers", "writers", "admins")}[action]
    return reduce(lambda a, b: a | b, [F.coalesce(F.array_contains(policy[x], r), F.lit(False)) for x in levels])
