"""Collections, their schema versions, jobs, metrics and provider comparison."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..schemas import ConfigError


def check_spec(name: str | None, dim: int) -> None:
    if not (name or "").strip() or dim <= 0:
        raise ConfigError("a collection needs a name and a positive dimension")


def create(catalog: DataFrame, spec: DataFrame) -> DataFrame:
    """catalog with the collections of spec; one that exists is replaced."""
    return catalog.join(spec.select("name"), "name", "left_anti").unionByName(spec)


def listed(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("name")


def _without(m: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def patched(catalog: DataFrame, name: str, namespace: str | None = None, dim: int | None = None, **maps: dict[str, str]) -> DataFrame:
    """catalog with one collection changed: maps (metadata, metadata_schema, index_params, access_policy) are merged, the metric stays."""
    hit = F.col("name") == name
    out = catalog
    for c, v in (("namespace", namespace), ("embedding_dim", dim)):
        if v is not None:
            out = out.withColumn(c, F.when(hit, F.lit(v)).otherwise(F.col(c)))
    for c, entries in maps.items():
        new = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
        keep = _without(F.coalesce(c, F.create_map().cast("map<string,string>")), tuple(entries))
        out = out.withColumn(c, F.when(hit, F.map_concat(keep, new)).otherwise(F.col(c)))
    return out


def dropped(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") != name)


def versions(registrations: DataFrame) -> DataFrame:
    """Adds signature and version to (collection, seq, dim, fields, model): a version begins where a collection's signature changes."""
    w = Window.partitionBy("collection").orderBy("seq")
    s = registrations.withColumn("signature", identity.schema_signature(F.col("dim"), F.col("fields"), F.col("model")))
    changed = (~F.lag("signature").over(w).eqNullSafe(F.col("signature"))).cast("int")
    return s.withColumn("changed", changed).withColumn("version", F.sum("changed").over(w)).drop("changed")


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """By collection what changes from the old (collection, dim, fields, model) to the new, and whether vectors must be made again."""
    j = old.alias("o").join(new.alias("n"), "collection")
    dim, model = ~F.col("o.dim").eqNullSafe(F.col("n.dim")), ~F.col("o.model").eqNullSafe(F.col("n.model"))
    return j.select(
        "collection", dim.alias("dimension_changed"), model.alias("model_changed"), (~F.sort_array("o.fields").eqNullSafe(F.sort_array("n.fields"))).alias("fields_changed"), (dim | model).alias("re_embed")
    )


@dataclass(frozen=True)
class Version:
    """A collection's schema as registered."""

    collection: str
    version: int
    dim: int
    fields: tuple[str, ...]
    model: str
    signature: str


class Versions:
    """Schema versions of collections, configuration that the driver holds. A collection that is dropped keeps its versions."""

    def __init__(self) -> None:
        self.of: dict[str, Version] = {}

    def register(self, collection: str, dim: int, fields: Iterable[str], model: str) -> Version:
        """The present version, or the next one if the signature changes."""
        names = tuple(sorted(fields))
        signature = hashlib.sha256(f"{dim}|{','.join(names)}|{model}".encode()).hexdigest()
        now = self.of.get(collection)
        if now is None or now.signature != signature:
            now = self.of[collection] = Version(collection, now.version + 1 if now else 1, dim, names, model, signature)
        return now

    def mismatch(self, collection: str, dim: int | None = None, model: str | None = None) -> bool:
        """Whether a query expects another dimension or model than registered; warns if so. An unregistered collection never differs."""
        now = self.of.get(collection)
        pairs = [] if now is None else [("dimension", dim, now.dim), ("embedding model", model or None, now.model)]
        wrong = [f"{what} mismatch: expected {want}, actual {have}" for what, want, have in pairs if want is not None and want != have]
        if wrong:
            warnings.warn(f"Collection '{collection}' schema version mismatch: {', '.join(wrong)}", RuntimeWarning, stacklevel=3)
        return bool(wrong)

    def plan_migration(self, collection: str, dim: int, fields: Iterable[str], model: str) -> dict:
        """Registers the new version and says what changes; ValueError for a collection without any."""
        old = self.of.get(collection)
        if old is None:
            raise ValueError(f"Collection not registered: {collection}")
        new = self.register(collection, dim, fields, model)
        again = old.dim != new.dim or old.model != new.model
        return {
            "collection": collection, "from_version": old.version, "to_version": new.version, "dimension_changed": old.dim != new.dim, "metadata_changed": old.fields != new.fields,
            "embedding_model_changed": old.model != new.model, "reembed_required": again, "warning": "Re-embedding required due to dimension/model change." if again else "",
        }


def progress(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total)))


def job_status(done: Column, total: Column) -> Column:
    p = progress(done, total)
    return F.when(p >= 1, "completed").when(p > 0, "running").otherwise("queued")


#: States of jobs at rest, and words with which services say that a job failed or ended well.
TERMINAL = ("completed", "failed", "cancelled")
FAILED = ("failed", "error", "cancelled", "canceled")
ENDED = ("complete", "completed", "done", "success", "succeeded")


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def is_running(status: Column) -> Column:
    return F.coalesce(status == "running", F.lit(False))


def async_status(status: Column, completed: Column, success: Column, has_error: Column) -> Column:
    """End of a remote job by its status word, else by its flags: `failed`, `ok`, or null while it runs."""
    s, done, good = F.lower(F.trim(status)), F.coalesce(completed, F.lit(False)), F.coalesce(success, F.lit(False))
    by_word = F.when(s.isin(*FAILED), "failed").when(s.isin(*ENDED), "ok")
    return F.coalesce(by_word, F.when(done & good, "ok").when(done & ~good & has_error, "failed"))


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(~is_terminal(F.col("status"))).orderBy("seq").limit(1)


def cancelled(jobs: DataFrame, job: str) -> DataFrame:
    hit = (F.col("job_id") == job) & ~is_terminal(F.col("status"))
    return jobs.withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status")))


def submitted(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """jobs with new ones put in; one with an id that is there replaces it."""
    return jobs.join(new.select("job_id"), "job_id", "left_anti").unionByName(new)


def audited(actions: DataFrame, now: str) -> DataFrame:
    """(timestamp, action, target, actor, outcome, details) of actions (action, target[, actor, outcome, details]) with defaults: the system, success, none."""
    given = lambda c, v: F.coalesce(F.col(c), v) if c in actions.columns else v
    none = F.create_map().cast("map<string,string>")
    return actions.select(F.lit(now).alias("timestamp"), "action", "target", given("actor", F.lit("system")).alias("actor"), given("outcome", F.lit("success")).alias("outcome"), given("details", none).alias("details"))


def ids_verified(ids: Column) -> Column:
    """There are ids, none of them is null or blank, and no two are equal."""
    return F.coalesce((F.size(ids) > 0) & ~F.exists(ids, lambda i: F.coalesce(text.strip(i) == "", F.lit(True))) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def enough_ids(ids: Column, least: int) -> Column:
    return ids_verified(ids) & (F.size(ids) >= max(0, least))


def metrics(events: DataFrame) -> DataFrame:
    """(key, total, last) of counters and gauges (key, value, seq)."""
    return events.groupBy("key").agg(F.sum("value").alias("total"), F.max_by("value", "seq").alias("last"))


def comparison(cases: DataFrame) -> DataFrame:
    """By provider the number of cases, of good ones, their share, and mean time and quality of the good ones; 0 where there are none."""
    ok = F.col("status") == "ok"
    return cases.where(F.col("provider_id") != "").groupBy("provider_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), (F.count_if(ok) / F.count("*")).alias("success_ratio"),
        F.coalesce(F.avg(F.when(ok, F.coalesce("parse_time_ms", F.lit(0.0)))), F.lit(0.0)).alias("mean_parse_time_ms"), F.coalesce(F.avg(F.when(ok, F.col("quality_invariant_pass_rate"))), F.lit(0.0)).alias("quality_invariant_pass_rate"),
    )


def cases(documents: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Each document with each provider; providers are few names."""
    return documents.withColumn("provider_id", F.explode(F.array(*map(F.lit, providers))))


def counts(blocks: Column, tables: Column, artefacts: Column, most: int = 800) -> dict[str, Column]:
    """What a comparison counts in a parsed document: characters, headings, tables, images, chunks."""
    full = text.full_text(blocks)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    heading = F.filter(blocks, lambda b: F.coalesce((b["kind"] == "heading") | text.is_heading(b["text"]), F.lit(False)))
    body = text.strip(full)
    return {
        "text_chars": F.char_length(full), "heading_count": size(heading), "table_count": size(tables), "image_count": size(artefacts),
        "chunk_count": F.when(body == "", F.lit(0)).otherwise(F.size(text.clean(text.chunk_recursive(body, most)))),
    }


def providers_of(cases_: DataFrame) -> DataFrame:
    """(provider_id): the distinct ones that are not blank, in order."""
    return cases_.where("provider_id <> ''").select("provider_id").distinct().orderBy("provider_id")


#: The report's title and the heads of its two tables.
TITLE = "# Cross-Provider Comparison Report"
SUMMARY_HEAD = "| Provider | Total | OK | Success Ratio | Mean Parse Time (ms) | Quality Pass Rate |\n|---|---:|---:|---:|---:|---:|\n"
CASES_HEAD = "| Provider | Document ID | Category | Status | Mode | Text Chars | Tables | Images | Parse Time (ms) | Reason |\n|---|---|---|---|---|---:|---:|---:|---:|---|\n"


def report(cases_: DataFrame, generated_at: str, path: str, name: str) -> tuple[Path, Path]:
    """Writes a comparison's summary and cases as JSON and as Markdown, line by line from the executors' rows, and returns both files."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    summary = {r.provider_id: {k: v for k, v in r.asDict().items() if k != "provider_id"} for r in comparison(cases_).orderBy("provider_id").toLocalIterator()}
    as_json, as_text = folder / f"{name}.json", folder / f"{name}.md"
    with as_json.open("w", encoding="utf-8") as j, as_text.open("w", encoding="utf-8") as m:
        j.write(f'{{"generated_at": {json.dumps(generated_at)}, "summary": {json.dumps(summary)}, "cases": [')
        m.write(f"{TITLE}\n\n- Generated at: {generated_at}\n\n## Provider Summary\n\n{SUMMARY_HEAD}")
        for p, v in summary.items():
            m.write(f"| {p} | {v['total']} | {v['ok']} | {v['success_ratio']:.3f} | {v['mean_parse_time_ms']:.2f} | {v['quality_invariant_pass_rate']:.3f} |\n")
        m.write(f"\n## Cases\n\n{CASES_HEAD}")
        for i, r in enumerate(cases_.toLocalIterator()):
            c = r.asDict(True)
            j.write((", " if i else "") + json.dumps(c))
            g = lambda k, none="", c=c: c.get(k) if c.get(k) is not None else none
            m.write(f"| {g('provider_id')} | {g('document_id')} | {g('category')} | {g('status')} | {g('execution_mode')} | {g('text_chars', 0)} | {g('table_count', 0)} | {g('image_count', 0)} | {g('parse_time_ms', 0.0):.2f} | {g('reason')} |\n")
        j.write("]}")
    return as_json, as_text


def provider_timeout(explicit: Column, base: Column, factor: float = 2.5, least: float = 90.0, most: float = 900.0) -> Column:
    return F.coalesce(explicit, F.least(F.greatest(base * factor, F.lit(least)), F.lit(max(most, least))))


def fallback_chain(chain: Column, failed: Column) -> Column:
    return F.filter(chain, lambda p: p != failed)


def first_available(chain: Column, known: Column) -> Column:
    return F.try_element_at(F.filter(chain, lambda p: F.array_contains(known, p)), F.lit(1))


#: Indexing and search options by store, and the least values of some.
OPTIONS = {
    "chroma": {"hnsw_space": "cosine", "hnsw_m": 16, "hnsw_ef_construction": 100},
    "qdrant": {"quantization": "none", "hnsw_ef": 128, "exact": False},
    "weaviate": {"vectorizer": "none", "index_type": "hnsw", "ef": 64},
    "opensearch": {"engine": "nmslib", "space_type": "cosinesimil", "ef_search": 128},
    "pgvector": {"index_type": "ivfflat", "probes": 10, "lists": 100},
}
LEAST = {("chroma", "hnsw_m"): 4, ("qdrant", "hnsw_ef"): 16, ("weaviate", "ef"): 16, ("opensearch", "ef_search"): 16, ("pgvector", "probes"): 1}


def options(store: str, overrides: dict | None = None) -> dict:
    """A store's options with overrides, none under its least value; an unknown store has just the overrides."""
    out = OPTIONS.get(store, {}) | dict(overrides or {})
    return out | {k: max(least, int(out[k])) for (s, k), least in LEAST.items() if s == store}
