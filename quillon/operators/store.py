"""Stores behind one contract, and the client that keeps records, collections and their schema versions in step with a store.

A table store keeps each collection as a snapshot in the shared folder: a write reads the present one, makes the next by joins and unions and writes
it, so a failed write changes nothing. Collections and their versions are configuration, some rows held by the driver; documents and records never are.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.vectors import pseudo_embedding
from ..schemas import ConfigError
from ..shared import table
from . import catalog, filters, lifecycle, search

PROVIDERS = ("chroma", "qdrant", "weaviate", "opensearch", "pgvector", "infinity")


@dataclass(frozen=True)
class Traits:
    """Where stores differ: whether an update creates an absent document, what a deletion of an absent one answers, what their own count says at most,
    whether a document without vector scores 0 (else as the query itself), whether filters follow the limit."""

    update_inserts: bool = False
    absent_delete: bool = False
    count_cap: int | None = None
    zero_without_vector: bool = False
    filter_after_limit: bool = False


TRAITS = {
    "chroma": Traits(update_inserts=True, absent_delete=True, count_cap=10_000), "qdrant": Traits(update_inserts=True, absent_delete=True), "weaviate": Traits(absent_delete=True, filter_after_limit=True),
    "opensearch": Traits(update_inserts=True), "pgvector": Traits(), "infinity": Traits(count_cap=10_000, zero_without_vector=True),
}


@dataclass(frozen=True)
class Spec:
    """A collection's definition."""

    name: str
    namespace: str = ""
    embedding_dim: int = 1024
    distance_metric: str = "cosine"
    metadata: Mapping[str, str] = field(default_factory=dict)
    metadata_schema: Mapping[str, str] = field(default_factory=dict)
    index_params: Mapping[str, str] = field(default_factory=dict)
    access_policy: Mapping[str, str] = field(default_factory=dict)


class Store(ABC):
    """What a store must do; documents are (id, content, metadata map<string,string>[, embedding])."""

    @abstractmethod
    def initialize(self, config: Mapping | None = None) -> bool: ...

    @abstractmethod
    def health_check(self) -> bool: ...

    @abstractmethod
    def create_collection(self, spec: Spec) -> dict: ...

    @abstractmethod
    def get_collection(self, name: str) -> dict | None: ...

    @abstractmethod
    def delete_collection(self, name: str) -> bool: ...

    @abstractmethod
    def add_documents(self, collection: str, documents: DataFrame) -> DataFrame: ...

    @abstractmethod
    def search(self, collection: str, query: str, n_results: int, filter: Mapping | None = None, options: Mapping | None = None) -> DataFrame: ...

    @abstractmethod
    def delete_document(self, collection: str, doc_id: str) -> bool: ...

    @abstractmethod
    def update_document(self, collection: str, doc_id: str, content: str, metadata: Mapping | None = None) -> bool: ...

    @abstractmethod
    def count_documents(self, collection: str, filter: Mapping | None = None) -> int: ...

    @abstractmethod
    def capabilities(self) -> search.Capabilities: ...


CONTRACT = tuple(sorted(Store.__abstractmethods__))


def conforms(store: object) -> bool:
    return all(hasattr(store, name) for name in CONTRACT)


def in_metadata(k: str) -> Column:
    return F.try_element_at("metadata", F.lit(k))


def _text(asked: Mapping | None) -> dict:
    """Values as the metadata map holds them."""
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (asked or {}).items()}


def with_ids(documents: DataFrame) -> DataFrame:
    """Documents with an id and metadata each: a missing id is a random one, missing metadata are empty."""
    rows = documents if "id" in documents.columns else documents.withColumn("id", F.lit(None).cast("string"))
    rows = rows if "metadata" in rows.columns else rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return rows.withColumns({"id": F.coalesce("id", F.replace(F.uuid(), F.lit("-"), F.lit(""))), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


class TableStore(Store):
    """A store of snapshots in the shared folder that answers as one of PROVIDERS does; embed makes vectors of texts, else they come from the text alone."""

    def __init__(self, spark: SparkSession, provider: str, embed: Callable[[Column], Column] | None = None) -> None:
        self.spark, self.provider, self.traits, self.embed = spark, provider, TRAITS[provider], embed
        self.specs: dict[str, Spec] = {}
        self.data: dict[str, DataFrame] = {}

    def initialize(self, config: Mapping | None = None) -> bool:
        return self.health_check()

    def health_check(self) -> bool:
        try:
            return self.spark.range(1).count() == 1
        except Exception:
            return False

    def capabilities(self) -> search.Capabilities:
        return search.MATRIX[self.provider]

    def create_collection(self, spec: Spec) -> dict:
        """A collection that exists is kept as it is, with its documents."""
        existed = spec.name in self.specs
        self.specs.setdefault(spec.name, spec)
        return {"name": spec.name, "created": not existed}

    def get_collection(self, name: str) -> dict | None:
        s = self.specs.get(name)
        return None if s is None else {"name": name} if self.provider == "infinity" else {"name": name, "embedding_dim": s.embedding_dim, "distance_metric": s.distance_metric}

    def delete_collection(self, name: str) -> bool:
        self.data.pop(name, None)
        return self.specs.pop(name, None) is not None

    def _vector(self, collection: str, text: Column) -> Column:
        return self.embed(text) if self.embed else pseudo_embedding(text, self.specs[collection].embedding_dim if collection in self.specs else 1024).cast("array<float>")

    def documents(self, collection: str) -> DataFrame:
        """(seq, id, content, metadata, embedding) of a collection; seq is the place of insertion."""
        return self.data.get(collection, self.spark.createDataFrame([], "seq bigint, id string, content string, metadata map<string,string>, embedding array<float>"))

    def add_documents(self, collection: str, documents: DataFrame) -> DataFrame:
        """Upserts documents and returns their ids (id). A document that is there keeps its place, of several with one id the last counts."""
        now = self.documents(collection)
        rows = with_ids(documents).select("id", "content", "metadata", F.col("embedding") if "embedding" in documents.columns else F.lit(None).cast("array<float>").alias("embedding"))
        start = now.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        rows = table(rows.withColumns({"seq": F.monotonically_increasing_id() + start, "embedding": F.coalesce("embedding", self._vector(collection, F.col("content")))}), "documents")
        last = rows.groupBy("id").agg(F.max_by(F.struct("content", "metadata", "embedding"), "seq").alias("d"), F.min("seq").alias("seq"))
        place = last.join(now.select("id", F.col("seq").alias("old")), "id", "left").select(F.coalesce("old", "seq").alias("seq"), "id", "d.*")
        self.data[collection] = table(now.join(last.select("id"), "id", "left_anti").unionByName(place), "store")
        return last.select("id")

    def search(self, collection: str, query: str, n_results: int, filter: Mapping | None = None, options: Mapping | None = None) -> DataFrame:
        """(id, score, content, metadata) best first; a query that is empty counts as `*`. Options: metric (dot by default), hybrid."""
        rows, options = self.documents(collection), options or {}
        vector = self.spark.range(1).select(self._vector(collection, F.lit(query or "*"))).first()[0]
        if self.traits.zero_without_vector:
            rows = rows.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")).otherwise(F.array(*[F.lit(0.0)] * len(vector)).cast("array<float>")))
        where = filters.any_key(_text(filter), in_metadata)
        if options.get("hybrid") and self.capabilities().hybrid:
            return search.hybrid(rows.where(where), query, vector, n_results).join(rows.select("id", "content", "metadata"), "id").orderBy(F.desc("score"), "id")
        late = self.traits.filter_after_limit
        hits = search.topk(rows, vector, n_results, options.get("metric", "dot"), where=None if late else where, order="seq")
        return (hits.where(where) if late else hits).select("id", "score", "content", "metadata")

    def delete_document(self, collection: str, doc_id: str) -> bool:
        now = self.documents(collection)
        there = not now.where(F.col("id") == doc_id).isEmpty()
        if there:
            self.data[collection] = table(now.where(F.col("id") != doc_id), "store")
        return there or self.traits.absent_delete

    def update_document(self, collection: str, doc_id: str, content: str, metadata: Mapping | None = None) -> bool:
        """Replaces a document, at its place (one store's at the end); an absent one is created or not, as the store has it."""
        there = not self.documents(collection).where(F.col("id") == doc_id).isEmpty()
        if not there and not self.traits.update_inserts:
            return False
        if there and self.provider == "infinity":
            self.delete_document(collection, doc_id)
        self.add_documents(collection, self.spark.createDataFrame([(doc_id, content, _text(metadata))], "id string, content string, metadata map<string,string>"))
        return True

    def count_documents(self, collection: str, filter: Mapping | None = None) -> int:
        rows = self.documents(collection)
        n = rows.where(filters.any_key(_text(filter), in_metadata)).count()
        return min(n, self.traits.count_cap) if self.traits.count_cap and filter else n


class StoreRegistry:
    """Stores by provider."""

    def __init__(self) -> None:
        self.stores: dict[str, Store] = {}

    def register(self, provider: str, store: Store) -> None:
        self.stores[provider] = store

    def get(self, provider: str) -> Store:
        if provider not in self.stores:
            raise KeyError(f"no store for {provider}")
        return self.stores[provider]

    def ids(self) -> list[str]:
        return sorted(self.stores)


def build(spark: SparkSession, provider: str, embed: Callable[[Column], Column] | None = None) -> Store:
    if provider not in PROVIDERS:
        raise ValueError(f"unsupported provider {provider}")
    return TableStore(spark, provider, embed)


@dataclass(frozen=True)
class ProviderConfig:
    """How a remote store is reached; for plug-ins."""

    provider_id: str
    base_url: str = ""
    api_key: str = ""
    username: str = ""
    password: str = ""
    host: str = ""
    port: int = 0
    database: str = ""
    database_uri: str = ""
    timeout_seconds: float = 30.0
    embedding_provider_id: str = ""
    embedding_base_url: str = ""
    embedding_api_key: str = ""
    embedding_model: str = ""
    embedding_timeout_seconds: float = 30.0


def _true(v: object) -> bool:
    return bool(v) if isinstance(v, (bool, int, float)) else str(v).strip().lower() in ("1", "true", "yes", "on")


def provider_config(provider: str, raw: Mapping, embeddings: Mapping | None = None) -> ProviderConfig:
    """A provider's settings: the address is given, or made of host, port and tls; of embeddings the provider's own section counts before the general keys."""
    text = lambda *names: next((str(raw[n]) for n in names if n in raw), "")
    host, port, url = text("host"), int(raw.get("port") or 0), text("base_url", "url")
    if not url and host and port:
        url = f"{'https' if _true(raw.get('tls', raw.get('ssl', False)) or False) else 'http'}://{host}:{port}"
    e = embeddings if isinstance(embeddings, Mapping) else {}
    name = str(e.get("provider", "")).strip().lower()
    own = e.get(name) if isinstance(e.get(name), Mapping) else {}
    pick = lambda k, general: str(own.get(k, e.get(general, "")))
    base = ProviderConfig(provider, url, text("api_key", "auth_token"), text("username"), text("password"), host, port, text("database"), text("database_uri"), float(raw.get("timeout_seconds") or 30.0))
    return base if not e else replace(
        base, embedding_provider_id=name, embedding_base_url=pick("base_url", "base_url"), embedding_api_key=pick("api_key", "auth_token"), embedding_model=pick("model", "model"),
        embedding_timeout_seconds=float(own.get("timeout_seconds", e.get("timeout_seconds")) or 30.0),
    )


def configured(spark: SparkSession, config: Mapping, now: str) -> Client:
    """A client of all enabled providers of a configuration; the default is the one named, else the first by name."""
    stores, registry = config.get("vector_stores", {}), StoreRegistry()
    for provider in PROVIDERS:
        raw = stores.get(provider)
        if isinstance(raw, Mapping) and raw.get("enabled", False):
            registry.register(provider, build(spark, provider))
    default = str(stores.get("default_backend", "")) or next(iter(registry.ids()), "")
    if not default:
        raise ValueError("no enabled store")
    return Client(spark, registry, default, now)


class Client:
    """Collections, records and searches over one of several stores."""

    def __init__(self, spark: SparkSession, registry: StoreRegistry, default: str, now: str) -> None:
        self.spark, self.registry, self.default, self.now = spark, registry, default, now
        self.specs: dict[tuple[str, str], Spec] = {}
        self.versions = catalog.Versions()
        self.kept: dict[tuple[str, str], DataFrame] = {}

    def store(self, provider: str | None = None) -> Store:
        return self.registry.get(provider or self.default)

    def health_check(self, provider: str | None = None) -> bool:
        return self.store(provider).health_check()

    # collections

    def _register(self, s: Spec) -> None:
        self.versions.register(s.name, s.embedding_dim, s.metadata_schema, s.metadata.get("embedding_model", "unspecified"))

    def create_collection(self, spec: Spec, provider: str | None = None) -> dict:
        catalog.check_spec(spec.name, spec.embedding_dim)
        out = self.store(provider).create_collection(spec)
        self.specs[provider or self.default, spec.name] = spec
        self._register(spec)
        return out

    def get_collection(self, name: str, provider: str | None = None) -> dict | None:
        """The client's own definition, else what the store knows of it."""
        s = self.specs.get((provider or self.default, name))
        return vars(s).copy() if s is not None else self.store(provider).get_collection(name)

    def list_collections(self, provider: str | None = None) -> list[dict]:
        return [self.get_collection(n, p) for p, n in sorted(self.specs) if p == (provider or self.default)]

    def update_collection(self, name: str, patch: Mapping, provider: str | None = None) -> dict | None:
        """Changes namespace and dimension and merges the maps; the metric stays. None for an absent collection."""
        s = self.specs.get((provider or self.default, name))
        if s is None:
            return None
        merged = {m: {**getattr(s, m), **patch.get(m, {})} for m in ("metadata", "metadata_schema", "index_params", "access_policy")}
        s = self.specs[provider or self.default, name] = replace(s, namespace=str(patch.get("namespace", s.namespace)), embedding_dim=int(patch.get("embedding_dim", s.embedding_dim)), **merged)
        self._register(s)
        return self.get_collection(name, provider)

    def delete_collection(self, name: str, provider: str | None = None) -> bool:
        self.specs.pop((provider or self.default, name), None)
        self.kept.pop((provider or self.default, name), None)
        return self.store(provider).delete_collection(name)

    # records

    def records(self, collection: str, provider: str | None = None) -> DataFrame | None:
        return self.kept.get((provider or self.default, collection))

    def upsert_records(self, collection: str, rows: DataFrame, provider: str | None = None) -> DataFrame:
        """Normalises and checks the rows, supersedes earlier ones of their documents, writes both, and returns the ids (record_id). One bad row keeps all out."""
        at = (provider or self.default, collection)
        s = self.specs.get(at)
        before = self.kept.get(at)
        start = 0 if before is None else before.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        new = lifecycle.normalised(rows, self.now, s.name if s else None, s.namespace if s else None).withColumn("supersedes", F.col("supersedes") if "supersedes" in rows.columns else F.lit(None).cast("string"))
        new = lifecycle.checked(table(new.withColumn("seq", F.monotonically_increasing_id() + start), "batch"))
        old = new.limit(0) if before is None else before
        cols = [c for c in old.columns if c in new.columns]
        self.kept[at] = table(lifecycle.upsert(old.select(*cols), new.select(*cols)), "records")
        self.store(provider).add_documents(collection, as_documents(lifecycle.last_of(new, "record_id", "seq")))
        return new.select("record_id")

    def get_record(self, collection: str, record_id: str, provider: str | None = None) -> Row | None:
        kept = self.records(collection, provider)
        return None if kept is None else next(iter(kept.where(F.col("record_id") == record_id).limit(1).collect()), None)

    def list_records(self, collection: str, raw: Mapping | None = None, offset: int = 0, limit: int = 100, provider: str | None = None) -> DataFrame | None:
        kept = self.records(collection, provider)
        return None if kept is None else search.page(kept.where(filters.predicate(raw, _field(kept))), ["seq"], offset, limit)

    def delete_record(self, collection: str, record_id: str, provider: str | None = None) -> bool:
        if self.get_record(collection, record_id, provider) is None:
            return False
        self._replace(collection, lifecycle.soft_delete(self.records(collection, provider), F.col("record_id") == record_id), F.col("record_id") == record_id, provider)
        return True

    def update_record(self, collection: str, record_id: str, content: str, metadata: Mapping | None = None, provider: str | None = None) -> bool:
        """New content and metadata of a record; provenance it has is kept, hashes aren't made anew. ValueError if it would be invalid."""
        if self.get_record(collection, record_id, provider) is None:
            return False
        kept = self.records(collection, provider)
        change = {k: v for k, v in (metadata or {}).items() if k in kept.columns}
        one = self.spark.range(1).select(F.lit(record_id).alias("record_id"), F.lit(content).alias("content"), *[F.lit(v).cast(kept.schema[k].dataType).alias(k) for k, v in change.items()])
        after = lifecycle.update(kept, one)
        lifecycle.checked(after.where(F.col("record_id") == record_id))
        self._replace(collection, after, F.col("record_id") == record_id, provider)
        return True

    def delete_by_filter(self, collection: str, raw: Mapping | None, provider: str | None = None) -> int:
        """Soft deletion of all that match, deleted ones counted again; an empty filter matches all."""
        kept = self.records(collection, provider)
        if kept is None:
            return 0
        hit = filters.predicate(raw, _field(kept))
        n = kept.where(hit).count()
        self._replace(collection, lifecycle.soft_delete(kept, hit), hit, provider)
        return n

    def _replace(self, collection: str, after: DataFrame, changed: Column, provider: str | None) -> None:
        """The record table's next snapshot, and the changed rows in the store."""
        ids = table(self.records(collection, provider).where(changed).select("record_id"), "changed")
        now = self.kept[provider or self.default, collection] = table(after, "records")
        self.store(provider).add_documents(collection, as_documents(now.join(ids, "record_id", "left_semi")))

    def count_documents(self, collection: str, raw: Mapping | None = None, provider: str | None = None, compat: bool = False) -> int:
        kept = self.records(collection, provider)
        return 0 if kept is None else lifecycle.count(kept, {k: v for k, v in (raw or {}).items() if k in kept.columns} if raw else None, compat).first().n

    # search

    def search(self, collection: str, query: str, top_k: int = 10, raw: Mapping | None = None, threshold: float | None = None, include_metadata: bool = True, hints: Mapping | None = None, provider: str | None = None, mode: str = "exact") -> DataFrame:
        """(id, score, content[, metadata]) of active records unless the filter says otherwise, best first. mode exact applies all conditions
        before the limit, compat those of the records after the store's own limit, as a client of remote stores does."""
        h = hints or {}
        self.versions.mismatch(collection, int(h["embedding_dim"]) if h.get("embedding_dim") is not None else None, str(h["embedding_model"]) if h.get("embedding_model") else None)
        raw = {"lifecycle_state": "active", **(raw or {})}
        kept, store = self.records(collection, provider), self.store(provider)
        if mode == "exact" and kept is not None and isinstance(store, TableStore):
            live = kept.where(filters.predicate(raw, _field(kept))).select(F.col("record_id").alias("id"))
            hits = search.topk(store.documents(collection).join(live, "id", "left_semi"), self.spark.range(1).select(store._vector(collection, F.lit(query or "*"))).first()[0], top_k, order="seq").select("id", "score", "content", "metadata")
            hits = search.at_least(hits, threshold)
        else:
            hits = search.at_least(store.search(collection, query or "*", top_k, filters.pushed(raw)), threshold)
            if kept is not None:
                ok = kept.select(F.col("record_id").alias("id"), filters.predicate(raw, _field(kept)).alias("_ok"))
                hits = hits.join(ok, "id", "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok").orderBy(F.desc("score"))
        return hits if include_metadata else hits.drop("metadata")

    def search_stream(self, collection: str, query: str, top_k: int = 10, **how) -> Iterator[Row]:
        """A search's results one by one."""
        return self.search(collection, query, top_k, **how).toLocalIterator()


def run_search(client: Client, collection: str, query: str, **how) -> DataFrame:
    """A search by way of its plan: k within the store's batch size, filters only where it takes any."""
    p = search.plan(how.pop("top_k", 10), how.pop("raw", None), client.store(how.get("provider")).capabilities())
    return client.search(collection, query, p["top_k"], p["filters"], **how)


def _field(df: DataFrame) -> Callable[[str], Column]:
    return lambda k: F.col(k) if k in df.columns else F.lit(None)


def as_documents(rows: DataFrame) -> DataFrame:
    """(id, content, metadata) of records: all other columns as text in one map, without those that are null."""
    other = [c for c in rows.columns if c not in ("content", "embedding", "seq")]
    pairs = [F.struct(F.lit(c).alias("key"), (F.to_json(c) if rows.schema[c].dataType.simpleString().startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias("value")) for c in other]
    return rows.select(F.col("record_id").alias("id"), "content", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("metadata"), *[c for c in ("embedding",) if c in rows.columns])


class CollectionManager:
    """The client's five operations on collections."""

    def __init__(self, client: Client) -> None:
        self.create, self.get, self.list, self.update, self.delete = client.create_collection, client.get_collection, client.list_collections, client.update_collection, client.delete_collection


def point_id(provider: str, collection: str, id_: Column) -> Column:
    """The UUID under which a store that needs one keeps an id."""
    namespace = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    if provider == "qdrant":
        return F.when(id_.rlike(r"\A[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}\z"), id_).otherwise(identity.uuid5(namespace, F.concat(F.lit("qdrant:"), id_)))
    return identity.uuid5(namespace, F.concat(F.lit(f"{collection}:"), id_))


def written(documents: DataFrame, send: Callable[[list[dict]], None], batch: int = 100) -> None:
    """Sends documents to a remote store from the executors, in batches: send is the plug-in that speaks its protocol."""
    if batch < 1:
        raise ConfigError("a batch has one document or more")

    def each(rows: Iterator[Row]) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict(True))
            if len(held) == batch:
                send(held)
                held = []
        if held:
            send(held)

    documents.foreachPartition(each)


def sample_collection(name: str = "docs") -> Spec:
    """A small collection for tests."""
    return Spec(name, "test", 4)


def sample_records(spark: SparkSession) -> DataFrame:
    """Two records for tests."""
    return spark.createDataFrame([("r1", "hello", "t1", "file://a"), ("r2", "world", "t1", "file://b")], "record_id string, content string, tenant_id string, source_uri string")
