"""Files and inline texts as rows, parsed into blocks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import identity, text
from ..shared import table


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, filename, mime_type, data) of the files under path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = identity.filename(F.col("path"))
    return f.select(F.col("path").alias("source_uri"), name.alias("filename"), identity.media_type(name).alias("mime_type"), F.col("content").alias("data"))


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_uri, text): files read whole as UTF-8."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("text"))


def inline(rows: DataFrame, column: str) -> DataFrame:
    """The same of texts given in a column."""
    return rows.select(F.lit("inline://").alias("source_uri"), F.lit("inline.txt").alias("filename"), F.lit("text/plain").alias("mime_type"), F.col(column).cast("binary").alias("data"))


@F.pandas_udf(StringType())
def decoded(data: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else UTF-16, else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for encoding in ("utf-8", "utf-16"):
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("latin-1")

    return data.map(one)


@dataclass(frozen=True)
class ParserCapabilities:
    """What a parser can do; fixed values are its defaults."""

    supports_pdf: bool = True
    supports_docx: bool = False
    supports_html: bool = False
    supports_layout: bool = False
    supports_tables: bool = False
    supports_images: bool = False
    supports_ocr_passthrough: bool = False
    supports_streaming: bool = False
    max_document_bytes: int = 64 * 1024 * 1024


class Parser(ABC):
    """A parser of documents, to be plugged in; parse gets pandas frames (row, source_uri, filename, mime_type, data) and yields (row, text, error)."""

    name = ""
    version = ""
    capabilities = ParserCapabilities()

    @abstractmethod
    def parse(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...

    def healthy(self) -> bool:
        return True


class OcrProvider(ABC):
    """Text recognition, to be plugged in; extract gets frames (row, data) and yields (row, text, confidence)."""

    name = ""

    @abstractmethod
    def extract(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...

    def healthy(self) -> bool:
        return True

    def recognised(self, images: DataFrame) -> DataFrame:
        """(row, text, confidence) of images (row, data)."""
        return images.select("row", "data").mapInPandas(self.extract, "row bigint, text string, confidence double")


class Registry:
    """Plug-ins by name."""

    def __init__(self, *items: Parser | OcrProvider) -> None:
        self.items = {x.name: x for x in items}

    def register(self, item: Parser | OcrProvider) -> None:
        self.items[item.name] = item

    def get(self, name: str) -> Parser | OcrProvider | None:
        return self.items.get(name)

    def ids(self) -> list[str]:
        return sorted(self.items)


INTERNAL = "internal"


def parse(docs: DataFrame, chain: list[Parser | str | None], registry: Registry | None = None) -> DataFrame:
    """docs (source_uri, filename, mime_type, data and any others) with provider_id, provider_version, blocks and error: each parser of the chain gets what those before it failed on.

    A parser is given itself, by its name in the registry, or as None or "internal" for the internal one, which decodes text. Rows are told apart by a number of their own, so that equal addresses
    don't mix; each parser's answers are written once. A document that all fail on stays, without blocks and with all errors.
    """
    left, done = table(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("_errors", F.array().cast("array<string>")), "documents"), []
    for p in chain or [INTERNAL]:
        if isinstance(p, str) and p != INTERNAL:
            found = registry.get(p) if registry else None
            if found is None:
                left = left.withColumn("_errors", F.array_append("_errors", F.lit(f"{p}:not_registered")))
                continue
            p = found
        if p is None or p == INTERNAL:
            out, name, version = left.select("row", decoded("data").alias("text"), F.when(F.col("data").isNull(), F.lit("no data")).alias("error")), INTERNAL, "1"
        else:
            out, name, version = left.select("row", "source_uri", "filename", "mime_type", "data").mapInPandas(p.parse, "row bigint, text string, error string"), p.name, p.version
        both = table(left.join(out, "row"), "parsed")
        done.append(both.where("error IS NULL").select(*docs.columns, F.lit(name).alias("provider_id"), F.lit(version).alias("provider_version"), text.paragraph_blocks(F.col("text")).alias("blocks"), F.lit(None).cast("string").alias("error")))
        left = both.where("error IS NOT NULL").withColumn("_errors", F.array_append("_errors", F.concat(F.lit(f"{name}:"), "error"))).drop("text", "error")
    failed = left.select(*docs.columns, F.lit(None).cast("string").alias("provider_id"), F.lit(None).cast("string").alias("provider_version"), F.lit(None).cast("array<string>").alias("blocks"), F.concat(F.lit("all parser providers failed: "), F.array_join("_errors", " | ")).alias("error"))
    return reduce(DataFrame.unionByName, done, failed)


def embedded(df: DataFrame, column: str, embed: Callable[[pd.Series], pd.Series] | None = None, dim: int = 64) -> DataFrame:
    """Adds embedding: by a model that maps a batch of texts to lists of floats, else made from the text alone."""
    if embed is None:
        from ..functions.vectors import pseudo_embedding

        return df.withColumn("embedding", pseudo_embedding(F.col(column), dim).cast("array<float>"))
    return df.withColumn("embedding", F.pandas_udf(embed, "array<float>")(column))


def chunked(docs: DataFrame, chunker: Callable[[Column], Column], uri: str = "source_uri", content: str = "text") -> DataFrame:
    """(source_uri, chunk_index, content) of each document's non-blank chunks."""
    return docs.select(F.col(uri).alias("source_uri"), F.posexplode(text.clean(chunker(F.col(content)))).alias("chunk_index", "content"))
