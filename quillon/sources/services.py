"""Parsers and stores that run elsewhere: commands, jobs that are polled, a hosted store. What speaks to the service is a plug-in."""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import BackendUnavailableError, InvalidRequestError, ParserTimeoutError
from . import payloads
from .acquire import Parser, Registry

#: Parsers that are commands, and those reached by an address.
COMMAND_PARSERS = ("deepdoc", "docling")
SERVICE_PARSERS = ("mineru", "marker_mcp", "transformers")


def text_of(data: bytes) -> str:
    """Bytes as UTF-8, else UTF-16, else Latin-1."""
    for encoding in ("utf-8", "utf-16"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


class CommandParser(Parser):
    """A parser that is a command on every executor: it reads the file /dev/stdin, whose name stands in DOCUMENT_NAME, and prints the text, so that nothing
    is written to a machine's own folders. Without output the file itself is taken as text."""

    def __init__(self, name: str, command: Sequence[str], timeout_s: float = 120.0) -> None:
        if not command:
            raise BackendUnavailableError(f"{name} command is not configured")
        self.name, self.command, self.timeout_s = name, list(command), timeout_s

    def healthy(self) -> bool:
        try:
            return subprocess.run([*self.command, "--help"], capture_output=True, timeout=self.timeout_s).returncode == 0
        except (OSError, subprocess.TimeoutExpired):
            return False

    def parse(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(row, *self._one(name, bytes(data))) for row, name, data in zip(b["row"], b["filename"], b["data"], strict=True)], columns=["row", "text", "error"])

    def _one(self, name: str | None, data: bytes) -> tuple[str | None, str | None]:
        try:
            out = subprocess.run([*self.command, "/dev/stdin"], input=data, capture_output=True, timeout=self.timeout_s, env={**os.environ, "DOCUMENT_NAME": name or "document.bin"})
        except subprocess.TimeoutExpired:
            return None, "timed out"
        except OSError as e:
            return None, type(e).__name__
        if out.returncode:
            return None, f"{self.name} command failed: {out.stderr.decode('utf-8', 'replace')[:200]}"
        return out.stdout.decode("utf-8", "replace").strip() or text_of(data).strip(), None


def parser_registry(services: Mapping[str, Mapping], makers: Mapping[str, Callable[[Mapping], Parser]]) -> Registry:
    """A registry of what is configured: commands that are enabled, and services that have an address and a maker, the plug-in that speaks to them."""
    registry = Registry()
    for name in COMMAND_PARSERS:
        c = services.get(name)
        if isinstance(c, Mapping) and c.get("enabled"):
            registry.register(CommandParser(name, list(c.get("command", [name])), float(c.get("timeout_seconds") or 120.0)))
    for name in SERVICE_PARSERS:
        c = services.get(name)
        if isinstance(c, Mapping) and str(c.get("base_url", "")).strip() and name in makers:
            registry.register(makers[name](c))
    return registry


def ended(answer: Mapping) -> str | None:
    """How a job ended, as catalog.async_status() has it for columns: failed, ok, or None while it runs."""
    from ..operators.catalog import ENDED, FAILED

    word = str(answer.get("status", "")).strip().lower()
    if word in FAILED or word in ENDED:
        return "failed" if word in FAILED else "ok"
    if answer.get("completed"):
        return "ok" if answer.get("success") else "failed" if answer.get("error") else None
    return None


def run_job(submit: Callable[[], str], poll: Callable[[str], Mapping], fetch: Callable[[str], Mapping], cancel: Callable[[str], object] | None = None, every_s: float = 5.0, most_s: float = 600.0, tell: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Mapping:
    """Submits a job and waits for its answer, within a task. InvalidRequestError if it fails, ParserTimeoutError, after it is cancelled, if it takes too long.

    An answer that already holds the output isn't fetched again. tell hears of each look at the job.
    """
    every_s, most_s = max(0.1, every_s), max(1.0, most_s)
    job, begin = submit(), clock()
    while True:
        answer = poll(job)
        if tell:
            tell({"event": "poll", "job_id": job, "status": answer.get("status")})
        end = ended(answer)
        if end == "failed":
            raise InvalidRequestError(str(answer.get("error") or answer.get("message") or "async parse failed"))
        if end == "ok":
            return answer if any(k in answer for k in ("output", "markdown", "text")) else fetch(job)
        if clock() - begin >= most_s:
            if cancel:
                try:
                    cancel(job)
                except Exception:  # the job is given up in any case
                    pass
            raise ParserTimeoutError(f"async parse timed out after {most_s:.1f}s")
        sleep(every_s)


class HostedStore:
    """A hosted store's operations; call(method, path, body) -> (status, headers, JSON text) is the plug-in that speaks to it."""

    def __init__(self, spark: SparkSession, call: Callable[[str, str, object], tuple[int, Mapping, str]], dialect: str = "portable") -> None:
        self.spark, self.call, self.dialect = spark, call, dialect

    def _ask(self, what: str, method: str, path: str, body: object = None) -> tuple[int, Mapping, str]:
        try:
            status, headers, text = self.call(method, path, body)
        except Exception as e:
            raise RuntimeError(f"Remote {what} failed") from e
        if status >= 400 and not (method == "DELETE" and status == 404):
            raise RuntimeError(f"Remote {what} failed")
        return status, headers, text

    def health_check(self) -> bool:
        try:
            return self.call("GET", "/health", None)[0] == 200
        except Exception:
            return False

    def search(self, collection: str, request: Mapping) -> DataFrame:
        """(pos, id, score, content, metadata), in the dialect that the answer names."""
        _, headers, text = self._ask(f"search for {collection}", "POST", f"/collections/{collection}/search", dict(request))
        dialect = headers.get("X-VDB-Backend", self.dialect).strip().lower()
        return payloads.normalised(self.spark.createDataFrame([(0, text)], "payload_id int, payload string"), dialect).drop("payload_id").orderBy("pos")

    def upsert_records(self, collection: str, records: DataFrame, batch: int = 100) -> int:
        """Sends records (record_id, content, metadata, lifecycle_state) in batches from the executors; returns their number."""
        call = self.call

        def each(rows: Iterator) -> None:
            held: list[dict] = []

            def send() -> None:
                status, _, _ = call("POST", f"/collections/{collection}/records:upsert", {"records": held})
                if status >= 400:
                    raise RuntimeError(f"Remote upsert for {collection} failed")

            for r in rows:
                held.append(r.asDict(True))
                if len(held) == batch:
                    send()
                    held = []
            if held:
                send()

        records.foreachPartition(each)
        return records.count()

    def delete_record(self, collection: str, record_id: str) -> bool:
        return self._ask(f"delete for {collection}/{record_id}", "DELETE", f"/collections/{collection}/records/{record_id}")[0] != 404


@contextmanager
def trace_span(name: str, spark: SparkSession | None = None) -> Iterator[None]:
    """Names the jobs of a block in the session's own records; without a session it does nothing."""
    if spark is not None:
        spark.sparkContext.setLocalProperty("spark.job.description", name)
    try:
        yield
    finally:
        if spark is not None:
            spark.sparkContext.setLocalProperty("spark.job.description", None)


def answer_of(text: str) -> Mapping:
    """A service's answer as a mapping, empty if it is none."""
    try:
        out = json.loads(text)
    except json.JSONDecodeError:
        return {}
    return out if isinstance(out, Mapping) else {}
