"""Requests to the document API.

``request_documents`` asks for the ids of a table, where they are: as many tasks as may ask at once. ``spark.read.format(
"paper_api")`` is a data source for ids given by hand, a partition per batch. Options: ``base`` (URL up to the path),
``endpoint``, ``ids`` (JSON list), ``fields``, ``batch`` (ids a task), ``sleep`` (seconds before and after each request),
``timeout``, ``headers`` (JSON). Failed requests and unusable bodies give a row with a null body, so nothing is lost
silently. TLS is verified.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import REQUIRED

_PATHS = {"paper": "/paper/{id}", "references": "/paper/{id}/references", "citations": "/paper/{id}/citations", "authors": "/paper/{id}/authors", "author_papers": "/author/{id}/papers"}


class Ids(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        self.ids = ids


class PaperApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["base"].rstrip("/")
        self.endpoint = options["endpoint"]
        if self.endpoint not in _PATHS:
            raise ValueError(f"unknown endpoint {self.endpoint}")
        self.ids = list(dict.fromkeys(i.lower() for i in json.loads(options.get("ids", "[]"))))
        self.fields, self.batch = options.get("fields", ""), int(options.get("batch", "100"))
        self.sleep, self.timeout = float(options.get("sleep", "0")), float(options.get("timeout", "30"))
        self.headers = json.loads(options.get("headers", "{}"))

    def partitions(self) -> list[Ids]:
        return [Ids(self.ids[k : k + self.batch]) for k in range(0, len(self.ids), self.batch)] or [Ids([])]

    def read(self, part: Ids) -> Iterator[tuple]:
        for i in part.ids:
            time.sleep(self.sleep)
            url, body = request(self.base, self.endpoint, i, self.fields, self.headers, self.timeout)
            time.sleep(self.sleep)
            yield self.endpoint, i, url, datetime.now(timezone.utc), body


def request(base: str, endpoint: str, key: str, fields: str = "", headers: dict[str, str] | None = None, timeout: float = 30) -> tuple[str, str | None]:
    """The URL of one document and its body, null if it can't be had or isn't an object with the endpoint's key."""
    url = base.rstrip("/") + _PATHS[endpoint].format(id=urllib.parse.quote(key, safe=":")) + (f"?fields={fields}" if fields else "")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
            text = r.read().decode("utf-8")
        return url, text if REQUIRED[endpoint] in json.loads(text) else None
    except (OSError, ValueError, TypeError):
        return url, None


DOCUMENT = "endpoint string, key_id string, path string, fetched_at timestamp, body string"


def request_documents(
    ids: DataFrame, endpoint: str, base: str, fields: str = "", headers: dict[str, str] | None = None, concurrency: int = 8, sleep: float = 0.0, timeout: float = 30
) -> DataFrame:
    """A document for each of ``ids`` (``id``, unique), as ``DOCUMENT``; the body of a failed request is null.

    At most ``concurrency`` requests are under way at once, one a task. ``sleep`` seconds pass before and after each
    request; tasks begin apart by their share of it, so requests of all tasks together keep the spacing of
    ``sleep / concurrency``. Nothing goes through the driver.
    """
    if endpoint not in _PATHS:
        raise ValueError(f"unknown endpoint {endpoint}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        time.sleep(sleep * ((task.partitionId() if task else 0) % concurrency) / concurrency)
        for b in batches:
            for i in b.column(0).to_pylist():
                time.sleep(sleep)
                url, body = request(base, endpoint, i, fields, headers, timeout)
                time.sleep(sleep)
                now = datetime.now(timezone.utc)
                yield pa.RecordBatch.from_arrays([pa.array([endpoint]), pa.array([i]), pa.array([url]), pa.array([now], pa.timestamp("us", "UTC")), pa.array([body], pa.string())], names=["endpoint", "key_id", "path", "fetched_at", "body"])

    return ids.select("id").repartition(max(1, concurrency)).mapInArrow(run, DOCUMENT)


class PaperApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_api"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> PaperApiReader:  # noqa: ANN001
        return PaperApiReader({k: v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PaperApi)
