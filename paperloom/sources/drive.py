"""A Spark data source over exports of workspace files: ``spark.read.format("workspace_exports")``.

Options: ``ids``, a JSON list of file ids; ``client``, module:function,
which is injected and gives a dict (http, name, mimeType, modifiedTime, content) for an id; ``partition`` ids a partition
(32); ``retries`` of answers that may pass (3) and ``wait`` seconds before the first of them, doubled each time (0.5).
A status that is no success is a value of its row. A client that raises is tried again and then has status 0.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "fileId string, http int, name string, mimeType string, modifiedTime string, content binary, tries int, error string"
#: Statuses that may pass.
PASSING = (429, 500, 502, 503, 504)


class Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class WorkspaceExports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace_exports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Exports:
        return Exports({k.lower(): v for k, v in self.options.items()})


class Exports(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "client" not in options or "ids" not in options:
            raise ValueError("workspace_exports needs the options client and ids")
        self.client, self.ids = options["client"], json.loads(options["ids"])
        self.size, self.retries, self.wait = int(options.get("partition", 32)), int(options.get("retries", 3)), float(options.get("wait", 0.5))

    def partitions(self) -> list[Ids]:
        ids = list(dict.fromkeys(self.ids))
        return [Ids(ids[at : at + self.size]) for at in range(0, len(ids), self.size)] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        module, _, function = self.client.partition(":")
        client = getattr(importlib.import_module(module), function)
        for key in partition.ids:
            yield self.fetched(client, key)

    def fetched(self, client, key: str) -> tuple:
        for k in range(self.retries + 1):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                got, error = dict(client(key)), None
            except Exception as e:  # noqa: BLE001
                got, error = {"http": 0}, f"{type(e).__name__}: {e}"[:8000]
            if got["http"] not in (0, *PASSING):
                break
        return (key, got["http"], got.get("name"), got.get("mimeType"), got.get("modifiedTime"), got.get("content") if got["http"] == 200 else None, k + 1, error)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkspaceExports)


def exports(spark: SparkSession, ids: list[str], client: str, **options) -> object:
    register(spark)
    return spark.read.format(WorkspaceExports.name()).options(ids=json.dumps(ids), client=client, **options).load()
