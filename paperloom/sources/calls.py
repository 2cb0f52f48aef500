"""Calls of injected functions row by row: side by side in a task, each within a time limit, and without harm to other rows.

A call that raises or does not come back in time gives its row an error; nothing else fails. Calls that hang are left
behind on threads of their own, which end with the worker.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: seconds that a reader of scans has.
SECONDS = 60.0
#: Calls of a task at once, and how long a message may be.
AT_ONCE, MESSAGE = 8, 8000
ERROR = "struct<kind:string,message:string>"
FAILED, TIMEOUT = "call-failed", "call-timeout"
Call = Callable[[dict[str, Any]], Any]


class _One(threading.Thread):
    def __init__(self, call: Call, row: dict[str, Any]):
        super().__init__(daemon=True)
        self.call, self.row, self.value, self.error, self.began = call, row, None, None, time.monotonic()

    def run(self) -> None:
        try:
            self.value = self.call(self.row)
        except Exception as e:  # noqa: BLE001
            self.error = f"{type(e).__name__}: {e}"[:MESSAGE]


def results(call: Call, rows: Iterator[dict[str, Any]], seconds: float = SECONDS, at_once: int = AT_ONCE) -> Iterator[tuple[Any, dict[str, str] | None]]:
    """Value and error of each row, in order. Calls begin in order and have the same limit, so the oldest's ends first."""
    running: deque[_One] = deque()

    def oldest() -> tuple[Any, dict[str, str] | None]:
        one = running.popleft()
        one.join(max(0.0, one.began + seconds - time.monotonic()))
        if one.is_alive():
            return None, {"kind": TIMEOUT, "message": f"no answer within {seconds:g} s"}
        return (None, {"kind": FAILED, "message": one.error}) if one.error is not None else (one.value, None)

    for row in rows:
        if len(running) >= at_once:
            yield oldest()
        running.append(one := _One(call, row))
        one.start()
    while running:
        yield oldest()


def called(rows: DataFrame, call: Call, inputs: list[str], value: str, seconds: float = SECONDS, at_once: int = AT_ONCE, error: str = "callError") -> DataFrame:
    """``rows`` with what ``call`` makes of their ``inputs`` (a dict): columns ``value`` (DDL; of several, a dict of them) and ``error``.

    A value that does not fit its column is an error of its row, too.
    """
    new = StructType.fromDDL(value)
    names = [f.name for f in new]
    kept = rows.select(*(c for c in rows.columns if c.lower() not in {n.lower() for n in (*names, error)}))
    schema = StructType([*kept.schema, *new, *StructType.fromDDL(f"{error} {ERROR}")])
    arrow = to_arrow_schema(StructType([*new, *StructType.fromDDL(f"{error} {ERROR}")]))

    def fits(got: Any, problem: dict[str, str] | None) -> tuple[list[Any], dict[str, str] | None]:
        if problem is None:
            try:
                row = [got.get(n) for n in names] if len(names) > 1 else [got]
                for x, n in zip(row, names, strict=True):
                    pa.array([x], arrow.field(n).type)
                return row, None
            except Exception as e:  # noqa: BLE001
                problem = {"kind": FAILED, "message": f"the answer does not fit: {e}"[:MESSAGE]}
        return [None] * len(names), problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.select(inputs)
            asked = (given.slice(k, 1).to_pylist()[0] for k in range(given.num_rows))
            made = [fits(*x) for x in results(call, asked, seconds, at_once)]
            columns = [pa.array([row[k] for row, _ in made], arrow.field(n).type) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([e for _, e in made], arrow.field(error).type)], schema.fieldNames())

    return kept.mapInArrow(run, schema)


def reader(call: Call, inputs: list[str], seconds: float = SECONDS, at_once: int = AT_ONCE) -> Callable[[DataFrame], DataFrame]:
    """A model for ``layouts.read_scans`` and ``read_slides``: rows with ``answer``; where there is none, ``callError`` says why."""
    return lambda docs: called(docs, call, inputs, "answer string", seconds, at_once)


def classifier(call: Call, inputs: list[str], seconds: float = SECONDS) -> Callable[[DataFrame], DataFrame]:
    """A ``curate`` step of the lifecycle, from a function that gives c_sensitivity and c_rationale of a row."""
    return lambda docs: called(docs, call, inputs, "c_sensitivity string, c_rationale string", seconds).withColumn("c_error", F.col("callError.message")).drop("callError")


def risk_check(call: Call, inputs: list[str], seconds: float = SECONDS) -> Callable[[DataFrame], DataFrame]:
    """A ``risk`` step of the lifecycle; rows that it fails on get a maskerError there."""
    value = "detected boolean, recommendedSensitivity string, reasons array<string>, riskRationale string"
    return lambda docs: called(docs, call, inputs, value, seconds).withColumn("m_error", F.col("callError.message")).drop("callError")
