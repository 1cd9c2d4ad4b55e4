"""Looks into queries that take longer than a threshold: method, parameters, plan, files and result."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


class QueryDebugger:
    """Times queries and hands those over ``threshold_ms`` to ``slow``; this one does nothing with them."""

    def __init__(self, threshold_ms: float = 1000.0):
        self.threshold_ms = threshold_ms

    def perform(self, method: str, parameters: Any, df: DataFrame, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Runs a query to its end, without keeping its rows, and gives its frame. A query that fails over the threshold is reported too."""
        began, result = time.perf_counter(), None
        try:
            result = query(df)
            result.write.format("noop").mode("overwrite").save()
        finally:
            took = (time.perf_counter() - began) * 1000
            if took > self.threshold_ms:
                self.slow(method, parameters, df, result, took)
        return result

    def slow(self, method: str, parameters: Any, df: DataFrame, result: DataFrame | None, took_ms: float) -> None:
        """What to do with a slow query; nothing by default."""


class QueryDump(QueryDebugger):
    """Writes the state of a slow query to a text stream: method, parameters, time, rows in and out, files read, and the plan."""

    def __init__(self, threshold_ms: float = 1000.0, out=None):
        super().__init__(threshold_ms)
        self.out = out

    def slow(self, method, parameters, df, result, took_ms):
        out = self.out or sys.stdout
        print(f"Query {method}: {took_ms:.0f} ms", file=out)
        if parameters is not None:
            print(f"  parameters: {parameters}", file=out)
        print(f"  columns: {df.schema.simpleString()}", file=out)
        print(f"  rows: {df.count()}", file=out)
        for path in sorted(df.inputFiles()):
            print(f"  file: {path}", file=out)
        if result is not None:
            print(f"  result rows: {result.count()}", file=out)
            print("  plan:\n" + result._jdf.queryExecution().explainString(result.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), file=out)
