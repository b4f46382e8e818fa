"""A source of paged documents: a fetch function with a cursor, behind Spark's interface."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str, str | None, int], tuple[list[dict], str | None]]


def pages(fetch: Fetch, key: str, size: int = 1000) -> Iterator[dict]:
    """All documents of one key: ``fetch(key, cursor, size)`` gives a page and the next cursor, None at the end."""
    cursor = None
    while True:
        page, cursor = fetch(key, cursor, min(size, 1000))
        yield from page
        if cursor is None:
            return


def read_pages(spark: SparkSession, keys: list[str], fetch: Fetch, size: int = 1000) -> DataFrame:
    """(key, document) with each document as JSON text; keys are fetched in parallel, a page at a time in memory."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for key in pdf["key"]:
                buffer = []
                for document in pages(fetch, key, size):
                    buffer.append(json.dumps(document, ensure_ascii=False, sort_keys=True))
                    if len(buffer) >= size:
                        yield pd.DataFrame({"key": key, "document": buffer})
                        buffer = []
                if buffer:
                    yield pd.DataFrame({"key": key, "document": buffer})

    if not keys:
        return spark.createDataFrame([], "key string, document string")
    wanted = spark.createDataFrame([(k,) for k in keys], "key string").repartition(len(keys))
    return wanted.mapInPandas(run, "key string, document string")
