"""Writers of instances, splits, samples, reports and predictions."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> str:
    """A parquet table; an existing one raises, nothing is overwritten."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def write_samples(samples: DataFrame, path: str, split: str = "split", row_group_bytes: int = 16 * 2**20, rows_a_file: int = 1_000_000) -> str:
    """Samples in a folder a split, with small row groups; large splits are spread over several files, so no task
    writes a whole split."""
    writer = samples.repartition(F.col(split), F.pmod(F.xxhash64("instance_id"), F.lit(64))).write.partitionBy(split)
    writer = writer.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return path


def stored_messages(messages: str) -> Column:
    """Messages with call arguments as JSON text: what is text already stays, missing ones are null."""
    def call(c: Column) -> Column:
        function = F.struct(c["function"]["name"].alias("name"), F.nullif(c["function"]["arguments"].cast("string"), F.lit("")).alias("arguments"))
        return F.struct(c["id"].alias("id"), F.coalesce(c["type"], F.lit("function")).alias("type"), function.alias("function"))

    return F.transform(messages, lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), m["reasoning_content"].alias("reasoning_content"),
        F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], call)).alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")))


def write_report(report: DataFrame, path: str, title: str, most_rows: int = 10_000) -> tuple[str, str]:
    """A small report as JSON and as a table in Markdown; more rows than ``most_rows`` raise."""
    rows = report.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows is a table")
    base = Path(path)
    base.parent.mkdir(parents=True, exist_ok=True)
    data = [r.asDict(recursive=True) for r in rows]
    as_json, as_text = base.with_suffix(".json"), base.with_suffix(".md")
    as_json.write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str))
    head = f"# {title}\n\n| {' | '.join(report.columns)} |\n|{'---|' * len(report.columns)}\n"
    as_text.write_text(head + "".join(f"| {' | '.join(str(r[c]) for c in report.columns)} |\n" for r in data))
    return str(as_json), str(as_text)


def concat_predictions(*parts: DataFrame) -> DataFrame:
    """Predictions of several splits as one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_trace(spans: dict, path: str) -> str:
    """A trace as JSON, its folder made where it isn't there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(spans, ensure_ascii=False, indent=2, default=str))
    return str(target)


def remembered(folder: str, fingerprint: str, make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table that ``make`` gives, kept under the fingerprint of what it was made from and read from there the next time."""
    path = f"{folder}/{fingerprint}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
