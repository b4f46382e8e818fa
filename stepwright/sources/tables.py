"""Typed parquet tables and plain configuration."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "edited_modules:array<string>,added_modules:array<string>,edited_entities:array<string>,added_entities:array<string>"
#: Columns of raw issue rows.
ISSUES = f"instance_id string, repo string, problem_statement string, patch string, file_changes array<struct<file:string,changes:struct<{CHANGES}>>>"
#: Columns of training samples, in the order in which they are written.
SAMPLES = (
    "sample_id string, instance_id string, repo string, split string, node_key string, step_index int, step_count int, "
    "messages array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>, "
    "label float, label_binary tinyint, label_soft float, label_source string, mc_score float, n_rollouts smallint, visits smallint, in_pool tinyint, rendered_tokens int"
)


def read_issues(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw issue rows of several files with ``source``, the name of the file without its ending; missing columns raise."""
    from stepwright.operators.rules import require_columns

    out = None
    for path in paths:
        df = require_columns(spark.read.parquet(path), ("instance_id", "repo", "problem_statement", "patch", "file_changes"))
        for name, default in (("base_commit", F.lit(None).cast("string")), ("use_patch", F.lit(True))):
            if name not in df.columns:
                df = df.withColumn(name, default)
        df = df.withColumn("source", F.lit(Path(path).stem))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Training samples by their fixed schema; only selected columns are read."""
    return spark.read.schema(SAMPLES).parquet(path)


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """``base`` with the values of ``over``, dictionaries within merged; None never overrides."""
    out = dict(base)
    for key, value in (over or {}).items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif value is not None:
            out[key] = value
    return out


def read_config(path: str, base: dict[str, Any] | None = None) -> dict[str, Any]:
    """A configuration file, JSON or (where a reader is installed) YAML, over ``base``; a missing file changes nothing."""
    file = Path(path)
    if not file.exists():
        return dict(base or {})
    if file.suffix == ".json":
        return merged(base or {}, json.loads(file.read_text()))
    import yaml

    return merged(base or {}, yaml.safe_load(file.read_text()))


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines: export, blank lines and comments are allowed, quotes are taken off, a comment after a bare value too."""
    out = {}
    for line in text.splitlines():
        found = re.match(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if found:
            name, value = found.groups()
            quoted = re.match(r"""^(["'])(.*?)\1""", value)
            out[name] = quoted.group(2) if quoted else re.sub(r"\s+#.*$", "", value)
    return out


def load_env(path: str, override: bool = False) -> dict[str, str]:
    """Puts a file's values into the environment, where they aren't set or ``override`` is given; returns those it set."""
    values = parse_env(Path(path).read_text()) if Path(path).exists() else {}
    taken = {k: v for k, v in values.items() if override or k not in os.environ}
    os.environ.update(taken)
    return taken
