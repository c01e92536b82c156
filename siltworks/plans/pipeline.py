"""Pipelines of named operators with their parameters: as one lazy plan, or step by step with progress that outlives a run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from siltworks.registry import get

Step = tuple[str, dict]


def _apply(df: DataFrame, step: Step) -> DataFrame:
    name, parameters = step
    wanted = [v for k, v in parameters.items() if k.startswith("input_") and isinstance(v, str)]
    if missing := [w for w in wanted if w.split(".")[0] not in df.columns]:
        raise KeyError(f"{name}: missing columns {', '.join(missing)}")
    return get(name)(df, **parameters)


def compile_pipeline(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Applies each (operator, parameters); all missing input columns of a step are named in one error."""
    for step in steps:
        df = _apply(df, step)
    return df


def step_names(steps: list[Step]) -> list[str]:
    """A folder's name for each step: its number, its operator, and a sum over it and all before it, so that a changed step is run again with what follows."""
    out, so_far = [], hashlib.sha256()
    for i, (name, parameters) in enumerate(steps):
        so_far.update(json.dumps([name, parameters], sort_keys=True, default=repr).encode())
        out.append(f"{i:03d}-{name}-{so_far.hexdigest()[:12]}")
    return out


def run_pipeline(df: DataFrame, steps: list[Step], folder: str, resume_from: int | None = None) -> DataFrame:
    """The last step's rows, each step written below folder. A run goes on after the last step that an earlier one finished (its
    _SUCCESS file says so), or from step resume_from, counted from 0. What is done within a step goes on by Spark's own tasks."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = step_names(steps)
    done = 0
    for name in names:
        p = path(f"{folder}/{name}/_SUCCESS")
        if not p.getFileSystem(conf).exists(p):
            break
        done += 1
    at = done if resume_from is None else min(done, resume_from)
    if at:
        df = spark.read.parquet(f"{folder}/{names[at - 1]}")
    for step, name in zip(steps[at:], names[at:]):
        _apply(df, step).write.mode("overwrite").parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
    return df
