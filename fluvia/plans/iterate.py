"""Loops over DataFrames: every round is a written table in the shared folder, so a lost executor costs one round."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in a folder of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/fluvia"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step", **watch: Column) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. Its ``path`` is kept on the frame.

    Aggregates in ``watch`` are observed while the rows are written, and kept as ``seen``: no job of their own.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    observed = Observation() if watch else None
    (df.observe(observed, *[c.alias(n) for n, c in watch.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path, out.seen = path, observed.get if watch else {}
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that ``written`` made, read as one: the plan doesn't grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.path for t in tables])


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that no later step reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def until_empty(state: DataFrame, step: Callable[[DataFrame], DataFrame], open_rows: Callable[[DataFrame], DataFrame], most: int | None = 200) -> DataFrame:
    """Apply ``step`` until ``open_rows`` of the state is empty; more than ``most`` rounds is an error.

    Steps that take a round a level have no ``most`` (None). A round's table is deleted once the next one is written.
    """
    mine = None
    for _ in range(most) if most else itertools.count():
        if open_rows(state).isEmpty():
            return state
        new = written(step(state))
        if mine is not None:
            discard(mine)
        state = mine = new
    raise RuntimeError(f"no fixed point after {most} rounds")
