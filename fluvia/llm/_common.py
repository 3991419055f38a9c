"""Helpers that the corpus operators share: shared-folder tables, portable hashes, blocked prefix sums."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/fluvia"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. Its ``path`` is kept on the frame."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # the shuffle files of this job are of no use once the table is there; Python workers get texts by the thousand
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that no later step reads."""
    path = getattr(df, "path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def hash60(*parts: Column) -> Column:
    """A non-negative 60-bit number from the MD5 of the parts as text joined by '|' (null parts are the empty string).

    MD5 is the same in every engine, so that draws and orders can be checked by plain SQL.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def n_blocks(spark: SparkSession, rows: int, rows_per_block: int = 100_000) -> int:
    """Blocks to deal one group into: a power of two, enough for ``rows_per_block`` and for all tasks of a shuffle."""
    least = max(rows / rows_per_block, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << max(1, math.ceil(math.log2(least)))


def running_total(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column, out: str, blocks: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before this row by (``key``, ``ties``).

    ``key`` is a 60-bit hash. Its leading bits cut each group into ``blocks`` ranges, each range is summed apart
    (window within the range), and the ranges' totals are summed over the small table of ranges. No task holds a
    whole group. ``df`` is read twice and should be a written table.
    """
    bits = 60 - int(math.log2(blocks))
    d = df.withColumn("__block", F.shiftright(F.col(key), bits)).withColumn("__value", value.cast("long"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*group, "__block").agg(F.sum("__value").alias("__sum"))
    starts = ranges.select(*group, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__block").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.join(starts, [*group, "__block"])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .drop("__block", "__value", "__start")
    )


def numbered(df: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """A table of ``df`` with ``part``, ``idx`` and ``n``: range of the sort, place in the group from 0 without gaps, rows of the group.

    Rows are dealt by ranges of (``group``, ``order``) and counted range by range, so that no task holds a whole group.
    Null groups are a group; groups and orders sort ascending with nulls first; rows equal in both are interchangeable.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + order
    sorted_ = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    rows = written(sorted_.withColumn("part", F.shiftright("__at", 33)), label)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*group, "part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    spans = spans.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).withColumn("n", F.sum("__rows").over(whole))
    theirs = spans.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("part").alias("__part"), "__first", "__before", "n")
    same = F.col("part") == F.col("__part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    placed = rows.join(theirs, same).withColumn("idx", F.col("__before") + F.col("__at") - F.col("__first"))
    out = placed.drop("__at", "__first", "__before", "__part", *[f"__{g}" for g in group])
    out.path = rows.path
    return out
