"""Sharding by a hierarchical weighted hash tree.

A row descends from region to rack to shard. At each node every child makes a weighted draw from the row's key,
``-ln(u) / weight`` with ``u`` hashed from (level, child, key), and the least draw wins: a child is taken with a
probability in proportion to its weight, the sum of the weights below it. A child's draw depends on nothing but itself,
the key and its own weight. When a weight changes, only draws on the path to it change, so rows move only into or out
of that subtree; a new top-level subtree takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash60, n_blocks, running_total, table, written

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


def even_topology(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight 1, numbered in order, in racks of ``per_rack`` and regions of ``racks_per_region``."""
    return [(s // (per_rack * racks_per_region), s // per_rack, s, 1.0) for s in range(shards)]


def grown_topology(leaves: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own: it alone takes rows, no other shard gains any."""
    return [*leaves, *[tuple(max(leaf[i] for leaf in leaves) + 1 for i in range(3)) + (weight,)]]


def _draw(level: str, node: int, weight: float, key: Column) -> Column:
    u = (hash60(F.lit(level), F.lit(node), key).cast("double") + 1.0) / F.lit(float(1 << 60))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(node).alias("node"))


def _least(level: str, weights: dict[int, float], key: Column) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[_draw(level, n, w, key) for n, w in sorted(weights.items())]))["node"]


def _sums(leaves: Sequence[Leaf], level: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in leaves:
        out[leaf[level]] = out.get(leaf[level], 0.0) + leaf[3]
    return out


def assign_shards(df: DataFrame, leaves: Sequence[Leaf], key: str = "doc_id", column: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with the int ``column`` added (a column of that name is replaced). No shuffle.

    Leaves of weight 0 take no rows; at least one weight must be above 0. A null key is hashed like the empty string, so
    rows without a key share one shard. Repeated rows go to the same shard; an empty table stays empty; other columns
    are never read. A row only computes the draws on its own path.
    """
    leaves = [leaf for leaf in leaves if leaf[3] > 0]
    if not leaves:
        raise ValueError("no leaf has a weight above 0")

    def below(level: int, name: str, parent: str) -> Column:
        out = None
        for p in sorted({x[level - 1] for x in leaves}):
            least = _least(name, _sums([x for x in leaves if x[level - 1] == p], level), F.col(key))
            out = F.when(F.col(parent) == p, least) if out is None else out.when(F.col(parent) == p, least)
        return out

    d = df.withColumn("__region", _least("region", _sums(leaves, 0), F.col(key)))
    d = d.withColumn("__rack", below(1, "rack", "__region"))
    return d.withColumn(column, below(2, "shard", "__rack").cast("int")).drop("__region", "__rack")


def number_slots(df: DataFrame, key: str, ties: list[str], shard: str = "shard", column: str = "slot", blocks: int = 64) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of hashed ``key`` and ``ties``.

    Each shard is numbered in ``blocks`` hash ranges, so a hot shard never meets in one task.
    """
    return running_total(df.withColumn("__key", hash60(F.col(key), *[F.col(c) for c in ties])), [shard], "__key", [key, *ties], F.lit(1), column, blocks).drop("__key")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 by the `key` law, with the shard they get once there are 41. Null text: size 16, crc null."""
    leaves = even_topology(40)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    docs = assign_shards(docs, leaves)
    kept = written(assign_shards(docs, grown_topology(leaves), column="grown_shard"), "op1-rows")
    out = number_slots(kept, "doc_id", ["text_crc32", "size"], blocks=n_blocks(spark, kept.count()))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op1_sharding": op1_sharding}
#: DuckDB has no CRC-32, so the query is tested against a brute-force version.
ORACLES: dict[str, str] = {}
