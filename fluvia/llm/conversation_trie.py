"""A prefix trie over conversations, as succinct level-order tries of prefix shards.

A prefix of d turns is known by a 128-bit key: the exclusive or of hashes of (place, turn), a distributed prefix sum over
each conversation. Conversations are pre-aggregated to nodes. Nodes with many members form the upper levels, of a size
that is bounded by parameters; what hangs below them is dealt out by its topmost prefix. Each shard is a LOUDS bit vector
with label arrays in level order, and its sums go from the last level to the first. The shards' tops are then added to the
upper levels, a trie of the same kind. A node of one member only begins a tail without branches: its first node is a leaf
of a trie, and the others follow from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, numbered, table, written
from .mixing import token_count

#: Members of a node beyond which it is an upper one, at least; upper nodes at most; nodes of a shard; turns summed in one
#: window; characters of a list of ids in one row.
LEAST_UPPER, MAX_UPPER, SHARD_NODES, BLOCK, CHUNK = 256, 100_000, 50_000, 4096, 16_384
_LABELS = ["k1", "k2", "conv_id", "depth", "n_convs", "words", "n_ends", "an_end", "below_children", "below_leaves", "below_saved"]
_TOPS = ["p1", "p2"]
_TRIE = "shard long, n_nodes long, bits binary, " + ", ".join(f"{c} binary" for c in _LABELS + _TOPS)
_ROLLED = ["k1", "k2", "p1", "p2", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "an_end"]


class Louds:
    """Navigation of a level-order bit vector: node 0 stands for what is above, nodes are numbered in level order.

    Each node writes a one for every child and then a zero, so that the j-th one belongs to node j, and the zeros before
    it are the number of its parent.
    """

    def __init__(self, bits: np.ndarray) -> None:
        zeros = np.flatnonzero(bits == 0)
        ones = np.flatnonzero(bits)
        self.degree = np.diff(zeros, prepend=-1) - 1
        self.parent = np.concatenate([[0], ones - np.arange(len(ones))])
        self.first_child = np.concatenate([[0], np.cumsum(self.degree)[:-1]]) + 1

    def levels(self) -> list[tuple[int, int]]:
        """(first node, node after the last) of every level below node 0."""
        found, low, high = [], 1, 1 + int(self.degree[0])
        while low < high:
            found.append((low, high))
            low, high = high, high + int(self.degree[low:high].sum())
        return found


def build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's nodes (_LABELS, p1, p2) as one row: bits, and arrays of what each node says, in level order.

    Nodes without their parent in the shard are its tops; siblings are in the order of their keys.
    """
    names = pd.DataFrame({"p1": pdf["k1"], "p2": pdf["k2"], "row": np.arange(len(pdf))})
    up = pdf[["p1", "p2"]].merge(names, on=["p1", "p2"], how="left")["row"].fillna(-1).to_numpy(dtype=np.int64)
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    at = np.zeros(len(pdf) + 1, dtype=np.int64)  # place of each row; the last stands for node 0
    by_parent = np.argsort(up, kind="stable")
    starts = np.searchsorted(up[by_parent], np.arange(-1, len(pdf) + 1))
    level, order = by_parent[: starts[1]], []
    placed = 0
    while len(level):
        level = level[np.lexsort((k2[level], k1[level], at[up[level]]))]
        at[level] = placed + 1 + np.arange(len(level))
        placed += len(level)
        order.append(level)
        low, high = starts[level + 1], starts[level + 2]
        size = high - low
        level = by_parent[np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    order = np.concatenate(order)
    degree = np.bincount(at[up], minlength=len(pdf) + 1)
    bits = np.ones(2 * len(pdf) + 1, dtype=np.uint8)
    bits[np.cumsum(degree) + np.arange(len(degree))] = 0
    tops = slice(0, int(degree[0]))
    columns = {c: [pdf[c].to_numpy(dtype=np.int64)[order].tobytes()] for c in _LABELS} | {c: [pdf[c].to_numpy(dtype=np.int64)[order][tops].tobytes()] for c in _TOPS}
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_nodes": [len(pdf)], "bits": [np.packbits(bits).tobytes()], **columns})


def decoded(row: dict) -> tuple[Louds, dict[str, np.ndarray]]:
    """A row of ``tries`` as its navigation and arrays; entry j - 1 of an array is node j's."""
    bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=2 * int(row["n_nodes"]) + 1)
    return Louds(bits), {c: np.frombuffer(row[c], dtype=np.int64) for c in _LABELS + _TOPS}


def _rolled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.to_dict("records"):
            trie, has = decoded(row)
            children = trie.degree.copy()
            children[1:] += has["below_children"]
            leaves = np.concatenate([[0], has["below_leaves"] + (children[1:] == 0)])
            saved = np.concatenate([[0], has["below_saved"] + (has["n_convs"] - 1) * has["words"]])
            for low, high in reversed(trie.levels()[1:]):
                np.add.at(leaves, trie.parent[low:high], leaves[low:high])
                np.add.at(saved, trie.parent[low:high], saved[low:high])
            top, above = int(trie.degree[0]), trie.parent[1:] - 1
            known = np.arange(len(above)) >= top
            out = {c: has[c] for c in ("k1", "k2", "conv_id", "depth", "n_convs", "n_ends", "an_end")}
            for c, k in (("p1", "k1"), ("p2", "k2")):
                out[c] = np.concatenate([has[c], has[k][above[top:]]])
            out["parent_conv_id"] = pd.array(np.where(known, has["conv_id"][above], 0), dtype="Int64")
            out["parent_conv_id"][~known] = pd.NA
            yield pd.DataFrame(out | {"n_children": children[1:], "n_leaves": leaves[1:], "saved_tokens": saved[1:]})[_ROLLED]


def tries(nodes: DataFrame) -> DataFrame:
    """One row a value of ``shard``: the LOUDS trie of its nodes (_LABELS, p1, p2)."""
    return nodes.select("shard", *_LABELS, *_TOPS).groupBy("shard").applyInPandas(build, _TRIE)


def rollups(found: DataFrame) -> DataFrame:
    """The nodes of ``tries`` with their sums; parent_conv_id is null for the tops."""
    return found.mapInPandas(_rolled, ", ".join(f"{c} long" for c in _ROLLED))


def prefixes(turns: DataFrame) -> DataFrame:
    """Keys of all prefixes from (conv_id, depth, h1, h2, ...), depths gapless from 1: adds k1, k2 and the parent's p1, p2.

    Long conversations are summed in blocks of BLOCK turns.
    """
    d = turns.withColumn("z1", F.xxhash64("depth", "h1")).withColumn("z2", F.xxhash64("h2", "depth")).withColumn("block", F.expr(f"depth div {BLOCK}"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    starts = d.groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    starts = starts.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(before), zero).alias(f"s{i}") for i in (1, 2)])
    d = d.join(starts, ["conv_id", "block"])
    for i in (1, 2):
        d = d.withColumn(f"k{i}", F.bit_xor(f"z{i}").over(inside).bitwiseXOR(F.col(f"s{i}"))).withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")))
    return d.drop("block", "z1", "z2", "s1", "s2", "h1", "h2")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (k1, k2, conv_id) of one range: digests of keys that lie inside it, texts of those that may go on elsewhere."""
    out: list[tuple] = []
    key, ids, size, is_open = None, [], 0, True  # the first key may have begun before

    def settle(is_open: bool) -> None:
        if ids:
            text = ",".join(map(str, ids))
            out.append((*key, ids[0], text if is_open else None, None if is_open else hashlib.sha256(text.encode()).hexdigest()))

    for pdf in batches:
        for k1, k2, conv in pdf[["k1", "k2", "conv_id"]].itertuples(index=False, name=None):
            if (k1, k2) != key:
                if key is not None:
                    settle(is_open)
                    is_open = False
                key, ids, size = (k1, k2), [], 0
            elif size > CHUNK:
                is_open = True
                settle(True)
                ids, size = [], 0
            ids.append(conv)
            size += 8
        yield pd.DataFrame(out, columns=["k1", "k2", "first", "ids", "digest"])
        out.clear()
    if key is not None:
        settle(True)
    yield pd.DataFrame(out, columns=["k1", "k2", "first", "ids", "digest"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of one key in order, hashed as they come."""
    key, state = None, None
    for pdf in batches:
        out = []
        for k1, k2, ids in pdf[["k1", "k2", "ids"]].itertuples(index=False, name=None):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["k1", "k2", "digest"])
    yield pd.DataFrame([(*key, state.hexdigest())] if key is not None else [], columns=["k1", "k2", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, digest): SHA-256 of the ascending, comma-joined conv_ids of every key.

    Ids are sorted by ranges. A key inside a range is hashed there; for the others only texts of CHUNK characters move,
    to one task a key, which hashes them one after the other, as SHA-256 demands.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.select("k1", "k2", "conv_id").repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    found = written(ranged.mapInPandas(_digests, "k1 long, k2 long, first long, ids string, digest string"), "op11-ends")
    rest = found.where("digest IS NULL").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInPandas(_joined, "k1 long, k2 long, digest string")
    return found.where("digest IS NOT NULL").select("k1", "k2", "digest").unionByName(rest)


def trie(turns: DataFrame, convs: DataFrame, least_upper: int = LEAST_UPPER, max_upper: int = MAX_UPPER) -> DataFrame:
    """All nodes from (conv_id, depth, h1, h2, words, last) and (conv_id, size), one row a conversation, size its number of turns.

    Result: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations
    without turns are members of the root only; without any conversation there is no node. Copies are pre-aggregated. A
    shard holds the nodes below some light prefixes, of at most the limit's members each; there are rows / limit upper
    nodes at most, as each turn counts for one node, so that broadcasting them and holding them in one task is bounded.
    """
    spark = turns.sparkSession
    paths = written(prefixes(turns), "op11-paths")
    last = F.when(F.col("last"), F.col("conv_id"))
    same = {c: F.max(c).alias(c) for c in ("depth", "p1", "p2", "words")}
    nodes = paths.groupBy("k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same.values(), F.count(last).alias("n_ends"), F.min(last).alias("an_end"))
    nodes = written(nodes.withColumn("an_end", F.coalesce("an_end", F.lit(0))), "op11-nodes")
    limit = max(least_upper, paths.count() // max_upper)
    zero = F.lit(0).cast("long")
    bare = F.when(F.col("size") == 0, F.col("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count(bare).alias("n_ends"), F.coalesce(F.min(bare), zero).alias("an_end")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("depth"), F.lit(-1).cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"), zero.alias("words"), "n_ends", "an_end")
    upper = written(nodes.where(F.col("n_convs") > limit).unionByName(root), "op11-upper")

    # what a conversation's lower nodes hang below, and where its tail begins
    light = paths.join(F.broadcast(upper.select("k1", "k2")), ["k1", "k2"], "left_anti")
    tops = light.groupBy("conv_id").agg(F.min_by(F.struct("k1", "k2"), "depth").alias("top"))
    single = nodes.where("n_convs = 1")
    columns = [c for c in nodes.columns if c != "conv_id"]
    heads = written(single.groupBy("conv_id").agg(F.min_by(F.struct(*columns), "depth").alias("h")).select("conv_id", *[f"h.{c}" for c in columns]), "op11-heads")
    lower = nodes.where((F.col("n_convs") > 1) & (F.col("n_convs") <= limit)).unionByName(heads.select(nodes.columns))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // SHARD_NODES)
    tail = F.when(F.col("n_convs") == 1, 1 - F.col("n_ends")).otherwise(0).cast("long")  # goes on with one leaf at its end
    below = {"below_children": tail, "below_leaves": tail, "below_saved": zero}
    dealt = lower.join(tops, "conv_id").withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)).cast("long")).withColumns(below)
    found = written(tries(dealt), "op11-tries")
    rows = written(rollups(found), "op11-rows")

    sums = rows.where("parent_conv_id IS NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    sums = sums.agg(F.count("*").alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
    crown = upper.join(sums, ["k1", "k2"], "left").fillna(0, ["below_children", "below_leaves", "below_saved"])
    crown = rollups(tries(crown.withColumn("shard", F.lit(-1).cast("long"))))
    over = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("over"))
    rows = rows.join(F.broadcast(over), ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).select(_ROLLED)
    tails = single.join(heads.select("k1", "k2"), ["k1", "k2"], "left_anti").withColumns({"parent_conv_id": F.col("conv_id"), "n_children": F.lit(1).cast("long") - F.col("n_ends"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero})

    ends = paths.where("last").select("k1", "k2", "conv_id").unionByName(convs.where("size = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    shared = rows.unionByName(crown).join(end_digests(ends), ["k1", "k2"], "left")
    every = shared.unionByName(tails.select(_ROLLED), allowMissingColumns=True)
    digest = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("an_end").cast("string"), 256)).otherwise(F.col("digest"))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The inputs of ``trie`` with shared beginnings: each conversation c starts with the first h turns of conversation c - c % family.

    h is the crc32 of c's decimal text, modulo ``most``. Turns are ordered by number (null first), equal numbers by a
    hash of role and text. Rows without a conv_id belong to no conversation and are left out; null roles and texts are
    empty ones. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = [F.xxhash64(F.lit(i), role, text).alias(f"h{i}") for i in (1, 2)]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *hashed, token_count(text).alias("words"))
    placed = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")], "op11-turns")
    placed_rows = written(placed.drop("turn", "part"), "op11-numbered")
    discard(placed)
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    known = placed_rows.where("idx = 0").select("conv_id", "n", first.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = known.where(F.col("base") == F.col("conv_id")).select("base", F.col("n").alias("base_n"))
    convs = known.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("size", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "op11-convs")
    columns = ["conv_id", "depth", "h1", "h2", "words", "size"]
    begun = placed_rows.where((F.col("idx") < most - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "idx", "h1", "h2", "words")
    begun = begun.join(convs, "base").where("idx < h").withColumn("depth", F.col("idx") + 1).select(columns)
    # long conversations meet their one row in blocks
    spread = convs.where("n > h").select("conv_id", "h", "k", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    own = placed_rows.withColumn("block", F.expr(f"idx div {BLOCK}")).join(spread, ["conv_id", "block"]).where("idx >= h")
    own = own.withColumn("depth", F.col("k") + F.col("idx") - F.col("h") + 1).select(columns)
    turns = begun.unionByName(own).withColumn("last", F.col("depth") == F.col("size")).drop("size")
    return turns, convs.select("conv_id", "size")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row a node. An empty table gives no node."""
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_conversation_trie": op11_conversation_trie}
#: DuckDB has no CRC-32: tested against a plain version.
ORACLES: dict[str, str] = {}
