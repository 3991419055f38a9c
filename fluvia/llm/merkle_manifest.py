"""A Merkle manifest of a dataset: one hash tree a source, one tree of the sources' roots, a proof for every row.

Rows are numbered within their source by a distributed sort. Partitions fold their leaves into sparse forests: nodes keyed
by (source, level, index), in which a run of siblings of known number becomes its parent as soon as it is complete. What
stays open at a partition's borders is merged with that of its neighbours, eight at a time, until nothing is open. Merging
is associative, so any shape of the reduction gives the same tree. A row's proof lists the siblings on its way to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, numbered, table, written

#: Nodes in a run; levels below which a block of leaves is proved in one task; fragments merged at a time.
ARITY, BLOCK_LEVELS, FAN = 16, 3, 8
_NODES = "part long, grp string, n long, level int, idx long, digest string, open boolean"
_PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level over ``n`` leaves."""
    step = ARITY**level
    return (n + step - 1) // step


class Forest:
    """Open nodes of a fragment. ``add`` is the monoid's operation, node by node: the order of nodes doesn't matter."""

    def __init__(self) -> None:
        self.runs: dict[tuple[str, int, int, int], dict[int, str]] = {}

    def add(self, grp: str, n: int, level: int, idx: int, digest: str) -> Iterator[tuple[int, int, str]]:
        """Put in a node; yields the (level, index, digest) of all parents that this completes, up to the group's root."""
        while (least := width(n, level)) > 1:
            run = idx // ARITY
            seen = self.runs.setdefault((grp, n, level, run), {})
            seen[idx] = digest
            if len(seen) < min(ARITY, least - run * ARITY):
                return
            del self.runs[grp, n, level, run]
            level, idx, digest = level + 1, run, _sha("".join(seen[i] for i in sorted(seen)))
            yield level, idx, digest

    def open_nodes(self) -> Iterator[tuple[str, int, int, int, str]]:
        for (grp, n, level, _), seen in self.runs.items():
            for idx, digest in seen.items():
                yield grp, n, level, idx, digest


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "grp", "n", "level", "idx", "digest", "open"])


def _fold(low: int):
    """Nodes of whole parts, part by part: of those that are complete the ones of level ``low`` and up, and at a part's end what stayed open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, now = Forest(), None
        rest = lambda: [(now, *x, True) for x in forest.open_nodes()]
        for pdf in batches:
            out = []
            for part, grp, n, level, idx, digest in pdf[["part", "grp", "n", "level", "idx", "digest"]].itertuples(index=False, name=None):
                if part != now:
                    out += rest()
                    forest, now = Forest(), part
                if width(n, level) == 1:
                    out.append((part, grp, n, level, idx, digest, False))
                out += [(part, grp, n, *x, False) for x in forest.add(grp, n, level, idx, digest) if x[0] >= low or width(n, x[0]) == 1]
            yield _table(out)
        yield _table(rest())

    return run


def forest(leaves: DataFrame, low: int, label: str) -> list[DataFrame]:
    """Tables with all roots over the leaves (part, grp, n, idx, digest) and all nodes of level ``low`` and up but the leaves themselves.

    Rows with ``open`` are borders of parts, which a later table closes. They lie in two groups a part at most (those in
    between are whole), so that a part has some hundred open nodes. Each round merges FAN neighbouring parts.
    """
    rows = leaves.select("part", "grp", "n", F.lit(0).alias("level"), "idx", "digest")
    tables = [written(rows.repartition("part").sortWithinPartitions("part", "grp", "idx").mapInPandas(_fold(low), _NODES), label)]
    while not (still := tables[-1].where("open")).isEmpty():
        merged = still.withColumn("part", F.expr(f"part div {FAN}")).repartition("part").sortWithinPartitions("part", "grp", "level", "idx")
        tables.append(written(merged.mapInPandas(_fold(low), _NODES), label))
    return tables


def _closed(tables: list[DataFrame]) -> DataFrame:
    found = tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.path for t in tables])
    return found.where("NOT open").select("grp", "n", "level", "idx", "digest")


def above(nodes: DataFrame, low: int) -> DataFrame:
    """(grp, idx, levels): for every node of level ``low`` the siblings on its way to its group's root.

    ``nodes`` has all (grp, n, level, idx, digest) of level ``low`` and up. ``levels`` is an array of (level, left, right):
    the digests left and right of the way, concatenated; it is empty at a root. Each step of the way joins one run of
    at most ARITY digests.
    """
    runs = nodes.groupBy("grp", "level", F.expr(f"idx div {ARITY}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run_of"))
    steps = F.filter(F.sequence(F.lit(low), F.lit(15)), lambda at: F.col("n") > F.power(F.lit(float(ARITY)), at))  # those below the root
    way = nodes.where(F.col("level") == low).select("grp", "idx", F.explode_outer(steps).alias("level"))
    way = way.withColumn("at", F.expr(f"idx div cast(power({ARITY}, coalesce(level, {low}) - {low}) AS long)")).withColumn("run", F.expr(f"at div {ARITY}"))
    side = lambda keep: F.array_join(F.transform(F.filter("run_of", keep), lambda s: s["digest"]), "")
    met = way.join(runs, ["grp", "level", "run"], "left")
    step = F.when(F.col("level").isNotNull(), F.struct("level", side(lambda s: s["idx"] < F.col("at")).alias("left"), side(lambda s: s["idx"] > F.col("at")).alias("right")))
    return met.groupBy("grp", "idx").agg(F.array_sort(F.collect_list(step)).alias("levels"))


def _prove(rows: pa.Table, ways: pa.Table) -> pa.Table:
    """All proofs of one block: levels inside it are folded here, the rest of the way is the same for all its leaves."""
    rows = rows.sort_by("idx")
    n, (found,) = rows.column("n")[0].as_py(), ways.to_pylist()
    rest = [(s["left"], s["right"]) for s in [*(found["levels"] or []), *found["source_levels"]]]
    leaves = rows.column("leaf").to_pylist()
    levels = [leaves]
    while len(levels) <= BLOCK_LEVELS and width(n, len(levels) - 1) > 1:
        below = levels[-1]
        levels.append([_sha("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    proofs, folded = [], []
    for i, changed in enumerate(rows.column("tampered").to_pylist()):
        node, at, way = changed or leaves[i], i, []
        for level in levels[:-1]:
            run = at - at % ARITY
            way.append(("".join(level[run:at]), "".join(level[at + 1 : run + ARITY])))
            at //= ARITY
        way += rest
        for left, right in way:
            node = _sha(left + node + right)
        proofs.append(_sha("".join(left + right for left, right in way)))
        folded.append(node)
    same = [[found[c]] * len(leaves) for c in ("subroot", "root")]
    columns = [rows.column("doc_id"), rows.column("leaf"), *same, proofs, folded, [f == found["root"] for f in folded]]
    return pa.table(dict(zip(_PROOF, columns, strict=True)))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row a row of ``docs``.

    Null fields are hashed as such; null sources are a source, the first; null ids come first in their source and are not
    tampered with; repeated ids are ordered by leaf, and equal rows differ in their proofs only. An empty table gives an
    empty result; other columns are not read. Sources of any share of all rows are numbered and hashed in ranges, and
    proofs are made for 4,096 leaves at a time.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").isNotNull()
    low = F.translate("text", _UPPER, _UPPER.lower())
    grp = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # sorts like the source, null first
    rows = docs.select("doc_id", grp.alias("grp"), leaf(*fields, F.col("text")).alias("leaf"), F.when(changed, leaf(*fields, low)).alias("tampered"))
    placed = numbered(rows, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "op13-leaves")
    leaves = written(placed, "op13-numbered")
    discard(placed)

    trees = forest(leaves.withColumnRenamed("leaf", "digest"), BLOCK_LEVELS, "op13-nodes")
    nodes, top = _closed(trees), F.col("n") <= F.power(F.lit(float(ARITY)), F.col("level"))
    sources = numbered(nodes.where(top).select(F.col("grp").alias("source"), "digest"), [], [F.col("source")], "op13-subroots")
    sources = written(sources.withColumn("grp", F.lit("")), "op13-sources")
    crown = forest(sources, 0, "op13-crown")
    found = _closed(crown).where(top).select("digest").first()
    root = found[0] if found else ""

    upper = _closed(crown).where("level > 0").unionByName(sources.select("grp", "n", F.lit(0).alias("level"), "idx", "digest"))
    crown_ways = sources.join(above(upper, 0).select("idx", F.col("levels").alias("source_levels")), "idx").select(F.col("source").alias("grp"), F.col("digest").alias("subroot"), F.lit(root).alias("root"), "source_levels")
    block = F.expr(f"idx div {ARITY**BLOCK_LEVELS}").alias("block")
    blocks = leaves.select("grp", block).distinct().join(above(nodes.where(F.col("level") >= BLOCK_LEVELS), BLOCK_LEVELS).withColumnRenamed("idx", "block"), ["grp", "block"], "left")
    ways = written(blocks.join(crown_ways, "grp"), "op13-ways")
    types = {**dict.fromkeys(_PROOF, "string"), "doc_id": docs.schema["doc_id"].dataType.simpleString(), "verified": "boolean"}
    parts = leaves.select("*", block).groupBy("grp", "block").cogroup(ways.groupBy("grp", "block"))
    return parts.applyInArrow(_prove, ", ".join(f"{c} {t}" for c, t in types.items()))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with each row's proof checked against the tampered row where the id's crc32 says so."""
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
#: DuckDB has no CRC-32, and the depth of a tree follows its size: tested against a plain version.
ORACLES: dict[str, str] = {}
