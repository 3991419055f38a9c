"""Near-duplicate embeddings: randomised-rotation binary codes decide which pairs need exact cosines.

A unit vector is rotated at random and kept as its signs, with the factor f = <o, code>: both are computed once for each
vector and stored beside it, once whatever the number of bands. <code, q> / f is an unbiased estimate of <o, q>; its error is below
EPSILON * sqrt(1 - f^2) / f / sqrt(D - 1) but for a probability that falls with exp(-EPSILON^2 / 2). Only pairs whose
estimate plus that bound reaches the threshold are computed in double precision, and only those at or above the threshold
are linked.

Pairs are looked for within buckets of code bits. The more vectors a label has, the more bits a bucket takes, so that
buckets stay near BLOCK rows; bands are added until a pair at the threshold misses all of them with a probability of
MISS. A bucket above BLOCK rows is cut into blocks and every pair of blocks is compared, none is left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, table, written
from ._graph import connected_components

THRESHOLD, BLOCK, MISS, EPSILON, MAX_BITS, SEED = 0.93, 1024, 1e-6, 5.0, 24, 20240501


@functools.lru_cache(maxsize=64)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine; made once a process."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bands_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Bands of ``bits`` signs that a pair at the threshold misses altogether with a probability of ``miss`` at most."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if bits == 0 else math.ceil(math.log(miss) / math.log(1 - same))


def _units(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a vector: node, grp, copies, bits, v, code, factor, signs (the bits of all bands, packed), keys (a number a band)."""
    for pdf in batches:
        for (dim, bits), d in pdf.groupby(["dim", "bits"]):
            dim, bits, bands = int(dim), int(bits), bands_for(int(bits))
            numbers = range(-(-bands * bits // dim))
            planes = np.concatenate([rotation(dim, i) for i in numbers])[: bands * bits] if bits else None
            for lo in range(0, len(d), 512):
                part = d.iloc[lo : lo + 512]
                units = _units(part["v"])
                code, factor = codes(units)
                signs = np.packbits(units @ planes.T > 0, axis=1) if bits else np.zeros((len(part), 0), dtype=np.uint8)
                keys = _keys(signs, bands, bits)
                out = part[["node", "grp", "copies", "bits", "v"]]
                yield out.assign(code=[c.tobytes() for c in code], factor=factor, signs=[x.tobytes() for x in signs], keys=list(keys))


def _keys(signs: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """Packed signs -> the key of every band."""
    apart = np.unpackbits(signs, axis=1, count=bands * bits).reshape(len(signs), bands, bits)
    return (apart * (1 << np.arange(bits, dtype=np.int32))).sum(axis=2, dtype=np.int32)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs of the rotated unit rows, eight to a byte; the factors <o, code>)."""
    turned = units @ rotation(units.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def linked_pairs(a: np.ndarray, b: np.ndarray, code: np.ndarray, factor: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of ``a``, which has codes and factors, and ``b`` whose cosine reaches the threshold: estimates first, exact after."""
    dim = a.shape[1]
    turned = (b @ rotation(dim).T).astype(np.float32)
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (signs @ turned.T) / (factor * math.sqrt(dim))[:, None]
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor / math.sqrt(max(1, dim - 1))
    i, j = np.nonzero(estimate + bound[:, None] + 1e-4 >= threshold)
    keep = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 65536):
        s = slice(lo, lo + 65536)
        keep[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return i[keep], j[keep]


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of one block, or of two blocks of a bucket. A pair counts in the first band whose key it shares."""
    pdf = pdf.sort_values("node", ignore_index=True)
    x, copies = _units(pdf["v"]), pdf["copies"].to_numpy()
    one, two, band, bits = (pdf[c].iloc[0] for c in ("one", "two", "band", "bits"))
    keys = _keys(_bytes(pdf["signs"]), bands_for(int(bits)), int(bits)) if band else None
    rows = np.arange(len(pdf))
    left, right = (rows, rows) if one == two else (rows[pdf["part"] == one], rows[pdf["part"] == two])
    links = np.zeros(len(pdf), dtype=np.int64)
    code, factor = _bytes(pdf["code"]), pdf["factor"].to_numpy()
    i, j = linked_pairs(x[left], x[right], code[left], factor[left]) if len(left) and len(right) else (rows[:0], rows[:0])
    i, j = left[i], right[j]
    if one == two:
        i, j = i[i < j], j[i < j]
    first = np.ones(len(i), dtype=bool)
    for b in range(band):
        first &= keys[i, b] != keys[j, b]
    np.add.at(links, i[first], copies[j[first]])
    np.add.at(links, j[first], copies[i[first]])
    root = _local_roots(len(pdf), i, j)
    out = pd.DataFrame({"node": pdf["node"], "links": links, "root": pdf["node"].to_numpy()[root]})
    return out[(links > 0) | (root != rows)]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a row of ``vectors``: id, n_links, component_id, kept.

    Rows with a null label, or a vector that is null, empty, zero or holds a null or non-finite component, link with
    nothing: n_links 0, component_id their own id, kept. Vectors of different lengths don't link. Equal rows and equal
    vectors are one class while pairs are looked for and count as linked copies. A null id is never a component's id
    unless all ids of the component are null. An empty table gives an empty result; other columns are not read.
    """
    v = F.col("v")
    base = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("g"), F.col(vector).alias("v"))
    kind = vectors.schema[vector].dataType.simpleString()  # as it is: doubles stay doubles
    fits = F.col("g").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = base.withColumn("grp", F.when(fits, F.concat_ws(":", F.col("g").cast("string"), F.size(v).cast("string"))))
    base = base.withColumn("node", F.when(fits, F.unhex(F.md5(F.concat_ws(",", F.col("grp"), F.to_json(v))))))
    rows = base.select("id", "node")
    classes = written(base.where("node IS NOT NULL").groupBy("node").agg(F.any_value("grp").alias("grp"), F.any_value("v").alias("v"), F.count("*").alias("copies")), "op7-classes")
    bits = F.greatest(F.lit(0), F.least(F.lit(MAX_BITS), F.ceil(F.log2(F.col("n") / float(BLOCK))))).cast("int")
    sized = classes.join(classes.groupBy("grp").agg(F.count("*").alias("n")), "grp").select("node", "grp", "copies", "v", bits.alias("bits"), F.size("v").alias("dim"))
    vectors = written(sized.mapInPandas(_coded, f"node binary, grp string, copies long, bits int, v {kind}, code binary, factor double, signs binary, keys array<int>"), "op7-vectors")
    bucket = ["grp", "band", "key"]
    in_bands = vectors.select("node", "grp", F.posexplode("keys").alias("band", "key"))
    # buckets are told by narrow rows; a vector that is alone in its bucket travels no further
    parts = in_bands.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").select(*bucket, F.ceil(F.col("n") / float(2 * BLOCK)).alias("parts"))
    d = in_bands.join(parts, bucket).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    d = d.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other")).drop("parts", "other")
    d = d.join(vectors.select("node", "copies", "bits", "v", "code", "factor", "signs"), "node")
    found = written(d.groupBy(*bucket, "one", "two").applyInPandas(_compare, "node binary, links long, root binary"), "op7-links")
    discard(vectors)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ranked = classes.select("node", "copies").join(links, "node", "left").join(roots, "node", "left").select("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    ranked = written(ranked, "op7-ranked")
    discard(classes)
    discard(found)
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id")).join(ranked, "node").groupBy("root").agg(F.min("id").alias("component"))
    by_node = ranked.join(least, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links, component and whether it stays, as ``near_duplicates`` states; vectors are compared within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES = {
    "op7_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.l > 0 AND b.l > 0 AND list_inner_product(a.e, b.e) / (a.l * b.l) >= CAST(0.93 AS DOUBLE)),
reach AS (
  SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.m, e.vec_id) AS component_id, e.vec_id = coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.x = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
}
