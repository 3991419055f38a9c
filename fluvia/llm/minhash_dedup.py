"""MinHash near-dedup with DartMinHash signatures.

Darts fall on (element, weight, rank): a Poisson process of intensity 1 that is hashed from the element alone, so that
all texts see the same darts. A dart hits a text if the element is in it and the dart's weight is below the element's
weight there; each dart has a hashed coordinate, and the earliest hit (least rank) of each coordinate is the signature.
Two texts agree in a coordinate with the probability of their weighted Jaccard similarity; the elements are a text's
shingles and their weights its counts of them. A text of any length costs
about COORDS * ln(COORDS) darts, plus a fraction for each element.

Signatures are cut into bands and texts that share a band meet in a bucket. Equal texts are one class before that. In
each bucket, members are first paired with a hashed centre. What shares a bucket and is still in different components
after that is compared by differences from a core, without the pairs of a bucket (``_leftover_pairs``): an exact filter
that a linked pair cannot fail. Every pair is confirmed by the exact weighted Jaccard similarity of its counted shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bitmap import bitmap, in_bitmap
from ._common import discard, table, written
from ._graph import connected_components
from ._text import chunks, mix64, text_words, windows

WIDTH, THRESHOLD, COORDS, ROWS, BANDS, ORDERS, FILTER_BITS = 5, 0.8, 256, 6, 42, 8, 23
#: Sets of sizes m and n reach the threshold if at most SPARE * (m + n) elements are in one of them only.
SPARE, EPS = (1 - THRESHOLD) / (1 + THRESHOLD), 1e-6
_U = np.uint64


def shingles(texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, number of its text). Words are what white space separates, lower-cased.

    A text of fewer words is one shingle; a text without words has none.
    """
    words, counts = text_words(texts)
    found = [windows(words, counts, width)]
    for k in range(1, width):
        h, owner = windows(words, counts, k)
        whole = counts[owner] == k
        found.append((h[whole], owner[whole]))
    h, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, owner))
    return h[order], owner[order]


def counted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, number of its text, how often it is there), from ``shingles``: the weighted set of each text."""
    if not len(h):
        return h, owner, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return h[first], owner[first], np.diff(np.append(first, len(h))).astype(float)


def occurrences(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``shingles`` with a name of its own for the second, third, ... occurrence in a text.

    The sets of these names have the Jaccard similarity of the counted shingles: the sum of the lesser counts over the
    sum of the greater ones.
    """
    if not len(h):
        return h
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    at = np.arange(len(h))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
    return np.where(nth > 0, mix64(h + nth * _U(0xD1342543DE82EF95)), h)


@functools.lru_cache(maxsize=64)
def _poisson_cdf(mean: float) -> np.ndarray:
    """The distribution of the number of darts in a cell of that area; by logarithms, as large cells underflow."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])))


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, coords: int = COORDS, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, coords) dart numbers; a row without elements is 0. ``weights``: above 0, by (element, owner); default 1.

    Ranks are taken in cells that double in width, and each weight region in cells that double too; texts leave as soon
    as all their coordinates are hit. Repeated elements of weight 1 throw the same darts and change nothing.
    """
    sig, open_ = np.zeros(n * coords, dtype=_U), np.ones(n * coords, dtype=bool)
    weights = np.ones(len(elements)) if weights is None else weights
    tops = [1.0]
    while len(weights) and tops[-1] < weights.max():
        tops.append(tops[-1] * 2)
    left = np.bincount(owner, minlength=n) > 0
    lo, hi, cell = 0.0, 0.25, 0
    while left.any():
        active = left[owner]
        e, o, w = elements[active], owner[active], weights[active]
        found = []
        for k, top in enumerate(tops):
            floor = 0.0 if k == 0 else tops[k - 1]
            inside = w > floor
            if not inside.any():
                continue  # heavy texts are done early, so that cells of theirs never grow large
            region = mix64(e[inside] ^ mix64(np.array([cell * 1000 + k + 1], dtype=_U)))
            cdf = _poisson_cdf((hi - lo) * (top - floor))
            u = (mix64(region) >> _U(11)).astype(np.float64) * 2.0**-53
            count = np.searchsorted(cdf, u, side="right")
            at = np.repeat(np.arange(len(region)), count)
            nth = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)).astype(_U)
            dart = mix64(region[at] + (nth + _U(1)) * _U(0x9E3779B97F4A7C15))
            rank = (mix64(dart ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(11)).astype(np.float64)
            hit = np.ones(len(dart), dtype=bool)
            if k or len(tops) > 1:
                height = (mix64(dart ^ _U(0x3C3C3C3C3C3C3C3C)) >> _U(11)).astype(np.float64) * 2.0**-53
                hit = floor + height * (top - floor) < w[inside][at]
            found.append((rank[hit], (o[inside][at] * coords + (mix64(dart ^ _U(0x5BD1E995)) % _U(coords)).astype(np.int64))[hit], dart[hit]))
        rank, slot, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        fresh = open_[slot]
        rank, slot, dart = rank[fresh], slot[fresh], dart[fresh]
        last_first = np.argsort(-rank, kind="stable")
        sig[slot[last_first]] = dart[last_first]  # of several, the last written stays: the earliest dart
        open_[slot] = False
        left &= open_.reshape(n, coords).any(axis=1)
        lo, hi, cell = hi, hi * 2, cell + 1
    return sig.reshape(n, coords)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, text -> node and band keys; texts without words give no row."""
    for pdf in chunks(batches, "text"):
        h, owner, weights = counted(*shingles(pdf["text"]))
        sig = dart_signatures(h, owner, len(pdf), weights=weights)
        has = np.bincount(owner, minlength=len(pdf)) > 0
        keys = np.zeros((len(pdf), BANDS), dtype=_U)
        for b in range(BANDS):
            k = np.full(len(pdf), b + 1, dtype=_U)
            for r in range(ROWS):
                k = mix64(k * _U(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
            keys[:, b] = k
        yield pd.DataFrame({"node": pdf["node"].to_numpy(), "keys": list(keys.view(np.int64))})[has]


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, text -> node and the set of its shingles' occurrences."""
    for pdf in chunks(batches, "text"):
        h, owner = shingles(pdf["text"])
        h = occurrences(h, owner)
        cuts = np.searchsorted(owner, np.arange(1, len(pdf)))
        yield pd.DataFrame({"node": pdf["node"].to_numpy(), "grams": [np.unique(x).view(np.int64) for x in np.split(h, cuts)]})


def text_node(text: Column) -> Column:
    """The class of a text: equal texts share it. Null stays null."""
    return F.unhex(F.md5(text))


def _present(words: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[in_bitmap(words, pdf["h"].to_numpy().view(_U)), ["node", "text"]]

    return run


def _gram_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, grams): the shingle set of each of ``nodes``, a written table."""
    ids = written(nodes.distinct(), "op10-ids")
    words = bitmap(ids.select(F.xxhash64("node").alias("h")), "h", FILTER_BITS)
    near = docs.withColumn("h", F.xxhash64("node")).mapInPandas(_present(words), "node binary, text string")
    texts = near.join(ids, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    return written(texts.mapInPandas(_grams, "node binary, grams array<long>"), "op10-grams")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose counted shingles reach the threshold."""
    sets = _gram_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs)
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    common = joined.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    out = written(common.where(F.col("c") >= THRESHOLD * (F.col("n") - F.col("c")) - 1e-9).select("a", "b"), "op10-links")
    discard(sets)
    return out


def _centred(members: DataFrame) -> DataFrame:
    """(key, node, centre): each member of a bucket with a hashed centre of it; ORDERS different orders over all buckets."""
    order = F.pmod(F.col("key"), F.lit(ORDERS))
    centre = F.min(F.struct(F.xxhash64("node", order).alias("h"), F.col("node").alias("centre")))
    centres = members.groupBy("key").agg(F.count("*").alias("n"), centre.alias("c")).where("n > 1").select("key", F.col("c.centre").alias("centre"))
    return members.join(centres, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("node != centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) for the texts that link with another text; node is ``text_node``, root the least node of the group.

    Null texts and texts without words link with nothing. An empty table gives an empty result.
    """
    base = docs.select(text_node(F.col(text)).alias("node"), F.col(text).alias("text")).where("text IS NOT NULL")
    signed = written(base.mapInPandas(_sign, "node binary, keys array<long>"), "op10-signatures")
    once = signed.dropDuplicates(["node"])
    shared = written(_centred(once.select("node", F.explode("keys").alias("key"))), "op10-buckets")
    stars = written(_pairs(shared), "op10-pairs")
    groups = written(connected_components(_confirmed(stars, base)), "op10-groups")
    rest = written(_leftover_pairs(_apart(shared, groups), base).join(stars, ["a", "b"], "left_anti"), "op10-pairs")
    if rest.isEmpty():
        return groups
    return connected_components(_as_edges(groups).unionByName(_confirmed(rest, base)))


def _leftover_pairs(apart: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs of ``apart`` (key, node, root) that link all components that links between its nodes connect; few others.

    Components whose buckets hang together are a cluster, and shingles of more than half of its texts are its core. A text is its
    difference from the core: what it has beyond that and what it lacks. Where the differences of x and y have a and b
    elements, o of them common, a + b - 2 o shingles are in one of the texts only. With the weight w = a - SPARE * size,
    x and y are linked if and only if o >= (w(x) + w(y)) / 2. So there are two kinds of links:

    - w(x) + w(y) <= 0: no common element is needed. Then both are linked with the cluster's lightest text, too.
    - Else they have that many common elements, and the heavier one is not linked with the lightest text for its weight
      alone. In an order that both obey, rare elements first, they share one of the first a - o + 1 and b - o + 1, and behind
      the first shared one there is room for the others. Differences of many texts of one cluster have mostly rare elements.
    """
    roots = apart.groupBy("key", "root").count()
    centres = roots.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("centre"))  # mostly the same in all buckets of a cluster
    clusters = connected_components(_pairs(roots.join(centres, "key").select(F.col("root").alias("node"), "centre")))
    clusters = clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    sets = _gram_sets(apart.select("node"), docs)
    placed = written(apart.select("node", "root").distinct().join(clusters, "root").join(sets, "node"), "op10-clusters")
    discard(sets)
    counts = placed.select("cluster", F.explode("grams").alias("h")).groupBy("cluster", "h").count().where("count > 1")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"))
    cores = counts.join(sizes, "cluster").where("2 * count > n").groupBy("cluster").agg(F.collect_list("h").alias("core"))
    core = F.coalesce("core", F.array().cast("array<long>"))
    differences = placed.join(cores, "cluster", "left").withColumn("differs", F.concat(F.array_except("grams", core), F.array_except(core, "grams")))
    texts = differences.select("cluster", "node", "root", "differs", F.size("differs").alias("a"), (F.size("differs") - SPARE * F.size("grams")).alias("w"))
    texts = written(texts, "op10-differences")
    discard(placed)

    light = texts.groupBy("cluster").agg(F.min(F.struct("w", "node", "root")).alias("light"))
    texts_ = texts.join(light, "cluster").withColumn("heavy", F.col("w") + F.col("light.w") > EPS)
    stars = texts_.where("NOT heavy AND root != light.root").select("node", F.col("light.node").alias("centre"))
    least = texts_.where("heavy").groupBy("cluster").agg(F.min("w").alias("least"))  # none: all that can be linked are stars
    elements = texts_.join(least, "cluster").select("cluster", "node", "root", "a", "w", "heavy", "least", F.col("light.w").alias("lightest"), F.explode("differs").alias("h"))
    often = texts.select("cluster", F.explode("differs").alias("h")).groupBy("cluster", "h").agg(F.count("*").alias("f")).where("f > 1")
    mine = Window.partitionBy("node")
    at = F.col("a") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("f", "h"))  # those of one text only come first
    needed = lambda other: F.greatest(F.lit(1), F.ceil((F.col("w") + other) / 2 - EPS))
    ranked = elements.join(often, ["cluster", "h"]).withColumn("at", at)
    ranked = ranked.withColumn("low", F.col("at") <= F.col("a") - needed(F.greatest("least", "w")) + 1)  # as the lighter one
    ranked = ranked.withColumn("high", F.col("heavy") & (F.col("at") <= F.col("a") - needed(F.col("lightest")) + 1))
    firsts = written(ranked.where("low OR high").select("cluster", "h", "node", "root", "a", "w", "at", "low", "high"), "op10-firsts")
    x, y = firsts.where("high").alias("x"), firsts.where("low").alias("y")
    heavier = F.struct("x.w", "x.node") > F.struct("y.w", "y.node")
    room = 1 + F.least(F.col("x.a") - F.col("x.at"), F.col("y.a") - F.col("y.at")) >= (F.col("x.w") + F.col("y.w")) / 2 - EPS
    same = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.h") == F.col("y.h"))
    met = x.join(y, same & (F.col("x.root") != F.col("y.root")) & heavier & room)
    return _pairs(stars.unionByName(met.select(F.col("x.node").alias("node"), F.col("y.node").alias("centre"))))


def _apart(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, node, root) of the buckets whose members lie in more than one component."""
    placed = shared.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return written(placed.join(mixed, "key"), "op10-open")


def _as_edges(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, class_id (least id of equal texts), group_id (least id of its near-duplicate group), kept.

    A document whose text is null or has no words is a group of its own (null, empty and blank texts are never
    duplicates). kept marks the documents whose id is their group's least; repeated rows of that id are all marked. Null
    ids are never least unless all ids of the group are null. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text).rlike(r"(?U)\S"), text_node(F.col(text))).alias("node"))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("class_id"))
    placed = written(classes.join(near_duplicate_groups(docs, text), "node", "left").select("node", "class_id", F.coalesce("root", "node").alias("root")), "op10-classes")
    groups = placed.groupBy("root").agg(F.min("class_id").alias("group_id"))
    by_node = placed.join(groups, "root").select("node", "class_id", "group_id")
    out = rows.join(by_node, "node", "left")
    own = F.col("node").isNull()
    group = F.when(own, F.col("id")).otherwise(F.col("group_id"))
    return out.select(F.col("id").alias(id_col), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), group.alias("group_id"), F.col("id").eqNullSafe(group).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group: a row with its least id, repeated rows once."""
    found = near_duplicates(docs, id_col, text).where("kept").select(F.col(id_col).alias("__id")).distinct()
    kept = docs.join(found, docs[id_col].eqNullSafe(found["__id"]), "left_semi")
    blank = kept.where(~F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False)))
    worded = kept.where(F.col(text).rlike(r"(?U)\S")).withColumn("__node", text_node(F.col(text)))
    return worded.dropDuplicates([id_col, "__node"]).drop("__node").unionByName(blank)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
ORACLES: dict[str, str] = {}
