"""Quality: documents are ranked by Bradley-Terry scores, and a quantile of the scores divides good from bad.

Every text is described by rates of characters, repeats and words. A pair of a better and a worse labelled document says
that the better one's score is higher, with the probability of a logistic function of the difference. The score is linear
in the features, so that the model is a logistic regression on differences of features without a constant. The scores'
quantile at the share of bad documents is where the probability is one half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, hash60, numbered, table, written
from ._text import arrow_chunks, text_words

# Parameters: pairs that each labelled document is in at least; ridge.
PAIRS, RIDGE = 4, 1.0
FEATURES = ["upper", "digit", "stop", "shout", "bar", "symbol", "line", "beyond", "word_length", "distinct", "repeat", "size"]
#: Of a byte of UTF-8: 1 upper, 2 lower, 3 digit, 4 stop, 5 exclamation, 6 bar, 7 other symbol, 8 line feed, 9 other blank,
#: 10 part of a character beyond ASCII.
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[:33], _CLASS[128:] = 9, 10
for _n, _chars in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "abcdefghijklmnopqrstuvwxyz"), (3, "0123456789"), (4, ".,;:?'\"-()"), (5, "!"), (6, "|"), (8, "\n")):
    _CLASS[[ord(c) for c in _chars]] = _n


@dataclass
class Model:
    weights: list[float]
    threshold: float


def _repeats(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, words equal to the one before them) of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((words, owner))
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[order][first], minlength=len(counts)), np.bincount(owner[again], minlength=len(counts))


def describe(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text. Rates enter by their square roots, as small ones tell most; a null or empty text has zeros."""
    column = texts.cast(pa.large_string()).fill_null("")
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(owner * 11 + _CLASS[raw[ends[0] : ends[-1]]], minlength=11 * len(size)).reshape(-1, 11).astype(float)
    hashed, words = text_words(column)
    distinct, again = _repeats(hashed, words)
    solid = np.maximum(1.0, size - counts[:, 8] - counts[:, 9])
    letters = np.maximum(1.0, counts[:, 1] + counts[:, 2])
    n = np.maximum(1, words)
    rates = [counts[:, 1] / letters, *[counts[:, k] / solid for k in (3, 4, 5, 6, 7)], counts[:, 8] / n, counts[:, 10] / solid]
    return np.column_stack([*[np.sqrt(r) for r in rates], np.log1p(solid / n) * (words > 0), np.log1p(distinct) / np.log1p(n) * (words > 0), np.sqrt(again / n), np.log1p(words)])


def _described(keep: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [keep, *FEATURES]
        for batch in arrow_chunks(batches, "text", 4_000_000):
            found = describe(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(keep).cast(kind), *[pa.array(found[:, i]) for i in range(len(FEATURES))]], names=names)

    return run


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the FEATURES): one row a row of ``docs``, from whole texts. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(id_col, F.col(text).alias("text")).mapInArrow(_described(id_col, to_arrow_type(kind)), schema)


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> np.ndarray:
    """Bradley-Terry weights: Newton steps on the logistic loss of differences good - bad; each row is in ``pairs`` pairs at least."""
    draw = np.random.default_rng(0)
    left = np.concatenate([np.repeat(np.arange(len(good)), pairs), draw.integers(0, len(good), pairs * len(bad))])
    right = np.concatenate([draw.integers(0, len(bad), pairs * len(good)), np.repeat(np.arange(len(bad)), pairs)])
    x = good[left] - bad[right]
    return newton(lambda w: newton_sums(x, w), x.shape[1], ridge)


def newton_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and curvature of the logistic loss of differences, as one row; rows of parts add up."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (1 - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], k: int, ridge: float = RIDGE) -> np.ndarray:
    """``k`` weights of least loss; ``sums`` gives ``newton_sums`` over all pairs."""
    w = np.zeros(k)
    for _ in range(100):
        found = sums(w)
        step = np.linalg.solve(found[k:].reshape(k, k) + ridge * np.eye(k), found[:k] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quantile(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """Where ``share`` of all weight lies below: half-way between the scores beside that place."""
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(weights[order]) / weights.sum()
    at = min(int(np.searchsorted(below, share - 1e-9)), len(order) - 1)
    return float((scores[order[at]] + scores[order[min(at + 1, len(order) - 1)]]) / 2)


def fit(x: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> Model:
    """Rank by pairs and set the threshold; ``sizes`` has the labelled documents of each label that the rows stand for.

    Features are scaled to unit spread for the fit. With one label only, or none, all weights are 0 and every text gets
    the share of good documents (one half without any).
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        share = min(0.99, max(0.01, float(np.mean(y)))) if len(y) else 0.5
        return Model([0.0] * x.shape[1], -float(np.log(share / (1 - share))))
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    w = fit_pairs(good / scale, bad / scale) / scale
    weights = np.where(y == 1, sizes[1] / len(good), sizes[0] / len(bad))
    return Model([float(v) for v in w], quantile(x @ w, weights, sizes[0] / (sizes[0] + sizes[1])))


def _sums(w: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(w) * (len(w) + 1))
        for pdf in batches:
            total += newton_sums(pdf[FEATURES].to_numpy(), w)
        yield pd.DataFrame({"sums": [total]})

    return run


def drawn_pairs(rows: DataFrame, sizes: dict[int, int], scale: list[float]) -> DataFrame:
    """(the FEATURES): scaled differences good - bad, a written table. Each of ``rows`` (doc_id, quality, FEATURES) draws PAIRS of the other label.

    ``sizes`` are the rows of each label; partners are drawn by hashed places in the label, so that no task holds a label.
    """
    order = [hash60(F.lit("pairs"), F.col("doc_id")), *[F.col(f) for f in FEATURES]]
    placed = numbered(rows, ["quality"], order, "op12-numbered")
    others = F.when(F.col("quality") == 1, sizes[0]).otherwise(sizes[1])
    draws = placed.select("quality", "idx", *FEATURES, F.explode(F.sequence(F.lit(1), F.lit(PAIRS))).alias("draw"))
    draws = draws.withColumn("at", F.pmod(hash60(F.lit("draw"), F.col("draw"), F.col("quality"), F.col("idx")), others))
    partners = placed.select((1 - F.col("quality")).alias("quality"), F.col("idx").alias("at"), *[F.col(f).alias(f"other_{f}") for f in FEATURES])
    sign = F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)
    met = draws.join(partners, ["quality", "at"])
    pairs = written(met.select(*[(sign * (F.col(f) - F.col(f"other_{f}")) / s).alias(f) for f, s in zip(FEATURES, scale, strict=True)]), "op12-pairs")
    discard(placed)
    return pairs


def learn(described: DataFrame, labels: DataFrame) -> Model:
    """From all of (doc_id, FEATURES) with a label in labels (doc_id, quality) that are not held out, as ``fit`` does it, on Spark.

    Null labels teach nothing; several labels of a document count as the greatest; repeated documents count once each, and
    labels without a document not at all. The driver gets sums of tasks only. Weights have nine digits, as sums of rows in
    another order differ in the last ones.
    """
    known = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality")).where(~held_out(F.col("doc_id")))
    rows = written(described.join(known, "doc_id"), "op12-known")
    sizes = {0: 0, 1: 0} | {int(r["quality"]): r["count"] for r in rows.groupBy("quality").count().collect()}
    if not sizes[0] or not sizes[1]:
        discard(rows)
        return fit(np.zeros((sum(sizes.values()), len(FEATURES))), np.repeat([0, 1], [sizes[0], sizes[1]]), sizes)
    spread = rows.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]).first()
    scale = [spread[f] if spread[f] >= 1e-9 else 1.0 for f in FEATURES]
    pairs = drawn_pairs(rows, sizes, scale)
    w = newton(lambda w: np.sum([r["sums"] for r in pairs.mapInPandas(_sums(w), "sums array<double>").collect()], axis=0), len(FEATURES))
    discard(pairs)
    weights = [float(f"{v / s:.9g}") for v, s in zip(w, scale, strict=True)]
    ranked = numbered(rows.select(_ranking(weights).alias("z"), hash60(F.lit("rank"), F.col("doc_id")).alias("tie")), [], [F.col("z"), F.col("tie")], "op12-ranks")
    beside = [r["z"] for r in ranked.where(F.col("idx").isin(sizes[0] - 1, sizes[0])).orderBy("idx").select("z").collect()]
    discard(ranked)
    discard(rows)
    return Model(weights, sum(beside) / 2)


def _ranking(weights: list[float]) -> Column:
    """The linear score of the FEATURES."""
    z = F.lit(0.0)
    for name, w in zip(FEATURES, weights, strict=True):
        z = z + F.lit(w) * F.col(name)
    return z


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3 (a null id counts as the empty text, whose crc32 is 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(described: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted): one row a row of ``features``. Repeated rows get equal scores; an empty table gives an empty result."""
    z = _ranking(model.weights) - model.threshold
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return described.select(id_col, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Null and empty texts have no features and get the score of that; null ids are not held out."""
    described = written(features(table(spark, sf_dir, "documents")), "op12-features")
    model = learn(described, table(spark, sf_dir, "labels"))
    return score(described, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op12_quality": op12_quality}
#: SQL has no fit: tested against a plain version, hand cases and held-out labels.
ORACLES: dict[str, str] = {}
