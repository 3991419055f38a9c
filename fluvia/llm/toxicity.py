"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Texts are lower-cased and folded character by character (homoglyphs, digit and symbol substitutions); plain and folded
text are both matched, since a digit may also be just a digit. A hit counts where no letter of the plain text touches it
and no exception phrase covers it. Lexicon weights are log odds learned from labelled documents; the score is a logistic function of the
weighted hits and of the hits for a hundred words.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bitmap import bitmap, in_bitmap
from ._common import table, written
from ._split import held_out, sampled
from ._text import chunks

# Parameters: labelled documents of each label to learn from at most; entries of the lexicon at most; what an entry must
# show: groups of texts, log odds.
MAX_TRAIN, MAX_LEXICON, LEAST_TEXTS, LEAST_ODDS, FILTER_BITS = 20_000, 1000, 4, 3.0, 22
# Phrases whose words are not meant as insults.
EXCEPTIONS = ["clown fish", "idiot proof", "trash bin", "trash can"]
# Characters and the letters they stand for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g"}
#: Full-width letters follow a rule: U+FF41 to U+FF5A stand for a to z.
FOLD = str.maketrans(SUBSTITUTES | HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})


@dataclass
class Model:
    lexicon: dict[str, float]
    coefficients: tuple[float, float, float]


def automaton(lexicon: dict[str, float], exceptions: list[str] = EXCEPTIONS) -> ahocorasick.Automaton:
    """All entries and exception phrases in one automaton; each value is (length, weight), None for an exception."""
    found = ahocorasick.Automaton()
    for phrase in exceptions:
        found.add_word(phrase, (len(phrase), None))
    for word, weight in lexicon.items():
        found.add_word(word, (len(word), weight))
    found.make_automaton()
    return found


def hits(text: str, words: ahocorasick.Automaton) -> dict[int, float]:
    """Start -> weight of the hits in one text, each place once."""
    lower = text.lower()
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for variant in dict.fromkeys((lower, lower.translate(_GLYPHS), lower.translate(FOLD))):
        for stop, (size, weight) in words.iter(variant):
            start = stop - size + 1
            if (start and lower[start - 1].isalpha()) or (stop + 1 < len(lower) and lower[stop + 1].isalpha()):
                continue
            if weight is None:
                spared.append((start, stop))
            else:
                found[start] = max(weight, found.get(start, weight))
    if not spared:
        return found
    spared.sort()
    begins, reach = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
    return {s: w for s, w in found.items() if not (i := bisect_right(begins, s)) or reach[i - 1] < s}


def _features(lexicon: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = automaton(lexicon)
        for pdf in chunks(batches, "text"):
            weight, density = [], []
            for text in pdf["text"]:
                found = hits(text, words) if isinstance(text, str) and text else {}
                weight.append(math.log1p(sum(found.values())))
                density.append(math.log1p(100 * len(found) / len(text.split())) if found else 0.0)
            yield pdf[keep].assign(weight=weight, density=density)

    return run


def features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", weight double, density double"
    return docs.select(*keep, "text").mapInPandas(_features(lexicon, keep), schema)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Log odds of words (text, toxic) that toxic texts hold far more often; MAX_LEXICON entries at most, none without both labels.

    A word's support counts groups of texts with the same least word hash, so that copies count about once. A word must
    be in LEAST_TEXTS groups, and its likelihood ratio must be beyond what chance gives one of all such words.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: F.length(t) >= 3))
    rows = labelled.where("text IS NOT NULL").select("toxic", tokens.alias("t")).where(F.size("t") > 0)
    rows = written(rows.withColumn("g", F.array_min(F.transform("t", lambda t: F.xxhash64(t)))), "op9-words")
    sizes = dict(rows.groupBy("toxic").agg(F.count_distinct("g")).collect())
    if not sizes.get(1) or not sizes.get(0):
        return {}
    support = rows.select("toxic", "g", F.explode("t").alias("word")).distinct().groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    support = written(support.where(F.col("bad") + F.col("good") >= LEAST_TEXTS), "op9-support")
    tested, prior, n = support.count(), sizes[1] / (sizes[0] + sizes[1]), F.col("bad") + F.col("good")
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0))
    ratio = F.when(F.col("bad") > 0, F.col("bad") * F.log(F.col("bad") / (n * prior))).otherwise(0.0) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - prior)))).otherwise(0.0)
    scored = support.withColumn("odds", odds)
    strong = (F.col("odds") >= LEAST_ODDS) & (ratio >= math.log(max(1, tested)))
    got = scored.where(strong).orderBy(F.desc("odds"), "word").limit(MAX_LEXICON).select("word", "odds").collect()
    return {r["word"]: r["odds"] for r in got}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small ridge (classes may be separable)."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _present(words: np.ndarray):
    """Only texts that the sample may hold are shuffled to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[in_bitmap(words, pdf["h"].to_numpy().view(np.uint64)), ["doc_id", "text"]]

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out: a sample of MAX_TRAIN of each label at most.

    Null labels and null texts teach nothing; several labels of a document count as the greatest. Without labels, or with
    one label only, the lexicon is empty and every text gets the score of a text without hits.
    """
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    rows = written(sampled(known, "toxic", MAX_TRAIN), "op9-sample")
    hashed = F.xxhash64("doc_id").alias("h")
    words = bitmap(rows.select(hashed), "h", FILTER_BITS)
    near = docs.select("doc_id", "text", hashed).mapInPandas(_present(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
    labelled = written(near.join(rows, "doc_id").select("text", "toxic"), "op9-train")
    lexicon = learn_lexicon(labelled)
    seen = features(labelled, lexicon, ["toxic"]).toPandas()
    if seen["toxic"].nunique() < 2:
        return Model(lexicon, (-4.0, 3.0, 0.5))
    return Model(lexicon, fit(seen[["weight", "density"]].to_numpy(), seen["toxic"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted): one row a row of ``docs``. Null and empty texts have no hits and get the score of none.

    Repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
    """
    b0, b1, b2 = model.coefficients
    found = features(docs.select(F.col(id_col), F.col(text).alias("text")), model.lexicon, [id_col])
    z = F.lit(b0) + F.lit(b1) * F.col("weight") + F.lit(b2) * F.col("density")
    scored = found.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return scored.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
