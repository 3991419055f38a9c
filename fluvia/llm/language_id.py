"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Each language is a model of character trigrams (hashed to BUCKETS cells) with the share of each script in its letters.
A word is scored by the log probability of its trigrams in the languages that use its script. The Viterbi path through
the words of a text pays SWITCH for each change of language, so that a span in another language needs evidence of
several words. The language with most letters on the path is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._split import held_out, sampled
from ._text import chunks, mix64

# Parameters: documents a language to learn from at most; cells of the trigram table; cost of a switch and of a word in a script that the language does not use (nats).
MAX_TRAIN, BUCKETS, SWITCH, FOREIGN, LEAST_SHARE = 3000, 1 << 15, 12.0, 30.0, 0.01
#: Letters in a piece at most; longer words are scored in pieces, none is cut off.
PIECE = 24
WORD = re.compile(r"[^\W\d_]{1,%d}" % PIECE)
# First code points of script ranges, in order. Everything from one start up to the next is one script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_U = np.uint64


@dataclass
class Model:
    """langs; logp: trigram cell x language; uses: script x language, True where the language is a candidate."""

    langs: list[str]
    logp: np.ndarray
    uses: np.ndarray


def _grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram cells of each word, padded with BUCKETS; script of its first letter; its letters) of a string array."""
    width = words.dtype.itemsize // 4
    codes = np.zeros((len(words), width + 2), dtype=_U)
    codes[:, 1:-1] = words.view(np.uint32).reshape(len(words), width)
    size = (codes > 0).sum(axis=1)
    cells = np.full((len(words), width), BUCKETS, dtype=np.int64)
    for i in range(width):
        h = mix64((codes[:, i] << _U(42)) ^ (codes[:, i + 1] << _U(21)) ^ codes[:, i + 2])
        cells[:, i] = np.where(i < size, (h % _U(BUCKETS)).astype(np.int64), BUCKETS)
    return cells, _SCRIPT[np.searchsorted(_STARTS, codes[:, 1].astype(np.int64), side="right") - 1], size


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text, lang -> counts by (lang, cell); cells from BUCKETS + 1 on count the letters of each script."""
    found: dict[str, np.ndarray] = {}
    for pdf in chunks(batches, "text"):
        for lang, texts in pdf.groupby("lang")["text"]:
            words = [w for t in texts for w in WORD.findall(t.lower())]
            if not words:
                continue
            cells, script, size = _grams(np.array(words, dtype=f"U{PIECE}"))
            total = found.setdefault(lang, np.zeros(BUCKETS + 1 + len(_NAMES), dtype=np.int64))
            total[: BUCKETS + 1] += np.bincount(cells.ravel(), minlength=BUCKETS + 1)
            total[BUCKETS + 1 :] += np.bincount(script, weights=size, minlength=len(_NAMES)).astype(np.int64)
    for lang, total in found.items():
        at = np.flatnonzero(total)
        at = at[at != BUCKETS]
        yield pd.DataFrame({"lang": lang, "cell": at, "n": total[at]})


def train(labelled: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learn from (doc_id, text, lang) rows; null texts and null languages are left out. The driver gets one small table a language."""
    rows = sampled(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), "lang", most)
    got = rows.select("text", "lang").mapInPandas(_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    count, letters = np.zeros((BUCKETS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        gram = own["cell"] < BUCKETS
        count[own["cell"][gram], i] = own["n"][gram]
        letters[own["cell"][~gram] - BUCKETS - 1, i] = own["n"][~gram]
    logp = np.log((count + 0.1) / (count.sum(axis=0) + 0.1 * BUCKETS))
    uses = letters / np.maximum(1, letters.sum(axis=0)) >= LEAST_SHARE
    return Model(langs, np.vstack([logp, np.zeros(len(langs))]).astype(np.float32), uses)


def _word_scores(words: list[str], model: Model) -> np.ndarray:
    codes, unique = pd.factorize(np.array(words, dtype=object))
    score = np.empty((len(unique), len(model.langs)), dtype=np.float32)
    for lo in range(0, len(unique), 20_000):
        cells, script, _ = _grams(np.array(unique[lo : lo + 20_000], dtype=f"U{PIECE}"))
        s = np.zeros((len(cells), len(model.langs)), dtype=np.float32)
        for i in range(cells.shape[1]):
            s += model.logp[cells[:, i]]
        fits = model.uses[script]
        fits |= ~fits.any(axis=1, keepdims=True)  # a script that no language uses: all are candidates
        score[lo : lo + 20_000] = s - FOREIGN * ~fits
    return score[codes]


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best state of every word: rows starts[i] to starts[i] + sizes[i] of ``scores`` are text i. All texts advance together."""
    states = scores.shape[1]
    best, back = np.zeros(len(scores), dtype=np.int16), np.zeros(scores.shape, dtype=np.int16)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    value = np.zeros((len(starts), states))
    own = np.arange(states, dtype=np.int16)
    active = np.searchsorted(-sizes, -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
    for t, n in enumerate(active):
        rows = starts[:n] + t
        if t:
            v = value[:n]
            arg = v.argmax(axis=1)
            jump = v[np.arange(n), arg] - switch
            stay = v >= jump[:, None]
            back[rows] = np.where(stay, own, arg[:, None])
            value[:n] = np.where(stay, v, jump[:, None])
        value[:n] += scores[rows]
    last = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        best[rows] = last[:n]
        last[:n] = back[rows, last[:n]]
    return best


def _identify(model: Model, with_spans: bool, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "text", 4_000_000):
            found = [WORD.findall(t.lower()) if t else [] for t in pdf["text"].where(pdf["text"].notna(), "")]
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            words = [w for x in found for w in x]
            share = np.zeros((len(pdf), len(model.langs)))
            path = np.zeros(0, dtype=np.int16)
            if words and model.langs:
                path = viterbi(_word_scores(words, model), starts, sizes)
                letters = np.array([len(w) for w in words], dtype=np.float64)
                at = np.repeat(np.arange(len(pdf)), sizes) * len(model.langs) + path
                share = np.bincount(at, weights=letters, minlength=share.size).reshape(share.shape)
            total = share.sum(axis=1)
            some = total > 0
            out = pdf[keep].copy()
            top = share.argmax(axis=1) if model.langs else np.zeros(len(pdf), dtype=int)
            out["lang_pred"] = [model.langs[i] if ok else "und" for i, ok in zip(top, some, strict=True)]
            out["score"] = np.where(some, share.max(axis=1, initial=0.0) / np.maximum(total, 1), 0.0)
            if with_spans:
                out["spans"] = [_spans(path[s : s + n], model.langs) for s, n in zip(starts, sizes, strict=True)]
            yield out

    return run


def _spans(path: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"start": a, "stop": b, "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]): one row a row of ``docs``. score is the share of letters in lang_pred's spans.

    Null texts and texts without a letter: `und`, score 0, no spans. Spans count words (pieces of PIECE letters at most)
    from 0, the stop is outside. A text whose script no learned language uses is judged among all. Equal scores go to the
    first language by name. Other columns are not read; an empty table gives an empty result.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + (", spans array<struct<start:int,stop:int,lang:string>>" if spans else "")
    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    return rows.mapInPandas(_identify(model, spans, [id_col]), schema)


def _keep(model: Model):
    judge = _identify(model, False, [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "text"):
            found = pd.concat(judge(iter([pdf])))  # the judge may cut once more
            yield pdf[((found["lang_pred"] != "und") & (found["score"] >= 0.5)).to_numpy()]

    return run


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) of which one language has half the letters or more, all columns as they are."""
    return docs.mapInPandas(_keep(model), docs.schema)


def learn(docs: DataFrame) -> Model:
    """The model of documents (doc_id, text, lang), from the rows that are not held out."""
    return train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs), spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
