"""NumPy helpers on batches of texts, for tasks that Spark has dealt out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64, public domain)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(batches: Iterator[pd.DataFrame], column: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into runs of whole rows of about ``chars`` characters, so that memory doesn't follow the batch."""
    for pdf in batches:
        sizes = pdf[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        part = np.cumsum(sizes) // chars
        start = 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1), len(pdf)]:
            if stop > start:
                yield pdf.iloc[start:stop]
            start = stop


def arrow_chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``size`` bytes, without copies and without Python strings."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // size
        start = 0
        for stop in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop


def hashed_words(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all lists in a row, number of words of each list)."""
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    words = np.empty(int(counts.sum()), dtype=object)
    words[:] = [w for x in lists for w in x]
    return (pd.util.hash_array(words) if len(words) else np.zeros(0, dtype=_U)), counts


def text_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of what white space separates in the lower-cased ``texts`` (of any kind); null texts have no words."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, type=pa.large_string(), from_pandas=True)
    # trimmed first: the split misreads blanks at the very end of a column
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(column.fill_null(""))))
    if not len(lists):
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_numpy(zero_copy_only=False)
    codes = words.indices.to_numpy()
    real = (names != "")[codes]  # a blank text leaves an empty word
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    before = np.concatenate([[0], np.cumsum(real)])
    return pd.util.hash_array(names, categorize=False)[codes][real], np.diff(before[starts]).astype(np.int64)


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words that lies within one list, number of that list), from ``hashed_words``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=_U)
    for i in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + words[i : i + n]
    inside = owner[:n] == owner[width - 1 :]
    return mix64(h[inside]), owner[:n][inside]
