"""Benchmark decontamination by template canonicalisation.

Words of benchmark items and documents are replaced by typed placeholders: numbers, names (capitalised inside a
sentence) and units (after a number). Runs of ANCHOR template words are hashed; document runs are hash-joined to item
runs, which gives candidate pairs also where numbers, names or units were exchanged. Each candidate is then aligned word
by word, with jumps of SLACK words at most for words put in or left out. It is reported if an alignment covers enough of
the item's words and its slots are consistent: every value of the item stands for one value of the document throughout
this alignment, which is what a re-parameterised question does and chance matches don't.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bitmap import bitmap, in_bitmap
from ._common import table, written
from ._text import chunks, hashed_words, windows

WINDOW, COVERAGE, CONSISTENT, FILTER_BITS = 8, 0.6, 0.9, 23
ANCHOR, SLACK, SALTS = 4, 3, 16
#: Item words times diagonals up to which all ways back are kept; beyond, every n ** 0.5-th row is.
CELLS = 4_000_000
# Units after a number.
UNITS = "cm ft g gb hours hour kb kg kilometers km lb lbs m mb meters mg miles min minutes ml mm mph oz percent seconds tb years year".split()
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_U = np.uint64


class Words(NamedTuple):
    """Template hash, raw hash, is a slot, is capitalised, of every word in a row."""

    template: np.ndarray
    raw: np.ndarray
    slot: np.ndarray
    capital: np.ndarray


def _kinds(token: str) -> int:
    """0 lower-case word, 1 capitalised word, 2 number, 3 sentence end, 4 unit."""
    if token[0] in ".!?\n":
        return 3
    if token[0].isdigit():
        return 2
    if token.lower() in UNITS:
        return 4
    return 1 if token[0].isupper() and token[1:].islower() else 0


def templates(texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of all texts in a row, and each text's number of words."""
    lists = [TOKEN.findall(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes, unique = pd.factorize(np.array([w for x in lists for w in x], dtype=object)) if sizes.sum() else (np.zeros(0, dtype=np.int64), [])
    kind = np.array([_kinds(w) for w in unique], dtype=np.int64)[codes]
    raw = hashed_words([[w.lower() for w in unique]])[0][codes]
    before = np.concatenate([[3], kind[:-1]]) if len(kind) else kind
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 3
    number, name, unit = kind == 2, (kind == 1) & (before != 3), (kind == 4) & (before == 2)
    slot = number | name | unit
    template = np.where(number, _U(2), np.where(name, _U(3), np.where(unit, _U(5), raw)))
    words = kind != 3
    owner = np.repeat(np.arange(len(texts)), sizes)[words]
    return Words(template[words], raw[words], slot[words], kind[words] == 1), np.bincount(owner, minlength=len(texts))


def _anchors(widths: list[int], bits: np.ndarray | None):
    """id, mark, text -> id, mark, win, width: the distinct runs of the texts.

    With ``bits`` only runs whose hash falls on a set bit are given, of all ``widths``; without, each text has runs of
    the largest of the widths that it holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "text"):
            words, counts = templates(pdf["text"].tolist())
            for width in widths:
                win, owner = windows(words.template, counts, width)
                keep = in_bitmap(bits, win) if bits is not None else np.minimum(counts, max(widths))[owner] == width
                win, owner = win[keep], owner[keep]
                rows = pd.DataFrame({"id": pdf["id"].to_numpy()[owner], "mark": pdf["mark"].to_numpy()[owner], "win": win.view(np.int64), "width": width, "owner": owner})
                yield rows.drop_duplicates(["owner", "win"]).drop(columns="owner")

    return run


def _regions(doc: Words, item: Words) -> list[Words]:
    """The parts of the document round its runs that are the item's too."""
    n = len(item.raw)
    width = min(ANCHOR, n)
    win = [windows(x.template, np.array([len(x.raw)]), width)[0] for x in (doc, item)]
    hits = np.flatnonzero(np.isin(*win))
    cuts = np.flatnonzero(np.diff(hits) > 4 * n) + 1
    return [Words(*[x[max(0, part[0] - 2 * n) : part[-1] + 2 * n] for x in doc]) for part in np.split(hits, cuts) if len(part)]


class _Lattice:
    """An item against a part of a document, word by word: row i holds item word i on all diagonals, which are document places less item places.

    Rows are slices of the padded document and are never put together, so that memory follows the words of both, not
    their product.
    """

    def __init__(self, part: Words, item: Words) -> None:
        self.item, self.n = item, len(item.raw)
        self.m = len(part.raw) + self.n - 1
        pad = lambda x: np.concatenate([np.zeros(self.n - 1, x.dtype), x, np.zeros(self.n - 1, x.dtype)])
        self.template, self.raw, self.capital, self.inside = pad(part.template), pad(part.raw), pad(part.capital), pad(np.ones(len(part.raw), dtype=bool))

    def compared(self, i, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(equal words, matches, matches of other capitals) of the item words ``i`` and the padded document's places ``at``."""
        inside = self.inside[at]
        own = (self.raw[at] == self.item.raw[i]) & inside
        same = (self.template[at] == self.item.template[i]) & inside
        loose = self.capital[at] & self.item.capital[i] & ~same
        return own, same | loose & own, loose & ~own

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(matches, score) of item word i on all diagonals."""
        own, same, loose = self.compared(i, slice(i, i + self.m))
        match = same | loose
        return match, match + own * (0.5 / self.n)


def _step(lattice: _Lattice, i: int, best: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, matches, way back) of row i on all diagonals from those of row i - 1; a jump costs 1."""
    m = lattice.m
    kept, back = best.copy(), np.zeros(m, dtype=np.int8)
    for jump in [*range(-min(SLACK, m - 1), 0), *range(1, min(SLACK, m - 1) + 1)]:
        to, by = (slice(jump, m), slice(0, m - jump)) if jump > 0 else (slice(0, m + jump), slice(-jump, m))
        better = best[by] - 1 > kept[to]
        kept[to][better] = best[by][better] - 1
        back[to][better] = -jump
    match, score = lattice.row(i)
    return kept + score, counts[np.arange(m) + back] + match, back


class _Bent:
    """The best way to each diagonal of the last item word, with jumps: ``counts`` of its matches, and ``trace`` for the ways of some.

    Only every ``block``-th row is kept. Ways are traced block by block from the end, each block's rows made again.
    """

    def __init__(self, lattice: _Lattice) -> None:
        self.lattice, n = lattice, lattice.n
        self.block = n if n * lattice.m <= CELLS else max(1, int(n**0.5))
        match, best = lattice.row(0)
        counts = match.astype(np.int64)
        self.kept, self.backs = {0: (best, counts)}, []
        for i in range(1, n):
            best, counts, back = _step(lattice, i, best, counts)
            if self.block == n:
                self.backs.append(back)
            elif i % self.block == 0:
                self.kept[i] = best, counts
        self.counts = counts

    def trace(self, ends: np.ndarray) -> np.ndarray:
        """The diagonals of all item words, one column for each of ``ends``."""
        n, at = self.lattice.n, ends.copy()
        out = np.empty((n, len(ends)), dtype=np.int64)
        for first in sorted(self.kept, reverse=True):
            last = min(first + self.block, n) - 1
            backs = self.backs
            if self.block < n:
                # the rows after ``first`` up to the next kept one, whose way back leads out of this block
                backs, (best, counts) = [], self.kept[first]
                for i in range(first + 1, min(last + 2, n)):
                    best, counts, back = _step(self.lattice, i, best, counts)
                    backs.append(back)
            for i in range(min(last + 1, n - 1), first, -1):
                out[i] = at
                at = at + backs[i - first - 1][at]
            out[first] = at
        return out


def _near_best(counts: np.ndarray) -> np.ndarray:
    """For each diagonal, the largest count within SLACK of it."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(counts, SLACK), 2 * SLACK + 1).max(axis=1)


def _judge(item: Words, raw: np.ndarray, same: np.ndarray, loose: np.ndarray) -> tuple[int, bool, float]:
    """(matched words, exact, agreement) of one alignment: the document's raw words, which match, which are other capitals.

    Another capitalised word counts as matched where it stands for the item's as its slots do throughout.
    """
    slots = same & item.slot
    stands: dict = defaultdict(Counter)
    for a, b in zip(item.raw[slots].tolist(), raw[slots].tolist(), strict=True):
        stands[a][b] += 1
    top = sum(max(c.values()) for c in stands.values())
    agree = top / slots.sum() if slots.any() else 1.0
    other: dict = defaultdict(Counter)
    for a, b in zip(item.raw[loose].tolist(), raw[loose].tolist(), strict=True):
        other[a][b] += 1
    names = sum(c[stands[a].most_common(1)[0][0]] if a in stands else max(c.values()) for a, c in other.items())
    exact = not other and bool((item.raw[slots] == raw[slots]).all())
    return int(same.sum()) + names, exact, agree


def aligned(doc: Words, item: Words, width: int = WINDOW, coverage: float = COVERAGE) -> tuple[int, bool] | None:
    """(matched words of the item, exact) of the best alignment that passes, exact ones first; None without one."""
    n = len(item.raw)
    need = n if n < width else coverage * n
    found: list[tuple[bool, int]] = []
    for part in _regions(doc, item):
        if np.isin(item.template, part.template).sum() + item.capital.sum() < need:
            continue
        lattice = _Lattice(part, item)
        words = np.arange(n)
        straight = np.zeros(lattice.m, dtype=np.int64)
        for i in range(n):
            straight += lattice.row(i)[0]
        bent = _Bent(lattice)
        best = _near_best(bent.counts)
        # not those that leave a better one half-way, as they shun the slots of the rest
        for counts, least, trace in ((straight, CONSISTENT * best, lambda ends: np.broadcast_to(ends, (n, len(ends)))), (bent.counts, best, bent.trace)):
            passed = np.flatnonzero((counts >= need) & (counts >= least))
            for some in np.split(passed, range(0, len(passed), max(1, CELLS // n))[1:]) if len(passed) else []:
                paths = trace(some)
                for k in range(len(some)):
                    at = words + paths[:, k]
                    _, same, loose = lattice.compared(words, at)
                    matched, exact, agree = _judge(item, lattice.raw[at], same, loose)
                    # without a fixed word any row of slots would do
                    if matched >= need and agree >= CONSISTENT and (exact or not item.slot.all()):
                        found.append((exact, matched))
    if not found:
        return None
    exact, matched = max(found)
    return matched, exact


def _confirm(width: int, coverage: float):
    """id, text, items -> id, item, matched, words, exact of the candidates that pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[str, Words] = {}
        for pdf in batches:
            out = []
            for id_, text, items in zip(pdf["id"], pdf["text"], pdf["items"], strict=True):
                doc, _ = templates([text])
                for x in items:
                    if len(read) > 10_000:
                        read.clear()
                    if x["text"] not in read:
                        read[x["text"]] = templates([x["text"]])[0]
                    item = read[x["text"]]
                    if got := aligned(doc, item, width, coverage):
                        out.append((id_, x["item"], got[0], len(item.raw), got[1]))
            yield pd.DataFrame(out, columns=["id", "item", "matched", "words", "exact"]).astype({"matched": "int64", "words": "int64", "exact": "bool"})

    return run


def _marked(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, mark, text: mark tells rows of one id apart by their texts."""
    return rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(id, item, matched, words, coverage, exact): the pairs of document and item that leak.

    words counts the item's words, matched those that an alignment finds in the document; exact tells whether every slot
    has the item's own value. Items of fewer than ``width`` words must be found whole, and items of slots alone with
    their own values. Null texts and texts without a word match nothing. Equal rows of a document count once. Ids may
    be null (a null id is an id). Empty tables give no pairs.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows, tests = _marked(docs, id_col, text), _marked(benchmark, item_col, "text").distinct()
    items = written(tests.mapInPandas(_anchors([*range(1, ANCHOR + 1)], None), f"id {item_kind}, mark long, win long, width int"), "op4-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    found = rows.mapInPandas(_anchors(widths, bitmap(items, "win", FILTER_BITS)), f"id {kind}, mark long, win long, width int")
    pairs = found.join(items.select(F.col("id").alias("item"), F.col("mark").alias("item_mark"), "win", "width"), ["win", "width"]).select("id", "mark", "item", "item_mark")
    pairs = written(pairs.distinct(), "op4-pairs")
    # items are few: copies of each, so that an item that many documents hold is joined in many tasks
    copies = tests.select(F.col("id").alias("i"), F.col("mark").alias("item_mark"), "text", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))
    texts = salted.join(copies, (salted["item_mark"] == copies["item_mark"]) & (salted["salt"] == copies["salt"]) & salted["item"].eqNullSafe(copies["i"]))
    listed = texts.groupBy("id", "mark").agg(F.collect_list(F.struct("item", "text")).alias("items")).select(F.col("id").alias("d"), F.col("mark").alias("m"), "items")
    bits = bitmap(pairs, "mark", FILTER_BITS)
    known = F.pandas_udf(lambda m: pd.Series(in_bitmap(bits, m.to_numpy().view(_U))), "boolean")
    read = rows.where(known("mark")).join(listed, (F.col("mark") == F.col("m")) & F.col("id").eqNullSafe(F.col("d"))).select("id", "text", "items")
    sure = read.mapInPandas(_confirm(width, coverage), f"id {kind}, item {item_kind}, matched long, words long, exact boolean")
    best = sure.groupBy("id", "item").agg(F.max(F.struct("exact", "matched", "words")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.matched", "b.words", (F.col("b.matched") / F.col("b.words")).alias("coverage"), "b.exact")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    bad = leaks(docs, benchmark, id_col, text=text).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that leaks in it, over all documents and items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
