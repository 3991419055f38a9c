"""LM scoring: stupid-backoff scores from n-gram count tables partitioned by hash.

With c the counts of all n-grams of ORDER words or fewer over all texts, N the words and A = 0.4, a word scores c(u v w) /
c(u v) if the trigram is in the table, else A times its score after v alone: c(v w) / c(v), else A * c(w) / N. The first
words of a text have shorter contexts. A text's score is the sum of the logarithms.

``count_table`` counts: every task counts its own texts' n-grams, their 64-bit hashes are dealt to buckets by their leading
bits and each bucket is summed apart. A frequent n-gram travels once a chunk of texts, whatever the number of texts.

``score`` looks up any texts: every word's n-grams are dealt to the buckets, joined to the table and settled word by word.

``score_counted`` scores the very texts that were counted. All their n-grams are in the table, and contexts cancel out: the
score is the sum of ln c over the n-grams of ORDER words, less that over the inner ones of ORDER - 1 words, less ln N. What
was counted once adds ln 1 = 0, so only n-grams counted twice or more are looked up: those that make up 1 / HOT of all words
or more while the texts are read (HOT for each order at most), the others in their buckets, after a fixed-size bitmap has
kept back most of those counted once. Sums per text come out of each bucket and are added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bitmap import in_bitmap
from ._common import discard, table, written
from ._text import arrow_chunks, chunks, text_words, windows

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
# Bytes in a chunk, n-grams in a bucket (about), buckets at least and those that are settled at once, share of a frequent n-gram, bits of the bitmap.
CHUNK, BUCKET, LEAST_BUCKETS, WIDE, HOT, FILTER_BITS = 3_000_000, 1 << 20, 128, 8, 1 << 21, 27
_U = np.uint64


def _runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) for each bucket that sorted ``keys`` fall in; buckets are ranges of leading bits."""
    of = (keys >> _U(65 - buckets.bit_length())).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield int(of[lo]), lo, hi


def _spread(keys: np.ndarray, buckets: int) -> int:
    """A bucket for what a chunk says about itself: any one, but not the same for all chunks."""
    return int(keys[0]) % buckets if len(keys) else 0


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the leading bytes are zeros, which the shuffle's compression removes."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(column: pd.Series) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T.copy().view(_U).ravel().cumsum(dtype=_U) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=_U)


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _counts(order: int, buckets: int):
    """text -> a row for each bucket of a chunk: bucket, words (all of the chunk, on one row), sorted keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_chunks(batches, "text", CHUNK):
            words, counts = text_words(batch.column("text"))
            keys = np.concatenate([windows(words, counts, k)[0] for k in range(1, order + 1)])
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys = keys[first]
            rows = [(b, 0, _packed(keys[lo:hi]), n[lo:hi].tobytes()) for b, lo, hi in _runs(keys, buckets)]
            rows.append((_spread(keys, buckets), len(words), b"", b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "words", "keys", "n"])

    return run


def _summed(least: int, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _unpacked(pdf["keys"]), _joined(pdf["n"], np.int32)
        at = np.argsort(keys)
        keys, n = keys[at], n[at].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        n, keys = np.add.reduceat(n, first) if len(first) else n, keys[first]
        often = n >= 2
        bits = max(8, (1 << FILTER_BITS) // buckets)
        place = (keys[often] >> _U(64 - FILTER_BITS)).astype(np.int64) % bits
        seen = np.zeros(bits, dtype=np.uint8)
        seen[place] = 1
        keep = n >= least
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "words": pdf["words"].sum(), "seen": [np.packbits(seen, bitorder="little").tobytes()], "keys": [keys[keep].view(np.int64)], "n": [n[keep]]})

    return run


def count_table(docs: DataFrame, text: str = "text", order: int = ORDER, least: int = 1) -> DataFrame:
    """(bucket, words, seen, keys, n): the counts of all n-grams of ``order`` words or fewer; a written table, one row a bucket.

    keys are the hashes of the n-grams in ascending order and n their counts, of ``least`` or more; seen is the part of a
    bitmap of what was counted twice or more; the words of all rows together are N. Words are what white space separates,
    lower-cased; null and blank texts have none. Repeated rows count as often as they are there.
    """
    base = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << (FILTER_BITS - 3), max(LEAST_BUCKETS, 1 << math.ceil(math.log2(order * size / 6 / BUCKET + 1))))
    dealt = base.mapInArrow(_counts(order, buckets), "bucket int, words long, keys binary, n binary")
    out = written(dealt.groupBy("bucket").applyInPandas(_summed(least, buckets), "bucket int, words long, seen binary, keys array<long>, n array<long>"), "op6-counts")
    out.buckets, out.order = buckets, order
    return out


def _signed(words: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of its text, +1 or -1) of the n-grams that make up the texts' scores."""
    keys, owner = windows(words, counts, order)
    found = [(keys, owner, np.ones(len(keys), dtype=np.int8))]
    for k in range(1, order):
        keys, owner = windows(words, counts, k)
        alone = counts[owner] == k  # a text of k words is one n-gram
        found.append((keys[alone], owner[alone], np.ones(int(alone.sum()), dtype=np.int8)))
    inner = np.zeros(len(keys), dtype=bool)
    inner[1:-1] = (owner[1:-1] == owner[:-2]) & (owner[1:-1] == owner[2:])
    found.append((keys[inner], owner[inner], np.full(int(inner.sum()), -1, dtype=np.int8)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _planes(values: np.ndarray) -> bytes:
    """Small numbers byte by byte, so that zero bytes lie together."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *[np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64) for x in column]])


_PARTS = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary())


def _look_up(order: int, buckets: int, shared):
    """id, text -> a row with the texts of a chunk, their words and what is known already, and a row for each bucket with the rest.

    The rest are sorted keys with twice the number of the text in the chunk, plus 1 for what is subtracted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often, value = shared.value
        task, nth = TaskContext.get().partitionId() << 32, 0
        for batch in arrow_chunks(batches, "text", CHUNK):
            words, counts = text_words(batch.column("text"))
            keys, owner, sign = _signed(words, counts, order)
            open_ = in_bitmap(seen, keys)
            keys, owner, sign = keys[open_], owner[open_], sign[open_]
            at = np.argsort(keys)
            keys, owner, sign = keys[at], owner[at], sign[at]
            at = np.minimum(np.searchsorted(often, keys), max(0, len(often) - 1))
            known = often[at] == keys if len(often) else np.zeros(len(keys), dtype=bool)
            total = np.bincount(owner[known], weights=value[at[known]] * sign[known], minlength=batch.num_rows)
            spot = _spread(keys, buckets)
            ids = pa.ListArray.from_arrays([0, batch.num_rows], batch.column("id"))
            rows = [(spot // WIDE, task + nth, counts, total, b"", b"")]
            keys, place = keys[~known], (owner * 2 + (sign < 0))[~known]
            for bucket, lo, hi in _runs(keys, buckets):
                rows.append((bucket // WIDE, task + nth, None, None, _packed(keys[lo:hi]), _planes(place[lo:hi])))
            bucket, chunk, words, known, packed, places = (pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), _PARTS, strict=True))
            ids = pa.concat_arrays([ids, pa.nulls(len(rows) - 1, ids.type)])
            yield pa.RecordBatch.from_arrays([bucket, chunk, ids, words, known, packed, places], names=["bucket", "chunk", "ids", "words", "known", "keys", "places"])
            nth += 1

    return run


def _table_of(counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of some buckets; the keys of one bucket come before those of the next."""
    counts = counts.sort_values("place")
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *counts["keys"]]).astype(np.int64).view(_U), np.concatenate([none, *counts["n"]]).astype(np.int64)


def _settle(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """WIDE buckets: for each chunk the sums of its n-grams by text, and the rows of what is known already as they are."""
    out = [(r.chunk, r.ids, r.words, None, r.known) for r in rows[rows["words"].notna()].itertuples()]
    rest = rows[rows["words"].isna()]
    known, n = _table_of(counts)
    if len(rest) and len(known):
        n = np.log(n)
        for (chunk,), d in rest.groupby(["chunk"]):
            keys, places = _unpacked(d["keys"]), _from_planes(d["places"])
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            value = np.where(known[at] == keys, n[at], 0.0) * (1 - 2 * (places & 1))
            total = np.bincount(places >> 1, weights=value)
            nth = np.flatnonzero(total)
            out.append((chunk, None, None, nth.astype(np.int32), total[nth]))
    return pd.DataFrame(out, columns=["chunk", "ids", "words", "nth", "part"])


def _texts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk of texts: id, words and the sum of all its parts for each."""
    own = pdf[pdf["words"].notna()].iloc[0]
    total = np.array(own["part"], dtype=float)
    for r in pdf[pdf["words"].isna()].itertuples():
        total[r.nth] += r.part
    return pd.DataFrame({"id": pd.Series(list(own["ids"]), dtype=object), "words": list(own["words"]), "part": total})


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            keys, n = np.asarray(r.keys, dtype=np.int64), np.asarray(r.n, dtype=np.int64)
            yield pd.DataFrame({"keys": [keys[n * HOT >= r.total].tobytes()], "n": [n[n * HOT >= r.total].tobytes()]})


def _often(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the n-grams that make up 1 / HOT of ``total`` words or more: HOT for each order at most."""
    got = counts.select("keys", "n", F.lit(total).alias("total")).mapInPandas(_frequent, "keys binary, n binary").toPandas()
    keys, n = _joined(got["keys"], _U), _joined(got["n"], np.int64)
    at = np.argsort(keys)
    return keys[at], n[at]


def _by_width(counts: DataFrame):
    return counts.select(F.expr(f"bucket div {WIDE}").cast("int").alias("bucket"), F.col("bucket").alias("place"), "keys", "n").groupBy("bucket")


def _finished(summed: DataFrame, id_col: str) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return summed.select(F.col("id").alias(id_col), "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def score_counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, log_score, mean_log_score): the texts scored by the counts of these same texts, one row an id.

    Rows that share an id are one document, the sum of its rows; null ids are one id. Null, empty and blank texts have 0
    words, log score 0 and a null mean. Repeated rows count and are scored as often as they are there. Other columns are
    not read; an empty table gives no rows. Two n-grams whose 64-bit hashes are equal count as one.
    """
    spark = docs.sparkSession
    counts = count_table(docs, text, order, least=2)
    total = counts.agg(F.sum("words")).first()[0] or 0
    parts = counts.select("bucket", "seen").toPandas()  # 2 ** FILTER_BITS bits, whatever the size of the input
    bits = np.zeros(max(1 << FILTER_BITS, counts.buckets * 8) // 8, dtype=np.uint8).reshape(counts.buckets, -1)
    for r in parts.itertuples():
        bits[r.bucket] = np.frombuffer(r.seen, dtype=np.uint8)
    often, n = _often(counts, total)
    shared = spark.sparkContext.broadcast((bits.ravel().view(_U), often, np.log(n)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    seen = rows.mapInArrow(_look_up(order, counts.buckets, shared), f"bucket int, chunk long, ids array<{kind}>, words array<long>, known array<double>, keys binary, places binary")
    settled = seen.groupBy("bucket").cogroup(_by_width(counts))
    parts = settled.applyInPandas(_settle, f"chunk long, ids array<{kind}>, words array<long>, nth array<int>, part array<double>")
    texts = parts.groupBy("chunk").applyInPandas(_texts, f"id {kind}, words long, part double")
    summed = texts.groupBy("id").agg(F.sum("words").alias("n_words"), F.sum("part").alias("part"))
    log_score = F.when(F.col("n_words") > 0, F.col("part") - math.log(max(1, total))).otherwise(0.0)
    out = written(_finished(summed.withColumn("log_score", log_score), id_col), "op6-scores")
    discard(counts)
    return out


def _ask(order: int, buckets: int, shared):
    """id, text -> a row with the texts of a chunk and the counts of its frequent n-grams, and a row for each bucket with the other n-grams.

    The chunk's n-grams are numbered size by size in the order of their last words; places are these numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, n = shared.value
        task, nth = TaskContext.get().partitionId() << 32, 0
        for batch in arrow_chunks(batches, "text", CHUNK):
            words, counts = text_words(batch.column("text"))
            keys = np.concatenate([windows(words, counts, k)[0] for k in range(1, order + 1)])
            place = np.argsort(keys)
            keys = keys[place]
            at = np.minimum(np.searchsorted(often, keys), max(0, len(often) - 1))
            known = often[at] == keys if len(often) else np.zeros(len(keys), dtype=bool)
            rows = [(_spread(keys, buckets) // WIDE, task + nth, counts, b"", _planes(place[known]), n[at[known]].tobytes())]
            keys, place = keys[~known], place[~known]
            for bucket, lo, hi in _runs(keys, buckets):
                rows.append((bucket // WIDE, task + nth, None, _packed(keys[lo:hi]), _planes(place[lo:hi]), b""))
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            bucket, chunk, sizes, packed, places, found = (pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))
            ids = pa.ListArray.from_arrays([0, batch.num_rows], batch.column("id"))
            ids = pa.concat_arrays([ids, pa.nulls(len(rows) - 1, ids.type)])
            yield pa.RecordBatch.from_arrays([bucket, chunk, ids, sizes, packed, places, found], names=["bucket", "chunk", "ids", "words", "keys", "places", "n"])
            nth += 1

    return run


def _answer(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """WIDE buckets: for each chunk the places and counts of its n-grams that are in the table, and the rows with texts as they are."""
    out = [(r.chunk, r.ids, r.words, r.places, r.n) for r in rows[rows["words"].notna()].itertuples()]
    rest = rows[rows["words"].isna()]
    known, n = _table_of(counts)
    if len(rest) and len(known):
        for (chunk,), d in rest.groupby(["chunk"]):
            keys, places = _unpacked(d["keys"]), _from_planes(d["places"])
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            out.append((chunk, None, None, _planes(places[hit]), n[at[hit]].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "ids", "words", "places", "n"])


def _backed_off(order: int, total: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One chunk of texts: id, words and the sum of the words' scores for each. The context of a word's n-gram is the one that ends a word before."""
        own = pdf[pdf["words"].notna()].iloc[0]
        counts = np.asarray(own["words"], dtype=np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        found = np.zeros(sum(int((pos >= k).sum()) for k in range(order)))
        found[_from_planes(pdf["places"])] = _joined(pdf["n"], np.int64)
        value, before, start = None, None, 0
        for k in range(order):
            fits = pos >= k
            c = np.zeros(len(owner))
            c[fits] = found[start : start + int(fits.sum())]
            start += int(fits.sum())
            if k == 0:
                value = np.log(np.where(c > 0, c, UNSEEN) / total)
            else:
                seen = fits & (c > 0)
                value = np.where(fits, value + math.log(BACKOFF), value)
                value[seen] = np.log(c[seen] / before[np.flatnonzero(seen) - 1])
            before = c
        part = np.bincount(owner, weights=value, minlength=len(counts))
        return pd.DataFrame({"id": pd.Series(list(own["ids"]), dtype=object), "words": counts, "part": part})

    return run


def score(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, log_score, mean_log_score): any texts scored by a ``count_table`` of all counts, one row an id.

    A word that was never counted takes UNSEEN for its count. Otherwise as ``score_counted``. N-grams that make up 1 / HOT
    of all counted words are settled while the texts are read, the others in their buckets; chunks then back off word by word.
    """
    order, kind = counts.order, docs.schema[id_col].dataType.simpleString()
    total = counts.agg(F.sum("words")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(_often(counts, total))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    asked = rows.mapInArrow(_ask(order, counts.buckets, shared), f"bucket int, chunk long, ids array<{kind}>, words array<long>, keys binary, places binary, n binary")
    answered = asked.groupBy("bucket").cogroup(_by_width(counts)).applyInPandas(_answer, f"chunk long, ids array<{kind}>, words array<long>, places binary, n binary")
    texts = answered.groupBy("chunk").applyInPandas(_backed_off(order, float(max(1, total))), f"id {kind}, words long, part double")
    summed = texts.groupBy("id").agg(F.sum("words").alias("n_words"), F.sum("part").alias("log_score"))
    return _finished(summed, id_col)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the counts of all n-grams of three words or fewer in all documents."""
    return score_counted(table(spark, sf_dir, "documents"))


def op6_lm_scoring_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the counts of all single words and bigrams in all documents."""
    return score_counted(table(spark, sf_dir, "documents"), order=2)


def op6_lm_scoring_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the counts of those that are labelled good: in the others words back off, or were never counted."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    counts = count_table(docs.join(good, "doc_id", "left_semi"))
    out = written(score(docs, counts), "op6-scores")
    discard(counts)
    return out


QUERIES = {"op6_lm_scoring": op6_lm_scoring, "op6_lm_scoring_all": op6_lm_scoring_all, "op6_lm_scoring_backoff": op6_lm_scoring_backoff}
_SPLIT = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
e AS (SELECT doc_id, pos, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, lag(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM t),"""
_COUNTED = """
u AS (SELECT word, CAST(count(*) AS DOUBLE) AS n FROM {0} GROUP BY word),
b AS (SELECT prev, word, CAST(count(*) AS DOUBLE) AS n FROM {0} WHERE prev IS NOT NULL GROUP BY prev, word),"""
_TRIGRAMS = """
g AS (SELECT prior, prev, word, CAST(count(*) AS DOUBLE) AS n FROM {0} WHERE prior IS NOT NULL GROUP BY prior, prev, word),"""
_SUM = """
SELECT d.doc_id, CAST(count(s.l) AS BIGINT) AS n_words, round(coalesce(sum(s.l), 0), 4) AS log_score,
  round(sum(s.l) / nullif(count(s.l), 0), 6) AS mean_log_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
ORACLES = {
    "op6_lm_scoring": (_SPLIT + _COUNTED + _TRIGRAMS).format("e")
    + """
s AS (
  SELECT e.doc_id, CASE WHEN g.n IS NOT NULL THEN ln(g.n / c.n) WHEN b.n IS NOT NULL THEN ln(b.n / p.n) + CASE WHEN e.prior IS NULL THEN 0 ELSE ln(CAST(0.4 AS DOUBLE)) END
    ELSE ln(u.n / (SELECT sum(n) FROM u)) + CASE WHEN e.prev IS NULL THEN 0 WHEN e.prior IS NULL THEN ln(CAST(0.4 AS DOUBLE)) ELSE 2 * ln(CAST(0.4 AS DOUBLE)) END END AS l
  FROM e JOIN u ON u.word = e.word LEFT JOIN b ON b.prev = e.prev AND b.word = e.word LEFT JOIN u p ON p.word = e.prev
    LEFT JOIN b c ON c.prev = e.prior AND c.word = e.prev LEFT JOIN g ON g.prior = e.prior AND g.prev = e.prev AND g.word = e.word)"""
    + _SUM,
    "op6_lm_scoring_all": (_SPLIT + _COUNTED).format("e")
    + """
s AS (
  SELECT e.doc_id, CASE WHEN b.n IS NOT NULL THEN ln(b.n / p.n) WHEN e.prev IS NULL THEN ln(u.n / (SELECT sum(n) FROM u))
    ELSE ln(CAST(0.4 AS DOUBLE) * u.n / (SELECT sum(n) FROM u)) END AS l
  FROM e JOIN u ON u.word = e.word LEFT JOIN b ON b.prev = e.prev AND b.word = e.word LEFT JOIN u p ON p.word = e.prev)"""
    + _SUM,
    "op6_lm_scoring_backoff": _SPLIT
    + "\nf AS (SELECT * FROM e WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),"
    + (_COUNTED + _TRIGRAMS).format("f")
    + """
s AS (
  SELECT e.doc_id, CASE WHEN g.n IS NOT NULL THEN ln(g.n / c.n) WHEN b.n IS NOT NULL THEN ln(b.n / p.n) + CASE WHEN e.prior IS NULL THEN 0 ELSE ln(CAST(0.4 AS DOUBLE)) END
    ELSE ln(coalesce(u.n, CAST(0.5 AS DOUBLE)) / greatest(1, (SELECT coalesce(sum(n), 0) FROM u)))
      + CASE WHEN e.prev IS NULL THEN 0 WHEN e.prior IS NULL THEN ln(CAST(0.4 AS DOUBLE)) ELSE 2 * ln(CAST(0.4 AS DOUBLE)) END END AS l
  FROM e LEFT JOIN u ON u.word = e.word LEFT JOIN b ON b.prev = e.prev AND b.word = e.word LEFT JOIN u p ON p.word = e.prev
    LEFT JOIN b c ON c.prev = e.prior AND c.word = e.prev LEFT JOIN g ON g.prior = e.prior AND g.prev = e.prev AND g.word = e.word)"""
    + _SUM,
}
