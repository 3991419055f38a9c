"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are taken in the order of that key up to the source's budget,
after as many whole epochs as the budget holds. The prefix sums of token counts are distributed (``running_total``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import hash60, n_blocks, running_total, table, written

MAX_EPOCHS = 3
_NULL, _NAME = "__source_null", "__source_name"


def token_count(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: int = 3) -> DataFrame:
    """From (__source_null, __source_name, source_size), one row a source, add ``target``.

    Sources in code-point order, null last, weigh 1, 2, ... ``cycle`` and again. They share the total size by weight; no
    target exceeds ``max_epochs`` times its source's size, the excess going to the others by weight until none is above.
    In the order of cap / weight, a source is at its cap exactly if its cap is at most its share of what those before it
    left over, so two running sums give the fixed point. The windows run over one row a source, not over documents.
    """
    named = sizes.withColumn("__w", ((F.row_number().over(Window.orderBy(_NULL, _NAME)) - 1) % cycle + 1).cast("double"))
    capped = named.withColumn("__cap", F.col("source_size").cast("double") * max_epochs)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("__cap") / F.col("__w"), _NULL, _NAME).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    shares = (
        capped.withColumn("__total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(order), zero))
        .withColumn("__weights", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(order), zero))
        .withColumn("__full", F.col("__cap") / F.col("__w") <= F.col("__left") / F.col("__weights"))
    )
    open_ = F.sum(F.when(F.col("__full"), zero).otherwise(F.col("__w"))).over(everything)
    rest = F.col("__total") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(zero)).over(everything)
    return shares.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__w") * rest / open_)).select(_NULL, _NAME, "source_size", "target")


def mix(sized: DataFrame, ties: list[str], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add source_size, target and ``taken`` (words taken, repeats counted) to a written table of (source, size, __key, ...).

    Every row is kept; rows that the mix leaves out have taken 0, the row at the cut is taken in part. A source of any
    share of all rows is summed in blocks. Equal rows tie on ``__key`` and ``ties`` and are interchangeable.
    """
    blocks = n_blocks(sized.sparkSession, sized.count())
    named = sized.withColumn(_NULL, F.col("source").isNull()).withColumn(_NAME, F.coalesce("source", F.lit("")))
    targets = source_targets(named.groupBy(_NULL, _NAME).agg(F.sum("size").alias("source_size")), max_epochs)
    placed = running_total(named, [_NULL, _NAME], "__key", ties, F.col("size"), "__before", blocks)
    budget, whole = F.floor("target"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long")
    rest = budget - epochs * whole
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__before")))
    return placed.join(targets, [_NULL, _NAME]).withColumn("taken", taken.cast("long")).drop(_NULL, _NAME, "__before")


def mix_key(doc_id: Column, text: Column) -> Column:
    """The hash-random order of the mix; null ids are spread by their text."""
    return hash60(F.lit("mix"), doc_id, F.md5(F.coalesce(text, F.lit(""))))


def repeat_mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) as often as the mix takes them, all columns as they are.

    The document at a source's cut counts as taken if at least half of its words are inside the budget. Rows that are equal
    in id and text tie: all are taken as often as the first of them, so that a source of such rows may pass its budget. Only keys, sizes
    and sources are shuffled; the texts stay where they are read, joined to the small table of cuts: within a source
    the mix takes the keys up to one cut once more than the others.
    """
    key = mix_key(F.col("doc_id"), F.col("text"))
    sized = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("size"), key.alias("__key")), "mix-sizes")
    times = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)).cast("int")
    mixed = mix(sized, ["doc_id", "size"], max_epochs).where("size > 0").select("source", "__key", times.alias("__times"))
    cuts = mixed.groupBy("source").agg(F.min("__times").alias("__least"), F.max(F.struct("__times", "__key")).alias("__m"))
    rule = written(cuts.select(F.col("source").alias("__source"), "__least", F.col("__m.__times").alias("__most"), F.col("__m.__key").alias("__end")), "mix-cuts")
    d = docs.withColumn("__key", key).withColumn("__size", token_count(F.col("text")))
    d = d.join(rule, d["source"].eqNullSafe(rule["__source"]))
    n = F.when(F.col("__size") == 0, 0).when(F.col("__key") <= F.col("__end"), F.col("__most")).otherwise(F.col("__least"))
    return d.withColumn("__copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; null text has size 0 and is taken 0 times, a null source is a source of its own."""
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", token_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("__key")), "op2-sizes")
    return mix(sized, ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, source IS NULL AS n, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
    CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0) AS remains,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weights
  FROM s WINDOW o AS (ORDER BY cap / w, n, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, cap / w <= remains / weights AS is_full FROM r),
g AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM t),
p AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
j AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, p.before, CAST(floor(g.target) AS BIGINT) AS budget,
    CASE WHEN g.source_size > 0 THEN CAST(floor(floor(g.target) / g.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM j
"""
}
