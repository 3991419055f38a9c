"""The split into rows to learn from and rows held out, and bounded samples of the former."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hash60


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5 (a null id counts as the empty text, whose crc32 is 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` rows for each value of ``by`` (not null) at most, chosen by hashed doc_id: the same rows on every run. No shuffle of the rows."""
    counted = rows.groupBy(by).agg(F.count("*").alias("n")).collect()  # one number a value
    if not counted:
        return rows
    rates = F.create_map(*[F.lit(x) for r in counted for x in (r[by], min(1.0, most / r["n"]))])
    return rows.where(hash60(F.lit("sample"), F.col("doc_id")) < F.element_at(rates, F.col(by)) * float(1 << 60))
