"""A training-corpus pipeline over ``documents``: language, near copies, leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Null ids are ids, null texts
are texts without words, null sources are a source; repeated rows count as often as they are there until the near copies
go. An empty table passes through all stages as an empty table, and other columns than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import decontamination, language_id, minhash_dedup, mixing, sharding
from fluvia.llm._common import discard, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a language: null texts, texts without a letter and texts of which no language has half go.

    Repeated rows stay or go alike. Without a labelled document to learn from there is no language, and all go.
    """
    model = language_id.learn(docs)
    return language_id.keep_identified(docs.select(*COLUMNS), model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the least id (a null id only where all are null), repeated rows once."""
    return minhash_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, all rows of an id that leaks. Without benchmark items all stay."""
    return decontamination.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (the one at a source's cut if at least half of it is inside); 0 times: left out.

    Rows that are equal in id and text are taken equally often, as often as the first of them.
    """
    return mixing.repeat_mixed(docs.select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 40; rows of one id, also those of the null id, share a shard."""
    return sharding.assign_shards(docs.select(*COLUMNS), sharding.even_topology(40))


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("benchmark decontamination", leaks), ("mixing sources to target weights", mixture), ("sharding", shards)]
#: Language models, signatures and templates are beyond SQL: tests/llm holds the stages after the language against a
#: brute-force version, and the language's plain version against op8.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread before the next; a stage's table is deleted once the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
