"""A training corpus from documents: language, exact and near copies, source mix, packing.

Each stage works on all rows the one before kept, and is written and read again before the next; what it wrote on the way
is deleted then. Before a stage the executors give back the heap that the one before it took. All columns of documents stay, whatever their names, up to the last stage, which gives pieces. Null and
empty texts have no language and go in the first stage. Ties, and rows that repeat a doc_id, are told apart as in each
operator: the first by doc_id, null last, then by text. An empty table gives no rows, stage by stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import exact, jaccard, langid, mixing, packing
from folioforge.llm.common import collected, forget, settled, table
from folioforge.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; the others (no text, no letter) go."""
    return langid.accepted(docs, langid.labelled_samples(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones."""
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often, and as much of them, as it takes."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.best_fit(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))


def rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun on executors whose heaps hold only what is in use."""

    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(name, rested(stage)) for name, stage in (("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("packing", packed))]
#: Near copies, the automata and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda d=docs, s=stage: s(spark, d, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
