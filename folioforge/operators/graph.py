"""Candidates of relations, the closed graph, and its export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text

#: The predicates that a relation may have.
PREDICATES = ("depends_on", "part_of", "causes", "prevents", "contrasts_with", "is_example_of", "implemented_by", "requires", "supports", "violates", "tradeoff_with", "related_to", "extends", "disagrees_with", "replicates", "improves_on", "cites", "cited_by")


def valid(candidates: DataFrame) -> DataFrame:
    """Candidates with two ends and a known predicate; confidence 0.5 where there is none, and within 0 to 1."""
    ends = (F.trim("subject") != "") & (F.trim("object") != "")
    return candidates.filter(ends & F.col("predicate").isin(*PREDICATES)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))))


def closed(candidates: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations whose ends both stand for a concept (names: label_key, concept), and the candidates left over."""
    s, o = names.select(F.col("label_key").alias("sk"), F.col("concept").alias("s")), names.select(F.col("label_key").alias("ok"), F.col("concept").alias("o"))
    j = candidates.join(s, text.concept_key(F.col("subject")) == F.col("sk"), "left").join(o, text.concept_key(F.col("object")) == F.col("ok"), "left")
    kept = j.filter("s is not null and o is not null and s != o").groupBy("s", "predicate", "o").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))
    return kept, j.filter("s is null or o is null or s = o").select("subject", "predicate", "object")


def export(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (s, predicate, o) with both ends among nodes (concept)."""
    n = nodes.select("concept")
    return relations.join(n, F.col("s") == F.col("concept"), "left_semi").join(n, F.col("o") == F.col("concept"), "left_semi")
