"""Relations between concepts: upsert, neighbours; passages in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text


def relation_id(s: Column, p: Column, o: Column) -> Column:
    return text.short_hash(F.concat_ws(":", text.concept_key(s), p, text.concept_key(o)), 16)


def upsert(candidates: DataFrame) -> DataFrame:
    """One row for each (subject key, predicate, object key): id, best confidence in 0..1, evidence count."""
    c = candidates.filter("trim(subject) != '' and trim(object) != ''")
    c = c.withColumn("conf", F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))
    rid = relation_id(F.col("subject"), F.col("predicate"), F.col("object"))
    return c.groupBy(rid.alias("relation_id")).agg(F.max("conf").alias("confidence"), F.count("*").alias("evidence"))


def neighbours(edges: DataFrame) -> DataFrame:
    """edges (a, b, confidence), undirected: node, neighbour, best confidence."""
    both = edges.select("a", "b", "confidence").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    return both.groupBy(F.col("a").alias("node"), F.col("b").alias("neighbour")).agg(F.max("confidence").alias("confidence"))


def mentions(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """item_id, doc_id: documents whose text holds a phrase (item_id, phrase), anywhere, character by character.

    A word inside a phrase (not its first or last) is a whole word of any text that holds it, so phrases meet documents on
    their longest inner word, by number alone, and the text is joined back for the pairs that meet. Phrases without an
    inner word are few and are looked for in every text.
    """
    split = lambda c: F.split(c, r"[^\p{L}\p{N}]+")
    inner = F.filter(F.slice(split(F.col("phrase")), F.lit(2), F.greatest(F.size(split(F.col("phrase"))) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    p = phrases.filter("phrase != ''").withColumn("word", longest)
    keys = p.filter("word is not null").select("item_id", "word")
    words = docs.select("doc_id", F.explode(F.array_distinct(split(F.col("text")))).alias("word"))
    met = words.join(keys, "word").select("doc_id", "item_id").distinct()
    held = F.contains("text", "phrase")
    texts = docs.select("doc_id", "text")
    found = met.join(texts, "doc_id").join(p.select("item_id", "phrase"), "item_id").filter(held).select("item_id", "doc_id")
    short = p.filter("word is null").select("item_id", "phrase")
    if not short.isEmpty():
        found = found.unionByName(texts.join(short, held).select("item_id", "doc_id"))
    return found.distinct()
