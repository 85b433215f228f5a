"""Scores, gates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotations(confidence: Column, sources: Column, low: Column) -> Column:
    """Names of the warnings that a draft carries."""
    return F.array_compact(F.array(F.when(confidence < 0.4, "low-confidence"), F.when(sources < 2, "single-source"), F.when((sources > 0) & low, "low-quality-sources")))


def publishable(confidence: Column, threshold: float) -> Column:
    return F.coalesce(confidence, F.lit(1.0)) >= threshold


def output_budget(prompt_chars: Column, context: int, cap: int, floor: int = 512, reserve: int = 256) -> Column:
    """Tokens left for the answer after a prompt of that many characters (four to a token); null where fewer than floor are."""
    free = F.lit(context) - F.greatest(F.lit(1), F.floor(prompt_chars / 4)) - reserve
    return F.when(free >= floor, F.greatest(F.lit(floor), F.least(F.lit(cap), free)))


def blocked(rejections: DataFrame, cap: int = 5, shown: int = 3) -> DataFrame:
    """rejections (concept, at, feedback): concept, n, blocked, and the newest feedbacks, newest first."""
    k = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("at"), F.desc("feedback")))
    last = F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "feedback"))))
    out = rejections.withColumn("k", k).groupBy("concept").agg(F.count("*").alias("n"), last.alias("last"))
    return out.select("concept", "n", (F.col("n") >= cap).alias("blocked"), F.array_join(F.transform("last", lambda s: s["feedback"].cast("string")), ",").alias("feedback"))


def query_score(expected: Column, pages: Column, phrases: Column, answer: Column) -> Column:
    """Mean of the pages' F1 and the share of phrases in the answer; what is not expected doesn't count, null if nothing is."""
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    both = F.size(F.array_intersect(low(expected), low(pages)))
    f1 = F.when(F.size(expected) > 0, F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(low(expected)) + F.size(low(pages)))))
    held = F.when(F.size(phrases) > 0, F.size(F.filter(phrases, lambda p: F.contains(F.lower(answer), F.lower(p)))) / F.size(phrases))
    n = F.when(f1.isNull(), 0).otherwise(1) + F.when(held.isNull(), 0).otherwise(1)
    return F.when(n > 0, (F.coalesce(f1, F.lit(0.0)) + F.coalesce(held, F.lit(0.0))) / n)


def verdict(worst: Column, mean: Column, links: Column, orphans: Column, lint: Column, queries: Column, moved: Column, partial: Column) -> Column:
    """keep_current, switch or manual_review from the differences challenger - current (null: not known)."""
    under = lambda c: F.coalesce(c < -0.05, F.lit(False))
    over = lambda c, x=0.0: F.coalesce(c > x, F.lit(False))
    keep = partial | F.coalesce(worst < -0.10, F.lit(False)) | F.coalesce(mean <= -0.05, F.lit(False)) | under(links) | under(orphans) | under(lint)
    better = over(mean) | over(links) | over(orphans) | over(lint)
    return F.when(keep, "keep_current").when(queries == 0, "manual_review").when(over(mean, 0.10), "switch").when(moved & better, "switch").otherwise("manual_review")


def split_suggestions(sources: DataFrame, least_sources: int = 3, low: float = 0.05, mean: float = 0.1) -> DataFrame:
    """sources (concept, source, words: array): concepts that hold a pair of sources with almost no common word, though they share some.

    Pairs are counted, not made: their number follows from the number of sources, and word sets are compared once within a
    concept however many sources have them, if they share a word. Rows of one source are not paired, nor rows without one.
    """
    s = sources.filter(F.size("words") > 0).select("concept", "source", F.array_sort(F.array_distinct("words")).alias("words"))
    rows = s.groupBy("concept", "source").agg(F.count("*").alias("r"))
    named = F.when(F.col("source").isNotNull(), F.col("r")).otherwise(0)
    n = rows.groupBy("concept").agg(F.sum("r").alias("n"), ((F.sum(named) * F.sum(named) - F.sum(named * named)) / 2).alias("every")).filter((F.col("n") >= least_sources) & (F.col("every") > 0))
    both = F.size(F.array_intersect("a.words", "b.words"))
    score = both / (F.size("a.words") + F.size("b.words") - both)

    known = s.filter("source is not null")
    sets = known.groupBy("concept", "words").agg(F.count("*").alias("r"), F.min("source").alias("first"), F.max("source").alias("last"))
    e = sets.select("*", F.explode("words").alias("word"))
    a, b = e.alias("a"), e.alias("b")
    met = a.join(b, (F.col("a.concept") == F.col("b.concept")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.words") < F.col("b.words")))
    met = met.filter(F.col("a.word") == F.array_intersect("a.words", "b.words")[0])
    several = (F.least("a.first", "b.first") < F.greatest("a.last", "b.last")).alias("several")
    across = met.select("a.concept", (F.col("a.r") * F.col("b.r")).alias("pairs"), score.alias("score"), several)
    within = sets.select("concept", (F.col("r") * (F.col("r") - 1) / 2).alias("pairs"), F.lit(1.0).alias("score"), (F.col("first") < F.col("last")).alias("several"))

    again = known.join(rows.filter("r > 1").select("concept", "source"), ["concept", "source"], "left_semi").groupBy("concept", "source", "words").agg(F.count("*").alias("r"))
    a, b = again.alias("a"), again.alias("b")
    own = a.join(b, (F.col("a.concept") == F.col("b.concept")) & (F.col("a.source") == F.col("b.source")) & (F.col("a.words") <= F.col("b.words")))
    twin = F.col("a.words") == F.col("b.words")
    own = own.select("a.concept", F.when(twin, F.col("a.r") * (F.col("a.r") - 1) / 2).otherwise(F.col("a.r") * F.col("b.r")).alias("pairs"), score.alias("score"), F.lit(False).alias("several")).filter("score > 0")

    c = across.unionByName(within).unionByName(own.withColumn("pairs", -F.col("pairs")))
    g = c.groupBy("concept").agg(F.sum("pairs").alias("pairs"), F.min(F.when(F.col("several"), F.col("score"))).alias("least"), F.sum(F.col("pairs") * F.col("score")).alias("total")).join(n, "concept")
    g = g.withColumn("least", F.when(F.col("pairs") < F.col("every"), 0.0).otherwise(F.col("least"))).withColumn("mean", F.col("total") / F.col("every"))
    return g.filter((F.col("least") < low) & (F.col("mean") > mean)).select("concept", F.round("least", 2).alias("least"), F.round("mean", 2).alias("mean"))
