"""What a run still has to do, and what it offers: notes to read again, seeds, topics, pairs to merge, names that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text

#: States of a note that was read, categories of a failure and what they are reported as.
READ = ("ingested", "compiled")
REASONS = {"truncated": "truncated", "no_sources": "missing_sources", "structured_output": "llm_output", "bad_request": "llm_output", "context_too_large": "llm_output", "other": "unknown"}
#: A text under both has no topics to offer.
LEAST_CHARS, LEAST_WORDS = 80, 12


def to_read(notes: DataFrame, records: DataFrame, prompt_version: str) -> DataFrame:
    """notes (path, content_hash) but those that a record (path, content_hash, status, prompt_version) says were read as they are now."""
    done = records.filter(F.col("status").isin(*READ) & (F.col("prompt_version") == prompt_version)).select("path", "content_hash")
    return notes.join(done, ["path", "content_hash"], "left_anti")


def seeded(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """path, concepts: the seeds (path, content_hash, concepts) of notes that have not changed since."""
    return notes.select("path", "content_hash").join(seeds, ["path", "content_hash"]).select("path", "concepts")


def suggested_topics(notes: DataFrame) -> DataFrame:
    """path, topic: suggested topics of notes (path, quality, topics, body) whose text is long enough.

    No noise; at low and medium quality only topics that path or body show.
    """
    chars, words = text.text_stats(F.col("body"))
    each = notes.filter((chars >= LEAST_CHARS) | (words >= LEAST_WORDS)).select("path", "quality", "body", F.explode("topics").alias("topic"))
    shown = ~F.col("quality").isin("low", "medium") | text.has_evidence(F.col("topic"), F.col("body"), F.col("path"))
    return each.filter(~text.is_noise(F.col("topic")) & F.coalesce(shown, F.lit(True))).select("path", "topic")


def merge_candidates(pairs: DataFrame, preferred: DataFrame) -> DataFrame:
    """entity_a, entity_b, surface: pairs (entity_x, entity_y, surface) in the order of their preferred keys, each once.

    preferred: entity_id, label_key. An entity without a preferred label has the empty key.
    """
    key = lambda side: preferred.select(F.col("entity_id").alias(side), F.col("label_key").alias(f"key_{side}"))
    two = pairs.filter("entity_x != entity_y").join(key("entity_x"), "entity_x", "left").join(key("entity_y"), "entity_y", "left")
    x, y = (F.struct(F.coalesce(f"key_entity_{s}", F.lit("")).alias("k"), F.col(f"entity_{s}").alias("e")) for s in "xy")
    return two.select(F.least(x, y)["e"].alias("entity_a"), F.greatest(x, y)["e"].alias("entity_b"), "surface").distinct()


def related_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, related: names one of which has an alias (name, alias) that is the other, or whose first word of several is; both ways.

    Case does not count; of names that differ by it alone the last one is meant.
    """
    known = names.groupBy(F.lower("name").alias("key")).agg(F.max("name").alias("other"))
    low = F.lower("alias")
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    a = aliases.select("name", low.alias("whole"), F.when(F.size(words) > 1, words[0]).alias("first")).distinct()
    other = lambda c: known.select(F.col("key").alias(c), F.col("other").alias(f"by_{c}"))
    hit = a.join(other("whole"), "whole", "left").join(other("first"), "first", "left")
    not_own = lambda c: F.when(F.col(c) != F.col("name"), F.col(c))
    one = hit.select("name", F.coalesce(not_own("by_whole"), not_own("by_first")).alias("related")).filter("related is not null")
    return one.unionByName(one.select(F.col("related").alias("name"), F.col("name").alias("related"))).distinct()


def export_aliases(aliases: DataFrame, words: int = 4) -> DataFrame:
    """name, alias without paths, aliases of more than `words` words and those whose key several names have."""
    kept = aliases.filter(~F.contains("alias", F.lit("/")) & (F.regexp_count("alias", F.lit(r"\S+")) <= words))
    keyed = text.with_keys(aliases, "alias", "key", "fold")
    several = keyed.groupBy("key").agg(F.countDistinct("name").alias("n")).filter("n > 1").select("key")
    return text.with_keys(kept, "alias", "key", "fold").join(several, "key", "left_anti").select("name", "alias").distinct()


def failure_reason(payload: Column) -> tuple[Column, Column]:
    """Reason (null if it tells none) and message of a failure, told as a JSON object; any other payload is the message."""
    v = F.try_parse_json(payload)
    told = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    field = lambda name: F.when(told, F.try_variant_get(v, f"$.{name}", "string"))
    reason = F.coalesce(*[F.when(field("reason") == k, r) for k, r in REASONS.items()])
    return reason, F.coalesce(F.nullif(field("message"), F.lit("")), payload)
