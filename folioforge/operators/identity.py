"""Labels and the entities they stand for."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioforge.functions import text

#: Most words of a label that is compared by sizes, places where it meets labels of one size, entities of a label in a block.
SHORT, SUBSETS, MEMBERS = 12, 64, 256


def keyed(labels: DataFrame) -> DataFrame:
    """labels (entity_id, label, role) plus label_key and match_key."""
    return text.with_keys(labels, "label", "label_key", "match_key")


def resolve(surfaces: DataFrame, labels: DataFrame) -> DataFrame:
    """surfaces (surface) with status resolved, ambiguous or unresolved, and the one entity where there is one."""
    by_key = labels.groupBy("label_key").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity"))
    s = text.with_keys(surfaces, "surface", "key", "fold_key")
    j = s.join(by_key, s["key"] == by_key["label_key"], "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return j.select("surface", status.alias("status"), F.when(F.col("n") == 1, F.col("entity")).alias("entity_id"))


def resolve_preferred(surfaces: DataFrame, labels: DataFrame) -> DataFrame:
    """Against preferred labels: by exact key, and by the plural fold only where no exact key is there."""
    pref = labels.filter("role = 'preferred'")
    exact = pref.groupBy("label_key").agg(F.min("entity_id").alias("exact"))
    fold = pref.groupBy("match_key").agg(F.min("entity_id").alias("fold"), F.countDistinct("entity_id").alias("n"))
    s = text.with_keys(surfaces, "surface", "k", "m")
    j = s.join(exact, s["k"] == exact["label_key"], "left").join(fold, s["m"] == fold["match_key"], "left")
    return j.select("surface", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("fold")).alias("entity_id"))


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """Label keys of two entities or more."""
    return labels.groupBy("label_key").agg(F.countDistinct("entity_id").alias("entities")).filter("entities >= 2")


def alias_map(labels: DataFrame) -> DataFrame:
    """alias key -> entity, of alias keys that only one entity has and that are no entity's preferred key."""
    pref = labels.filter("role = 'preferred'").select("label_key").distinct()
    one = labels.filter("role = 'alias'").groupBy("label_key").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1")
    return one.join(pref, "label_key", "left_anti").select("label_key", "entity_id")


def fold_collisions(labels: DataFrame) -> DataFrame:
    """Pairs of entities whose preferred labels differ but fold to one key."""
    p = labels.filter("role = 'preferred'").select("entity_id", "label_key", "match_key").distinct()
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.match_key") == F.col("b.match_key")) & (F.col("a.entity_id") < F.col("b.entity_id")) & (F.col("a.label_key") != F.col("b.label_key")))
    return j.select(F.col("a.entity_id").alias("entity_a"), F.col("b.entity_id").alias("entity_b"), F.col("a.match_key").alias("match_key"))


def follow_merges(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """merges (loser, winner) to (entity, final), by pointer jumping; an entity on a cycle has no final one."""
    cur = merges.select(F.col("loser").alias("entity"), F.col("winner").alias("final"))
    for _ in range(rounds):
        hop = cur.select(F.col("entity").alias("e2"), F.col("final").alias("f2"))
        nxt = cur.join(hop, cur["final"] == hop["e2"], "left").select("entity", F.coalesce("f2", "final").alias("final"))
        cur = nxt.checkpoint()
        if cur.join(cur.select(F.col("entity").alias("e2")), F.col("final") == F.col("e2"), "left_semi").isEmpty():
            break
    left = cur.select(F.col("entity").alias("e2"))
    return cur.join(left, F.col("final") == F.col("e2"), "left_anti")


def _shared(least: float, n: int, m: int) -> int:
    """Fewest common words of two sets of n and m words with a Jaccard similarity of at least `least`."""
    return max(1, math.ceil(least / (1 + least) * (n + m) - 1e-9))


def _meetings(by: list[str], least: float) -> list[str]:
    """Where a word set (rarest first) meets similar ones: sizes of a pair, and words that both have; see merge_suggestions."""
    n, out = len(by), []
    for m in range(max(1, math.ceil(least * n - 1e-9)), min(SHORT, math.floor(n / least + 1e-9)) + 1) if n <= SHORT else ():
        o, most = _shared(least, n, m), max(n, m)
        k = max([min(2, o), *(k for k in range(1, o + 1) if math.comb(most - o + k, k) <= SUBSETS)])
        out += [" ".join((f"{min(n, m)}.{most}", *c)) for c in itertools.combinations(by[: n - o + k], k)]
    long = math.ceil(least * (SHORT + 1) - 1e-9)
    if n >= long:
        k = min(2, long)
        out += [" ".join(("long", *c)) for c in itertools.combinations(by[: n - math.ceil(least * n - 1e-9) + k], k)]
    return out


def merge_suggestions(labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of entities whose preferred labels fold to one key (1.0), or whose word sets have a Jaccard similarity of at least `least`.

    Labels are compared once however many entities have them; their entities are paired at the end, in blocks. Two labels
    of up to SHORT words with sizes n and m share at least o words, so they meet on k words among the n - o + k (m - o + k)
    rarest ones of each; mostly k is o, and only similar labels meet. Longer labels meet on pairs of their rarest words.
    Labels that meet at several places are scored at the one of their first common words.
    """
    preferred = labels.filter("role = 'preferred'")
    parts = max(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), labels.sparkSession.sparkContext.defaultParallelism)
    keys = F.first(F.struct("label_key", "match_key")).alias("k")  # not the grouping columns, so that every use below reads one exchange
    p = preferred.filter("label_key is not null and entity_id is not null").groupBy("label_key", "match_key").agg(keys, F.sort_array(F.collect_set("entity_id")).alias("all")).select("k.label_key", "k.match_key", "all")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / MEMBERS).cast("int")), lambda i: F.slice("all", i * MEMBERS + 1, MEMBERS))
    units = p.select("label_key", "match_key", F.explode(blocks).alias("members"))
    units = units.withColumns({"w": F.array_distinct(F.filter(F.split("label_key", " "), lambda w: F.length(w) > 1)), "id": F.struct(F.array_min("members").alias("e"), F.xxhash64("label_key", "match_key").alias("h"))})
    words = units.select("id", "label_key", "match_key", "members", F.explode("w").alias("t"))
    ranked = words.join(words.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("id").agg(*(F.first(c).alias(c) for c in ("label_key", "match_key", "members")), F.array_sort(F.collect_list(F.struct("df", "t")))["t"].alias("by"))

    @F.pandas_udf(ArrayType(StringType()))
    def meetings(by: pd.Series) -> pd.Series:
        return by.map(lambda b: _meetings(list(b), least))

    met = ranked.withColumns({"n": F.size("by"), "at": F.explode(meetings("by"))}).repartition(parts, "at")
    a, b = met.alias("a"), met.alias("b").hint("merge")
    folds = F.coalesce(F.col("a.match_key") == F.col("b.match_key"), F.lit(False)) & (F.col("a.label_key") != F.col("b.label_key"))
    common = F.array_intersect("a.by", "b.by")
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.id") < F.col("b.id")) & (low >= F.lit(least) * high - 1e-9) & ~folds)
    pairs = pairs.select("a.at", common.alias("common"), F.when(high <= SHORT, F.concat_ws(".", low, high)).otherwise("long").alias("head"), (F.col("a.n") + F.col("b.n")).alias("n"), F.col("a.members").alias("x"), F.col("b.members").alias("y"))
    first = F.concat_ws(" ", F.array("head"), F.slice("common", F.lit(1), F.size(F.split("at", " ")) - 1))
    both = F.size("common")
    scored = pairs.filter(F.col("at") == first).select("x", "y", (both / (F.col("n") - both)).alias("score")).filter(F.col("score") >= least)
    keyed_once = units.repartition(parts, "match_key")
    u, v = keyed_once.alias("a"), keyed_once.alias("b").hint("merge")
    folded = u.join(v, (F.col("a.match_key") == F.col("b.match_key")) & (F.col("a.label_key") != F.col("b.label_key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.members").alias("x"), F.col("b.members").alias("y"), F.lit(1.0).alias("score"))
    across = scored.unionByName(folded).select(F.round("score", 2).alias("score"), F.explode("x").alias("x"), "y").select("score", "x", F.explode("y").alias("y")).filter("x <> y")
    within = units.filter((F.size("w") > 0) & (F.size("members") > 1)).select(F.lit(1.0).alias("score"), F.explode("members").alias("x"), F.col("members").alias("y")).repartition(parts, "x").select("score", "x", F.explode("y").alias("y")).filter("x < y")
    out = across.unionByName(within).select(F.least("x", "y").alias("entity_a"), F.greatest("x", "y").alias("entity_b"), "score")
    if preferred.groupBy("entity_id").count().filter("count > 1").isEmpty():
        return out
    return out.groupBy("entity_a", "entity_b").agg(F.max("score").alias("score"))
