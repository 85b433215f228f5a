"""Changes to entities, and the route from a surface to an entity.

labels: entity_id, label, role (preferred or alias), origin (preferred, user, rename, extracted, legacy), label_key, match_key.
Aliases of origin user or rename are blessed, the others weak. edges: source, entity_id. denials: entity_id, label_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLESSED = ("user", "rename")


def by_key(labels: DataFrame, key: str, name: str) -> DataFrame:
    """key, name (the entity, where one alone has the key), name_n (how many have)."""
    return labels.groupBy(F.col(key).alias(f"{name}_key")).agg(F.countDistinct("entity_id").alias(f"{name}_n"), F.min("entity_id").alias(name)).withColumn(name, F.when(F.col(f"{name}_n") == 1, F.col(name)))


def alias_entities(labels: DataFrame, blessed: bool) -> DataFrame:
    """label_key, entity_id of blessed or of weak aliases."""
    is_blessed = F.col("origin").isin(*BLESSED)
    return labels.filter((F.col("role") == "alias") & (is_blessed if blessed else ~is_blessed)).select("label_key", "entity_id").distinct()


def classify(surfaces: DataFrame, labels: DataFrame) -> DataFrame:
    """surfaces (surface, label_key, match_key): route and entity.

    In order: the one entity with that preferred label, exactly, then by fold; the one with a blessed alias; ambiguous,
    where several have one of these; the one with a weak alias; else a new one, the same for all surfaces with one fold.
    """
    pref = labels.filter("role = 'preferred'")
    s = surfaces.join(by_key(pref, "label_key", "exact"), F.col("label_key") == F.col("exact_key"), "left")
    s = s.join(by_key(pref, "match_key", "fold"), F.col("match_key") == F.col("fold_key"), "left")
    for name, blessed in (("blessed", True), ("weak", False)):
        s = s.join(by_key(alias_entities(labels, blessed), "label_key", name), F.col("label_key") == F.col(f"{name}_key"), "left")
    several = (F.coalesce("exact_n", F.lit(0)) > 1) | (F.coalesce("fold_n", F.lit(0)) > 1) | (F.coalesce("blessed_n", F.lit(0)) > 1)
    route = F.when(F.col("exact").isNotNull(), "preferred").when(F.col("exact_key").isNull() & F.col("fold").isNotNull(), "preferred").when(F.col("blessed").isNotNull(), "blessed").when(several | (F.coalesce("weak_n", F.lit(0)) > 1), "ambiguous").when(F.col("weak").isNotNull(), "weak").otherwise("new")
    entity = F.when(route == "preferred", F.coalesce("exact", "fold")).when(route == "blessed", F.col("blessed")).when(route == "weak", F.col("weak"))
    return s.select("surface", route.alias("route"), entity.alias("entity_id"), F.when(route == "new", F.col("match_key")).alias("new_key"))


def sticky(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (source, surface, entity_id: all candidates): the one candidate that the source is already linked to."""
    j = found.join(edges.select("source", "entity_id").distinct(), ["source", "entity_id"], "left_semi")
    return j.groupBy("source", "surface").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1").drop("n")


def upsert_aliases(old: DataFrame, new: DataFrame, denials: DataFrame) -> DataFrame:
    """entity_id, label_key, label, origin: the better origin of each alias; what is denied to an entity stays away from it."""
    rank = F.when(F.col("origin").isin(*BLESSED), 1).otherwise(0)
    both = old.select("entity_id", "label_key", "label", "origin", F.lit(1).alias("old")).unionByName(new.select("entity_id", "label_key", "label", "origin", F.lit(0).alias("old")))
    best = both.groupBy("entity_id", "label_key").agg(F.max(F.struct(rank.alias("rank"), "old", "label", "origin")).alias("b"))
    return best.select("entity_id", "label_key", F.col("b.label").alias("label"), F.col("b.origin").alias("origin")).join(denials, ["entity_id", "label_key"], "left_anti")


def collides(labels: DataFrame) -> DataFrame:
    """entity_id, label_key of aliases that are another entity's preferred label."""
    other = labels.filter("role = 'preferred'").select(F.col("label_key").alias("k"), F.col("entity_id").alias("other")).distinct()
    return labels.filter("role = 'alias'").join(other, (F.col("label_key") == F.col("k")) & (F.col("entity_id") != F.col("other")), "left_semi").select("entity_id", "label_key").distinct()


def merged(labels: DataFrame, edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and edges after losers became their winners (moves: loser, winner, already followed to the end).

    A loser's labels become blessed aliases of the winner, but for the winner's own preferred key; of equal ones the
    blessed stays. Edges move, each once.
    """
    j = labels.join(moves, F.col("entity_id") == F.col("loser"), "left")
    moved = F.col("winner").isNotNull()
    role = F.when(moved, "alias").otherwise(F.col("role"))
    origin = F.when(moved, "rename").otherwise(F.col("origin"))
    x = j.select(F.coalesce("winner", "entity_id").alias("entity_id"), "label", role.alias("role"), origin.alias("origin"), "label_key", "match_key")
    order = F.when(F.col("role") == "preferred", 2).when(F.col("origin").isin(*BLESSED), 1).otherwise(0)
    best = x.groupBy("entity_id", "label_key").agg(F.max(F.struct(order.alias("o"), "label", "role", "origin", "match_key")).alias("b"))
    out = best.select("entity_id", F.col("b.label").alias("label"), F.col("b.role").alias("role"), F.col("b.origin").alias("origin"), "label_key", F.col("b.match_key").alias("match_key"))
    e = edges.join(moves, F.col("entity_id") == F.col("loser"), "left").select("source", F.coalesce("winner", "entity_id").alias("entity_id")).distinct()
    return out, e


def split(edges: DataFrame, senses: DataFrame) -> DataFrame:
    """Edges after the entity of senses (entity_id, source, sense_id) went over to its senses; sources without one lose the link."""
    gone = senses.select("entity_id").distinct()
    own = edges.join(senses, ["entity_id", "source"]).select("source", F.col("sense_id").alias("entity_id"))
    return edges.join(gone, "entity_id", "left_anti").select("source", "entity_id").unionByName(own).distinct()


def unmerged(labels: DataFrame, undone: DataFrame) -> DataFrame:
    """entity_id, label_key, role: labels of a merge's log (undone: winner, loser, label_key, role) go back to the losers.

    A label that other merges gave the same winner stays with it too.
    """
    back = undone.select(F.col("loser").alias("entity_id"), "label_key", "role")
    shared = undone.groupBy("winner", "label_key").agg(F.countDistinct("loser").alias("n")).filter("n = 1").select(F.col("winner").alias("entity_id"), "label_key")
    return labels.select("entity_id", "label_key", "role").join(shared, ["entity_id", "label_key"], "left_anti").unionByName(back).distinct()


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with `column` renamed by names (old, new)."""
    return rows.join(names, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def alias_edits(aliases: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases (entity_id, label_key) and denials after edits (at, op: add or remove, entity_id, label_key); the last edit of a pair counts."""
    last = edits.groupBy("entity_id", "label_key").agg(F.max_by("op", F.struct("at", "op")).alias("op"))
    kept = aliases.join(last.filter("op = 'remove'"), ["entity_id", "label_key"], "left_anti").select("entity_id", "label_key")
    return kept.unionByName(last.filter("op = 'add'").select("entity_id", "label_key")).distinct(), last.filter("op = 'remove'").select("entity_id", "label_key")


def lookup(terms: DataFrame, labels: DataFrame, limit_to_contains: bool = True) -> DataFrame:
    """terms (term, key) with the entity: by exact key of any label, preferred first, else the least label that begins with the term's words.

    The fall-back meets on the first word of the label: whole words, not any part of one.
    """
    rank = F.when(F.col("role") == "preferred", 0).otherwise(1)
    exact = labels.groupBy(F.col("label_key").alias("k")).agg(F.min(F.struct(rank.alias("r"), "entity_id")).alias("e"))
    j = terms.join(exact, F.col("key") == F.col("k"), "left").select("term", "key", F.col("e.entity_id").alias("exact"))
    first = lambda c: F.split(F.col(c), " ")[0]
    p = labels.filter("role = 'preferred'").select("label_key", "entity_id", first("label_key").alias("w"))
    part = j.filter("exact is null").withColumn("w", first("key")).join(p, "w").filter(F.startswith(F.concat("label_key", F.lit(" ")), F.concat("key", F.lit(" "))))
    part = part.groupBy("term").agg(F.min(F.struct("label_key", "entity_id")).alias("m")).select(F.col("term").alias("t"), F.col("m.entity_id").alias("part"))
    return j.join(part, F.col("term") == F.col("t"), "left").select("term", F.coalesce("exact", "part").alias("entity_id"))


def occurrences(found: DataFrame) -> DataFrame:
    """found (source, surface, entity_id or null): status and the candidates of each."""
    g = found.groupBy("source", "surface").agg(F.array_sort(F.collect_set("entity_id")).alias("c"))
    status = F.when(F.size("c") == 1, "resolved").when(F.size("c") > 1, "ambiguous").otherwise("unresolved")
    return g.select("source", "surface", status.alias("status"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("candidates"))


def minted(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Weak aliases (entity_id, label_key) that stay once names (label_key) are preferred labels of new entities."""
    return alias_entities(labels, False).join(names.select("label_key").distinct(), "label_key", "left_anti").select("entity_id", "label_key")


def single_source(links: DataFrame) -> DataFrame:
    """links (concept, path, uri): single: one distinct address if every source has one, else one distinct path."""
    g = links.groupBy("concept").agg(F.count("*").alias("n"), F.count("uri").alias("u"), F.countDistinct("uri").alias("du"), F.countDistinct("path").alias("dp"))
    return g.select("concept", F.when(F.col("n") == F.col("u"), F.col("du") == 1).otherwise(F.col("dp") == 1).alias("single"))


def first_candidates(names: DataFrame, key: str = "doc_id") -> DataFrame:
    """names (key, k, name_key, alias_keys) without those whose key an earlier kept one has as an alias.

    The candidates of one document are folded in order in one row.
    """
    rows = names.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "name_key", "alias_keys"))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(acc, x):
        again = F.array_contains(acc["seen"], x["name_key"])
        return F.struct(F.when(again, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["k"].cast("int")))).alias("kept"), F.when(again, acc["seen"]).otherwise(F.concat(acc["seen"], x["alias_keys"])).alias("seen"))

    kept = rows.select(key, F.explode(F.aggregate("all", start, step, lambda acc: acc["kept"])).alias("k"))
    return kept


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
