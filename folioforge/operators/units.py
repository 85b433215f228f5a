"""Greedy packing of ordered pieces, page groups, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(lengths: Column, most: int, joiner: int, first_joined: bool) -> Column:
    """For an array of lengths in order, the number of the unit each piece goes to, from 0.

    A piece starts a unit where the one before would grow over `most`; each piece adds `joiner`, the first of a unit
    only where first_joined. A piece is never cut.
    """
    none = F.struct(F.array().cast("array<int>").alias("units"), F.lit(0).cast("long").alias("filled"))

    def step(acc: Column, n: Column) -> Column:
        empty = F.size(acc["units"]) == 0
        last = F.when(empty, F.lit(0)).otherwise(F.element_at(acc["units"], -1))
        grown = acc["filled"] + n + joiner
        new = ~empty & (grown > most)
        alone = n + (joiner if first_joined else 0)
        return F.struct(F.concat(acc["units"], F.array(F.when(new, last + 1).otherwise(last).cast("int"))).alias("units"), F.when(empty | new, alone).otherwise(grown).cast("long").alias("filled"))

    return F.aggregate(lengths, none, step, lambda acc: acc["units"])


def packed_units(pieces: DataFrame, key: str, order: str, most: int, joiner: int = 2, first_joined: bool = True) -> DataFrame:
    """pieces (key, order, n: length) with unit. The pieces of one key are folded in one row: a document's, not a corpus's."""
    rows = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "n"))).alias("all"))
    units = greedy(F.transform("all", lambda s: s["n"].cast("long")), most, joiner, first_joined)
    each = rows.select(key, F.explode(F.arrays_zip(F.col("all"), units.alias("units"))).alias("z"))
    return each.select(key, F.col("z.all")[order].alias(order), F.col("z.all.n").alias("n"), F.col("z.units").alias("unit"))


def page_groups(pages: DataFrame, key: str, order: str, slug: str) -> DataFrame:
    """key, first, last, slug: runs of neighbouring pages with the same slug; a page without one is a group by itself."""
    w = Window.partitionBy(key).orderBy(order)
    new = (F.col(slug).isNull() | ~F.col(slug).eqNullSafe(F.lag(slug).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("_new", new).withColumn("_run", run).groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(slug).alias(slug)).drop("_run")


def contents_groups(entries: DataFrame, last_page: Column) -> DataFrame:
    """entries (doc, n, slug, page) of a table of contents to ranges: doc, n, slug, first, last.

    A range ends before the next entry's page, the last one at last_page; a slug that comes again gets -2, -3 and so on.
    """
    w = Window.partitionBy("doc").orderBy("n")
    k = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("n"))
    slug = F.when(k > 1, F.concat_ws("-", "slug", k.cast("string"))).otherwise(F.col("slug"))
    out = entries.withColumn("first", F.col("page")).withColumn("last", F.coalesce(F.lead("page").over(w) - 1, last_page)).withColumn("slug", slug)
    return out.select("doc", "n", "slug", "first", "last").filter("first <= last")


def within_budget(parts: DataFrame, key: str, order: str, body: str, each: int, total: int) -> DataFrame:
    """Parts cut at `each` characters, as many in order as fit into `total`; the one that crosses it is cut there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    short = F.substring(F.col(body), 1, each)
    rows = parts.withColumn(body, short).withColumn("_upto", F.sum(F.length(body)).over(w))
    left = F.lit(total) - (F.col("_upto") - F.length(body))
    return rows.filter(left > 0).withColumn(body, F.substring(F.col(body), F.lit(1), left.cast("int"))).drop("_upto")
