"""Connected components by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """id and label (smallest id of the component) of every id that an edge (u, v) has, but for the labels themselves.

    In turn, larger neighbours and smaller neighbours of each id are hung on its least neighbour; this ends with one star
    for each component after about as many rounds as the logarithm of its width. Each round is written to the shared
    folder. Edges of an id with itself count for nothing.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    e = staged(e, name)
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # ids without a larger neighbour hang on nothing here; their own least neighbour is kept by the other end's star
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        hung = large.join(least, F.col("u") == F.col("k"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        e = staged(small.filter("u != v").distinct(), name)
        now = _mark(e)
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = now
