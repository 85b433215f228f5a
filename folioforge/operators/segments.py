"""Documents to ordered segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_windows(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, ordinal, text: windows of `size` words that overlap, within each second-level heading's section."""
    step = size - overlap
    s = docs.select("doc_id", F.posexplode(F.split("text", "\n(?=## )")).alias("part", "section"))
    s = s.select("doc_id", "part", F.filter(F.split("section", "[ \\n\\t\\r]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    s = s.select("doc_id", "part", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("window", "text"))
    return s.select("doc_id", "part", "window", "text")


def fixed_slices(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ordinal, text: slices of `size` characters without overlap."""
    d = docs.filter(F.length("text") > 0)
    at = F.sequence(F.lit(1), F.length("text"), F.lit(size))
    return d.select("doc_id", F.posexplode(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(size)))).alias("ordinal", "text"))


def islands(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """key, first, last, label: runs of consecutive rows with the same label."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_new", new).withColumn("_run", run)
    return r.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(label).alias(label)).drop("_run")
