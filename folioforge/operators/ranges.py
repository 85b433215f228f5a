"""Points in ranges, as an equi-join on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: str, width: int) -> DataFrame:
    """Rows of points with each row of ranges (first, last, both included; whole numbers) that holds `at`.

    Both sides meet on buckets of `width`; a range is in as many buckets as it touches, so width is best near the usual
    length of a range. Ranges whose ends are null or cross hold nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    r = ranges.filter("first <= last").withColumn("_bucket", F.explode(F.sequence(bucket("first"), bucket("last"))))
    p = points.withColumn("_bucket", bucket(at))
    return p.join(r, "_bucket").filter(F.col(at).between(F.col("first"), F.col("last"))).drop("_bucket")
