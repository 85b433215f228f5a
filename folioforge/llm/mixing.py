"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every row of the input is a document of its own, repeated rows too. A null or empty text has size 0 and takes 0. A null
source is a source. Ties in the seeded order go to the smaller doc_id, then the smaller size. Extra columns, of any name, are ignored.
An empty table, or one without words, takes nothing (targets are 0). Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import looked_up, staged, unused, word_count

#: Hash ranges of a source over which sizes are summed before rows are ordered: only one range of each source is.
RANGES = 65536


def seeded(seed: int) -> Column:
    """A number from 0 to 2^60 - 1 for a document, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) plus target.

    A source's target is the least of max_epochs times its size and its weight times one level. The level is the one
    at which the targets come to share times all sizes: with sources ordered by the level at which they are full,
    those before it are full, and running sums give it without a loop. This is where clamping and resharing ends.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    s = sources.withColumn("w", weight).withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("w"))
    w = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("caps", F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("ws", F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("caps")) / F.col("ws"))
    # the first source in this order that the level of its own suffix does not fill sets the level
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return s.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def parameters(rows: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """For each source s of rows (source, size, range): its size, target, n (rows), whole takes, rest, and the range (cut) where the rest ends."""
    ranges = staged(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.count("*").alias("n")), "ranges")
    sizes = staged(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"), F.sum("n").alias("n")), "source-sizes")
    sources = water_fill(sizes.drop("n"), weights, share, max_epochs).join(sizes.select(F.col("source").alias("t"), "n"), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    sources = staged(sources, "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = (F.floor(F.col("target")) - whole * F.col("source_size")).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", rest).withColumnRenamed("source", "s")
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    cut = ranges.drop("n").withColumn("before", F.sum("range_size").over(w) - F.col("range_size")).join(sources.drop("n"), F.col("source").eqNullSafe(F.col("s")))
    cut = cut.filter("before < rest and before + range_size >= rest").select(F.col("s").alias("cs"), F.col("range").alias("cut"), "before")
    return staged(sources.join(cut, F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs"), "source-cuts")


def with_taken(rows: DataFrame, params: DataFrame, total: int) -> DataFrame:
    """rows (doc_id, source, size, u, range, others) with their source's parameters and taken."""
    full = looked_up(rows, params, "source", "s", "n", total)
    edge = full.filter("range = cut")
    inner = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.sum("size").over(inner) + F.col("size"))))
    others = full.filter("cut is null or range != cut").withColumn("extra", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(others).withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    rows = docs.select("doc_id", "source", word_count().alias("size"), seeded(seed).alias("u"), *more)
    return rows.withColumn("range", (F.col("u") / F.lit((1 << 60) // RANGES)).cast("int"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken.

    Each document is taken whole as often as its source's target holds the source; of the rest, documents are taken in
    the seeded order until it is used up, the last one in part. Sizes are first summed by hash range, so only the one
    range of each source where its rest ends is put in order. Sources with many rows reach them by broadcast.
    """
    rows = staged(_sized(docs, seed), "sizes")
    params = parameters(rows, weights, share, max_epochs)
    return with_taken(rows, params, rows.count()).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_sql(weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> str:
    """The same in DuckDB's SQL, over a view documents."""
    cases = " ".join(f"when {k} then {float(w)}" for k, w in enumerate(weights))
    return f"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
  cast('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as u from documents),
s as (select source, cast(sum(size) as double) as n, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, case k % {len(weights)} {cases} end as w, {float(max_epochs)} * n as cap from s),
r as (select *, cap / w as full_at from w),
p as (select *, sum(cap) over (order by full_at, source nulls last rows unbounded preceding) - cap as caps,
  sum(w) over (order by full_at, source nulls last rows between current row and unbounded following) as ws from r),
l as (select *, ({float(share)} * sum(n) over () - caps) / ws as level from p),
v as (select first(level order by full_at, source nulls last) filter (level <= full_at) as lv from l),
t as (select source, cast(n as bigint) as source_size, least(cap, coalesce(lv * w, cap)) as target from l, v),
x as (select d.*, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole,
  sum(size) over (partition by d.source order by u, doc_id, size rows unbounded preceding) - size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(whole * size + greatest(0, least(size, cast(floor(target) as bigint) - whole * source_size - before)) as bigint) as taken from x
"""


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, as they stand."""
    pieces = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"), F.lit(0))
    return F.rtrim(F.array_join(F.slice(pieces, 1, F.greatest(n, F.lit(0))), ""))


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs in the mix: a document taken 2.5 times is there 3 times, the last time with its first words.

    All columns stay, whatever their names; text and n_chars are of what was taken. Rows are matched by doc_id, source and
    size; of several rows with the same three, as many words are taken as of all of them together, in the order of their texts.
    """
    taken, doc, source, size, words, k, rank = unused(docs.columns, "_taken", "_doc", "_source", "_size", "_words", "_k", "_rank")
    keys = mixed.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size)).agg(F.sum("taken").alias(taken), F.count("*").alias(rank))
    keys = staged(keys.filter(F.col(taken) > 0), "taken")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    d = docs.withColumn(words, word_count())
    j = d.join(keys.filter(F.col(rank) == 1).drop(rank), same)
    repeated = keys.filter(F.col(rank) > 1)
    if not repeated.isEmpty():
        # The rows share the words taken of them: every one as often as all of them can, then one more time from the first on.
        more = d.join(repeated.withColumnRenamed(rank, k), same)
        at = F.row_number().over(Window.partitionBy("doc_id", "source", words).orderBy(F.xxhash64("text"), "text")) - 1
        more = more.withColumn(rank, at)
        each = F.floor(F.col(taken) / (F.col(k) * F.col(size)))
        left = F.col(taken) - each * F.col(k) * F.col(size) - F.col(rank) * F.col(size)
        more = more.withColumn(taken, (each * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), left))).cast("long")).drop(rank, k)
        j = j.unionByName(more.filter(F.col(taken) > 0))
    j = j.withColumn(k, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    part = (F.col(taken) - (F.col(k) - 1) * F.col(size)).cast("int")
    text = F.when(part >= F.col(size), F.col("text")).otherwise(first_words(F.col("text"), part))
    j = j.withColumn("text", text)
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7) -> DataFrame:
    """The documents of mix themselves: one taken 2.5 times is there 3 times, the last time with its first words.

    All columns stay, whatever their names; text and n_chars are of what was taken. Each row takes its own share, so rows
    that repeat are told apart, and no text is shuffled but in the range of each source that is put in order.
    """
    small = staged(_sized(docs, seed), "sizes")
    params = parameters(small, weights, share, max_epochs)
    rows = with_taken(_sized(docs, seed, F.struct(*docs.columns).alias("record")), params, small.count()).filter("taken > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    part = (F.col("taken") - (F.col("k") - 1) * F.col("size")).cast("int")
    text = F.when(part >= F.col("size"), F.col("record.text")).otherwise(first_words(F.col("record.text"), part))
    rows = rows.select("record", text.alias("cut_text"))
    new = {"text": F.col("cut_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col("record")[c].alias(c) for c in docs.columns])
