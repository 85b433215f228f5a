"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in vertical layout, one row for each dimension. Scores are accumulated block of dimensions by block; what
the rest can still add is at most the product of the two remaining norms, so a candidate whose best case is under the
k-th best worst case is gone, and the survivors are compacted before the next block.

Vectors that are null, or hold a null or non-finite component, take no part; neither do rows with a null id. A query
does not find rows with its own id. Repeated candidate rows are candidates each; queries are distinct rows. Vectors of
different lengths are compared over the common part. Ties go to the smaller id. Extra columns are ignored. Scores are
exact while sums stay under 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import staged, tidy


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as a double, of usable vectors."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    return vectors.filter(usable).select(F.col("vec_id").cast("long"), whole.alias("v"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows x dimensions of a list column; shorter rows end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), wide))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Columns:
    """Candidates in vertical layout with the norms of what remains after each block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int):
        self.ids, self.block = ids, block
        self.cols = np.ascontiguousarray(rows.T)
        self.rest = tail_norms(rows, block)

    def search(self, qid: int, q: np.ndarray, q_rest: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of candidates that may be among the k best and reach floor."""
        n, dims = len(self.ids), min(len(q), len(self.cols))
        alive, acc = np.flatnonzero(self.ids != qid), np.zeros(n)[self.ids != qid]
        for b, at in enumerate(range(0, dims, self.block)):
            part = self.cols[at : at + self.block]
            part = part if len(alive) == n else part[:, alive]
            acc = acc + q[at : min(at + self.block, dims)] @ part[: dims - at]
            slack = q_rest[b + 1] * self.rest[b + 1][alive]
            if len(alive) > k:
                low = acc - slack
                floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
            keep = acc + slack >= floor - 1e-6 * (1.0 + abs(floor))
            if not keep.all():
                alive, acc = alive[keep], acc[keep]
        return alive, acc


def tail_norms(rows: np.ndarray, block: int) -> np.ndarray:
    """At [b]: norm of each row from dimension b * block on."""
    sums = np.zeros((rows.shape[1] + 1, len(rows)))
    sums[:-1] = np.cumsum((rows**2)[:, ::-1], axis=1).T[::-1]
    steps = [min(x, rows.shape[1]) for x in range(0, rows.shape[1] + 2 * block, block)]
    return np.sqrt(sums[steps]) * (1 + 1e-12)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 8, query_rows: int = 8192, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates.

    Queries go to the executors in blocks of at most about 2 * query_rows vectors (the size of what is broadcast), one
    pass over the candidates for each block. A task sends on k rows for each query. What a block finds is written to the
    shared folder and its broadcast destroyed before the next, so the driver holds one block.
    """
    spark = vectors.sparkSession
    rows = staged(scaled(vectors, scale), "vectors")
    queries = rows.filter(is_query).distinct()
    blocks = max(1, -(-queries.count() // query_rows))
    queries = staged(queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "query-blocks")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = None
    for b in range(blocks):
        got = queries.filter(F.col("b") == b).select("vec_id", "v").toArrow()
        col = got.column("v").combine_chunks()
        col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
        sent = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), matrix(col)))
        found = rows.mapInArrow(tidy(_searcher(sent, k, block)), "query_id long, vec_id long, score long")
        part = staged(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "best")
        sent.destroy()
        best = part if best is None else best.unionByName(part)
    return best.select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        rest = tail_norms(q, block).T
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        floors = np.full(len(ids), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            cand = Columns(batch.column(0).to_numpy(), matrix(batch.column(1), q.shape[1] if len(ids) else 0), block)
            for i in range(len(ids)):
                at, score = cand.search(int(ids[i]), q[i], rest[i], k, floors[i])
                if len(at):
                    v = np.concatenate((held[i][0], cand.ids[at]))
                    s = np.concatenate((held[i][1], np.rint(score).astype(np.int64)))
                    o = np.lexsort((v, -s))[:k]
                    held[i] = (v[o], s[o])
                    if len(o) == k:
                        floors[i] = float(s[o[-1]])
        n = [len(v) for v, _ in held]
        if sum(n):
            cols = (np.repeat(ids, n), np.concatenate([v for v, _ in held]), np.concatenate([s for _, s in held]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run
