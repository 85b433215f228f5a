"""Best-fit packing of token sequences.

Nulls and empty texts: an empty text is its end id alone. A null id stays null. Repeated rows are packed once each.
Ties: of bins with the same free space the one opened last takes the piece. Extra columns of the input are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import portions, staged, tidy
from folioforge.llm.fasttok import PreTokenEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most `limit` open bins of `size` tokens, found by the bits of an integer: bit f is set while a bin with f free is open.

    A piece goes to the bin with the least free space that holds it. When too many are open the fullest closes.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> int:
        at = self.free[f].pop()
        if not self.free[f]:
            self.bits ^= 1 << f
        self.open -= 1
        return at

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of 0 < length <= size."""
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            at = self._take(f)
        else:
            f, at = self.size, self.made
            self.made += 1
        left = f - length
        if left:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return at, self.size - f


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Pieces of at most `size` tokens of each document: its ids, then end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PreTokenEncoder(vocabulary, keep_spaces=False)
        end = np.array([end_id], dtype=np.uint32)
        for batch in portions(batches, 1, 64 << 10):
            ids = batch.column(0).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            for doc, got in zip(ids, encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                got = np.concatenate((got, end)).astype("<u4")
                for piece, start in enumerate(range(0, len(got), size)):
                    part = got[start : start + size]
                    for c, v in zip(cols, (doc, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def best_fit(pieces: DataFrame, size: int = 4096, open_bins: int = 4096, group_rows: int = 1_000_000) -> DataFrame:
    """pieces (with `length`, 1 to size) plus sequence_id and offset, by bounded-space online best-fit.

    Pieces are dealt by a hash to groups of about group_rows; each group is one online run in an order fixed by that
    hash, so reruns agree and memory is the open bins. A group leaves at most open_bins sequences part full.
    """
    pieces = staged(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    columns = pieces.columns
    mixed = F.xxhash64(*columns)
    dealt = (
        pieces.withColumn("_h", mixed)
        .withColumn("_g", F.pmod(F.col("_h"), F.lit(groups)).cast("int"))
        .repartition(groups, "_g")
        .sortWithinPartitions("_g", "_h", *columns)
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, OpenBins] = {}
        for batch in batches:
            seq, off = [], []
            for g, n in zip(batch.column(batch.schema.get_field_index("_g")).to_pylist(), batch.column(batch.schema.get_field_index("length")).to_pylist()):
                if g not in bins:
                    bins = {g: OpenBins(size, open_bins)}  # groups come one after another
                at, offset = bins[g].place(n)
                seq.append((g << 40) + at)
                off.append(offset)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*columns, "sequence_id", "offset"])

    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")
