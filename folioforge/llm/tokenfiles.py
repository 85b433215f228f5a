"""Token ids in Arrow files of fixed-size lists: equal-length sequences with masks, readable at any position without copying.

One logical stream: the documents in ascending id order, each its ids and then an end id. It is cut into files by
ranges of doc_id; a file holds sequences of `width` ids (16 bits each where the vocabulary allows) and masks (a bit each: false for
the padding of the last row). Nulls and empty texts: the end id alone. Repeated rows are all written; rows
with the same doc_id stand in the order of their texts. A null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import portions, shared_path, staged, tidy
from folioforge.llm.fasttok import PreTokenEncoder

INDEX = "part int, row long, doc_id long, path string, at long, n_tokens long"


def open_file(path: str):
    """A file of any store; local ones are mapped into memory."""
    from pyarrow import fs

    if path.startswith("file:"):
        return pa.memory_map(path.removeprefix("file://").removeprefix("file:"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class SequenceWriter:
    """Writes ids as record batches of fixed-size lists to one Arrow file; memory is one batch."""

    def __init__(self, path: str, width: int, kind: type = np.uint32, rows: int = 256):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.width, self.block, self.parts, self.held, self.count = width, width * rows, [], 0, 0
        self.kind = kind
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), width)), ("mask", pa.list_(pa.bool_(), width))])
        self.sink = store.open_output_stream(name)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.count += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.parts)
            full = len(flat) // self.width * self.width
            self._write(flat[:full], full)
            self.parts, self.held = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, n: int) -> None:
        for at in range(0, len(flat), self.block):
            part = flat[at : at + self.block]
            mask = np.arange(at, at + len(part)) < n
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (part.astype(self.kind), mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.parts, np.zeros(0, np.uint32)]).astype(np.uint32)
        n = len(flat)
        self._write(np.concatenate((flat, np.zeros(-n % self.width, np.uint32))), n)
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to the ids of a file: sequence k is a view into its batch."""

    def __init__(self, path: str):
        self.reader = pa.ipc.open_file(open_file(path))
        self.width = self.reader.schema.field("ids").type.list_size
        self.starts = None

    def _begin(self) -> None:
        sizes = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence k: slices of the mapped file, without a copy."""
        if self.starts is None:
            self._begin()
        b = int(np.searchsorted(self.starts, k, side="right")) - 1
        batch, row = self.reader.get_batch(b), k - int(self.starts[b])
        return tuple(batch.column(i).flatten().slice(row * self.width, self.width) for i in (0, 1))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position start; they may cross sequences and batches."""
        if self.starts is None:
            self._begin()
        out = []
        while n > 0:
            b = int(np.searchsorted(self.starts, start // self.width, side="right")) - 1
            at = start - int(self.starts[b]) * self.width
            part = self.reader.get_batch(b).column(0).flatten().to_numpy()[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint32)])


def write_sequences(docs: DataFrame, vocabulary: str, end_id: int = 0, width: int = 2048, rows_per_file: int = 20_000) -> DataFrame:
    """Write the stream; the index of documents: part (file number), row, doc_id, path, at (in its file), n_tokens.

    A task that is run again writes a file of its own, and the index names the one of the task that counted.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "sequences")
    files = max(1, -(-docs.count() // rows_per_file))
    dealt = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, writer, row = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.arrow", None, 0
        encoder = PreTokenEncoder(vocabulary, keep_spaces=True)
        end = np.array([end_id], dtype=np.uint32)
        for batch in portions(batches, 1):
            if writer is None:
                small = max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
                writer = SequenceWriter(path, width, np.uint16 if small else np.uint32)
            ids = batch.column(0).to_pylist()
            at, n = [], []
            for got in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                at.append(writer.count)
                writer.add(np.concatenate((got, end)))
                n.append(writer.count - at[-1])
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), pa.array(ids, pa.int64()), pa.array([path] * k), pa.array(at, pa.int64()), pa.array(n, pa.int64())], [x.split()[0] for x in INDEX.split(", ")])
            row += k
        if writer is not None:
            writer.close()

    return staged(dealt.mapInArrow(tidy(run), INDEX), "sequence-index")


def read_documents(index: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. The per-file totals are summed, not the documents."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    joined = index.join(before, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, SequenceFile] = {}
        for batch in batches:
            got = batch.to_pydict()
            crc = []
            for path, at, n in zip(got["path"], got["at"], got["n_tokens"]):
                if path not in opened:
                    opened = {path: SequenceFile(path)}
                crc.append(zlib.crc32(np.ascontiguousarray(opened[path].ids(at, n), dtype="<u4").tobytes()))
            start = [a + b for a, b in zip(got["at"], got["before"])]
            yield pa.RecordBatch.from_arrays([pa.array(got["doc_id"], pa.int64()), pa.array(start, pa.int64()), pa.array(got["n_tokens"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
