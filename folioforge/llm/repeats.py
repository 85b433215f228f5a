"""Suffix-array dedup: removes the bytes that a repeated string of `LENGTH` bytes covers, wherever its copies are.

Texts are UTF-8 bytes and windows are all their substrings of LENGTH bytes. Windows are cut into segments: runs of
neighbours with the same least hash of a GRAM-byte string (their anchor), so equal windows always have equal anchors.
Segments with equal bytes are counted, not compared: all windows of a segment that occurs twice are repeated. Segments
that differ but have an anchor in common, or hold theirs twice, meet in blocks, whose suffix arrays (linear grouping) tell
the repeated windows.
An anchor with many segments is dealt over blocks; there, windows with the same anchor among longer grams meet by digest.

Only segment numbers travel for text that does not repeat. Null and empty texts, and those shorter than LENGTH, keep all.
Repeated rows are copies of each other: all their windows repeat. Rows with one doc_id, or none, are rows each. Extra
columns are ignored. An empty table gives no rows. Segments and windows are told apart by 128 bits of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import staged
from folioforge.llm.shingles import U, mix
from folioforge.llm.suffixes import repeated

LENGTH, GRAM = 400, 128
#: Grams of the anchors within an anchor's windows, where it has several blocks.
LONG_GRAM = 384
#: Grams of a window, and the most windows of a segment.
SPAN = LENGTH - GRAM + 1
#: Windows read at a time, segments of one anchor in a block, bytes of blocks that are sorted together.
CHUNK, BLOCK, SORTED = 1 << 20, 512, 1 << 19
#: A run is a long: its first window, and the number of them in the last 10 bits.
RUN_BITS = 10


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + LENGTH, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 2**64))
BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def anchors(text: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of at most CHUNK the least hash of its grams; and the hashes."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[text] * UP[: len(text)], dtype=np.uint64)))
    grams, span = mix((sums[gram:] - sums[:-gram]) * DOWN[: len(text) - gram + 1]), LENGTH - gram + 1
    n = len(grams) - span + 1
    rows = np.concatenate((grams, np.full(-len(grams) % span, U(2**64 - 1)))).reshape(-1, span)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1 : span - 1 + n]), grams


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: first window, number of windows, anchor, and whether the anchor's gram is in it twice."""
    data = np.frombuffer(text, np.uint8)
    out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.bool_)]]
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        a, grams = anchors(data[at : at + CHUNK + LENGTH - 1])
        begin = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
        since = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        begin = np.flatnonzero(since % SPAN == 0)
        count = np.diff(np.append(begin, len(a)))
        twice = [np.count_nonzero(grams[b : b + c + SPAN - 1] == v) > 1 for b, c, v in zip(begin.tolist(), count.tolist(), a[begin])]
        out.append([begin + at, count, a[begin], np.array(twice, dtype=np.bool_)])
    return tuple(np.concatenate(x) for x in zip(*out))


def digests(parts: list) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc and k (a row's key: equal for repeated rows only), and the bytes of the text."""
    text = F.coalesce("text", F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(-1)).alias("doc"), F.xxhash64(doc, text).alias("k"), text.cast("binary").alias("body"))


def segments(rows: DataFrame) -> DataFrame:
    """doc, k, run, anchor, d1 and d2 (the digest of the segment's bytes), twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = body.as_py()
                begin, count, anchor, twice = cut(body)
                for a in range(0, len(begin), 10000):
                    b = slice(a, a + 10000)
                    view = memoryview(body)
                    d = digests([view[x : x + n + LENGTH - 1] for x, n in zip(begin[b].tolist(), count[b].tolist())])
                    size = len(d)
                    cols = [np.full(size, doc, np.int64), np.full(size, k, np.int64), (begin[b] << RUN_BITS) + count[b], anchor[b].view(np.int64), d[:, 0], d[:, 1], twice[b]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "k", "run", "anchor", "d1", "d2", "twice"])

    return rows.filter(F.length("body") >= LENGTH).select("doc", "k", "body").mapInArrow(run, "doc long, k long, run long, anchor long, d1 long, d2 long, twice boolean")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each wanted segment of a document, with its bytes."""
    names = ["anchor", "block", "blocks", "n", "doc", "k", "run", "body"]
    for batch in batches:
        for doc, k, body, wanted in zip(*(batch.column(c) for c in range(4))):
            doc, k, body, wanted = doc.as_py(), k.as_py(), body.as_py(), wanted.as_py()
            for at in range(0, len(wanted), 5000):
                some = wanted[at : at + 5000]
                begin = [w["run"] >> RUN_BITS for w in some]
                parts = [body[a : a + (w["run"] & 1023) + LENGTH - 1] for a, w in zip(begin, some)]
                cols = [pa.array([w[c] for w in some], pa.int64()) for c in ("anchor", "block", "blocks", "n")]
                cols += [pa.array([doc] * len(some), pa.int64()), pa.array([k] * len(some), pa.int64()), pa.array([w["run"] for w in some], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)


FOUND = "doc long, k long, run long, sub long, windows array<struct<run: bigint, d1: bigint, d2: bigint, n: int>>"
WINDOW = pa.struct([("run", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32())])


def _subs(bodies: list[bytes], string: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For windows in order of string and start: the anchor among their long grams."""
    out = np.empty(len(string), dtype=np.int64)
    begin = np.flatnonzero(np.diff(string, prepend=-1))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(string)]):
        out[a:b] = anchors(np.frombuffer(bodies[string[a]], np.uint8), LONG_GRAM)[0].view(np.int64)[start[a:b]]
    return out


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; and for anchors in several blocks, a row for each long anchor of a segment.

    That row holds the windows with that anchor: of each class in the block its first one, with the digest, and how
    often it occurs (2: at least twice, so it is in a run already).
    """

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, blocks, n, doc, k, run, body = zip(*rows)
        string, start, label = repeated(list(body), LENGTH)
        count = np.bincount(label)[label]
        doc, k, first = np.array(doc), np.array(k), np.array(run) >> RUN_BITS

        def in_order(chosen: np.ndarray) -> np.ndarray:
            chosen = np.flatnonzero(chosen)
            return chosen[np.lexsort((start[chosen], string[chosen]))]

        at = in_order(count > 1)
        s, p = string[at], start[at]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(s)))
        s, p = s[begin], p[begin]
        none = [pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.list_(WINDOW))]
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(k[s]), pa.array(((first[s] + p) << RUN_BITS) + size), *none], ["doc", "k", "run", "sub", "windows"])

        at = in_order((np.array(blocks)[string] > 1) & (np.diff(label, prepend=-1) > 0))
        if not len(at):
            return
        s, p = string[at], start[at]
        sub = _subs(body, s, p)
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (sub[1:] != sub[:-1])
        begin = np.flatnonzero(new)
        d = digests([body[x][y : y + LENGTH] for x, y in zip(s.tolist(), p.tolist())])
        times = np.maximum(count[at], np.array(n)[s]).clip(1, 2).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(((first[s] + p) << RUN_BITS) + 1), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(times)], fields=list(WINDOW))
        windows = pa.ListArray.from_arrays(pa.array(np.append(begin, len(s)), pa.int32()), each)
        of = s[begin]
        yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(k[of]), pa.nulls(len(of), pa.int64()), pa.array(sub[begin]), windows], ["doc", "k", "run", "sub", "windows"])

    held, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
            if size >= SORTED and row[:2] != key:
                yield from done(held)
                held, size = [], 0
            key = row[:2]
            held.append(row)
            size += len(row[7])
    if held:
        yield from done(held)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc, k, run: runs of windows that occur elsewhere too; all of them, some perhaps more than once."""
    rows = keyed(docs)
    seg = staged(segments(rows), "segments")
    parts = [F.first(c).alias(c) for c in ("doc", "k", "run", "twice")]
    classes = staged(seg.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), *parts), "segment-classes")
    copied = seg.join(classes.filter("n > 1").select("anchor", "d1", "d2"), ["anchor", "d1", "d2"], "left_semi").select("doc", "k", "run")
    shared = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).filter("c > 1 or twice").select("anchor", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    block = F.pmod(F.col("d1"), F.col("blocks"))
    wanted = classes.join(shared, "anchor").select("doc", "k", F.struct("anchor", block.alias("block"), "blocks", F.least("n", F.lit(2)).cast("long").alias("n"), "run").alias("w"))
    wanted = wanted.groupBy("doc", "k").agg(F.collect_set("w").alias("wanted"))
    schema = "anchor long, block long, blocks long, n long, doc long, k long, run long, body binary"
    drawn = rows.join(wanted, ["doc", "k"]).select("doc", "k", "body", "wanted").mapInArrow(_fetch, schema)
    found = staged(drawn.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(_sort_blocks, FOUND), "repeats")
    subs = found.filter("sub is not null").select("doc", "k", "sub", "windows")
    meet = subs.groupBy("sub").agg(F.count("*").alias("c")).filter("c > 1").select("sub")
    wide = staged(subs.join(meet, "sub", "left_semi").select("doc", "k", F.inline("windows")), "windows")
    again = wide.groupBy("d1", "d2").agg(F.sum("n").alias("total")).filter("total > 1").select("d1", "d2")
    across = wide.filter("n = 1").join(again, ["d1", "d2"], "left_semi").select("doc", "k", "run")
    return copied.unionByName(found.filter("run is not null").select("doc", "k", "run")).unionByName(across)


def covered(runs: list[int]) -> list[tuple[int, int]]:
    """Byte spans that the windows of the runs cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for run in sorted(runs):
        a = run >> RUN_BITS
        b = a + (run & 1023) + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, body (bytes of the text), spans (array of begin and end of removed bytes), kept (the other bytes)."""
    runs = repeated_runs(docs).groupBy("doc", "k").agg(F.collect_set("run").alias("runs"))
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, bodies, kept, spans = batch.column(0), batch.column(1), [], []
                for body, got in zip(bodies.to_pylist(), batch.column(2).to_pylist()):
                    gone = covered(got or [])
                    ends = [0, *(x for s in gone for x in s), len(body)]
                    kept.append(b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2])))
                    spans.append([{"begin": a, "end": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays([ids, bodies, pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "body", "spans", "kept"])

    joined = keyed(docs).join(runs, ["doc", "k"], "left").select("doc_id", "body", "runs")
    return joined.mapInArrow(run, "doc_id long, body binary, spans array<struct<begin: bigint, end: bigint>>, kept binary")
