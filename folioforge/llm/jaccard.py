"""N-gram Jaccard join by PartEnum signatures, and the classes that its links make.

Documents link where their sets of five-word shingles have a Jaccard similarity of at least NUM / DEN. Sets are put into
size bands; sets of a band that are similar enough differ in at most k shingles. The domain of shingles is cut into
first-level parts, each into second-level parts, so many that some first-level part holds at most d differences: the two
sets agree on some subset of its second-level parts, and share that subset's signature. Sets that share a signature are
candidates. Small sets have one or two first-level parts and subsets that hold half their shingles or more; larger ones
have many, and pairs out of three. A candidate pair goes on if counts of shingles by range (its sketch) allow the similarity, first over 256
ranges, then over as many as half the set's size, and is verified on the full sets if it is not already in one class.

An agreement on two empty parts says little, so there are more first-level parts than needed: with SPARE good parts too
many, a set with at most SPARE parts that have an empty pair shares a signature that is not empty with any similar set,
and leaves its empty ones out. A set with more of them keeps all.

Null and empty texts have an empty set and link with nothing. Equal sets link. Repeated rows are rows each; the class id
is the smallest doc_id, nulls left out. Extra columns are ignored. An empty table gives no rows. Sets are told apart by
64 bits, shingles too; a false match takes about 4 billion different sets.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import portions, release, settled, sieved, staged, tidy, unused
from folioforge.llm.graph import components
from folioforge.llm.shingles import U, mix, set_number, shingle_sets

NUM, DEN = 4, 5
#: Bytes of a signature within its group, and of a set's number beside it: both only choose candidates.
KEY_BYTES, ID_BYTES = 4, 5
#: Sketches of one group, bytes of fine sketches and of full sets in half a group, and bits of the filter that says which sets are needed.
BLOCK, FINE_BYTES, SET_BYTES, FILTER_BITS = 32768, 4_000_000, 16_000_000, 1 << 23


def _bounds(limit: int = 1 << 40) -> np.ndarray:
    out = [0, 1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


#: Band b holds sizes over BOUNDS[b - 1] and up to BOUNDS[b].
BOUNDS = _bounds()


def bands(size: int) -> list[int]:
    """The bands in which a set of that size meets others: that of the larger of two similar sets."""
    b = int(np.searchsorted(BOUNDS, size))
    out = []
    while b < len(BOUNDS) and DEN * size >= NUM * (int(BOUNDS[b - 1]) + 1):
        out.append(b)
        b += 1
    return out


#: Up to this many differences a first-level part may hold where all its subsets are enumerated.
MOST = 4


def plan(band: int) -> tuple[int, int, int, int, int]:
    """Most differences k of similar sets in the band; first-level parts, second-level parts in each, how many a signature takes, spare parts.

    Of parts - spare first-level parts one holds at most d differences: any two sets agree there on (cells - d) of its
    cells. Small sets have few first-level parts and a larger d, so that those cells hold most of their shingles and are
    hardly ever empty.
    """
    k = 2 * int(BOUNDS[band]) * (DEN - NUM) // (DEN + NUM)
    if k <= 2 * MOST - 1:
        parts = 1 if k <= MOST else 2
        d = k // parts
        return k, parts, 2 * d + (d < MOST), d + (d < MOST), 0
    d = 2 if k <= 22 else 1
    need = k // (d + 1) + 1
    spare = 1 + need // 8 if d == 2 else need * 2 // 5
    return k, need + spare, 2 * d + 1, d + 1, spare


_SUBSETS = {(n, m): np.array(list(itertools.combinations(range(n), m))) for n in range(2, 2 * MOST + 2) for m in range(1, n)}
#: What each second-level part stands for within a signature.
_PLACES = mix(np.arange(1, 2 * MOST + 3, dtype=np.uint64)) | U(1)


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a sorted set."""
    out = []
    n = len(s)
    low, high = s & U(0xFFFFFFFF), s >> U(32)
    for band in bands(n):
        k, parts, cells, take, spare = plan(band)
        if k < 1:  # only equal sets
            continue
        m = parts * cells
        cell = ((mix(s + U(band * 0x9E3779B97F4A7C15 % 2**64)) >> U(20)) % U(m)).astype(np.int64)
        if n < 1 << 20:
            a = np.bincount(cell, weights=low, minlength=m).astype(np.uint64)
            b = np.bincount(cell, weights=high, minlength=m).astype(np.uint64)
        else:
            a, b = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            np.add.at(a, cell, low)
            np.add.at(b, cell, high)
        full = (np.bincount(cell, minlength=m) > 0).reshape(parts, cells)
        c = mix(a * U(0xC2B2AE3D27D4EB4F) + b * U(0x165667B19E3779F9) + U(1)).reshape(parts, cells) * _PLACES[:cells]
        sets = _SUBSETS[cells, take]
        sig = c[:, sets].sum(axis=2, dtype=np.uint64)
        place = np.arange(sig.size, dtype=np.uint64).reshape(sig.shape) + U(band << 40)
        sig = mix(sig ^ mix(place))
        some = full[:, sets].any(axis=2)
        out.append(sig[some] if int((~some).any(axis=1).sum()) <= spare else sig.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ranges(size: int) -> int:
    """Ranges of a set's fine sketch: a power of two, 256 at least, half its size or more."""
    return 1 << max(8, (size - 1).bit_length() - 1)


def sketch(s: np.ndarray, cells: int = 256) -> np.ndarray:
    """Shingles in each of a power of two of ranges, 255 at most. Sets differ in at least as many shingles as these counts do."""
    return np.minimum(np.bincount((s >> U(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h (number of the set), sketch, fine (null where it is the sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sets = shingle_sets(batch.column(1))
            fine = [packed(sketch(s, ranges(len(s)))) if ranges(len(s)) > 256 else None for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()), pa.array([packed(sketch(s)) for s in sets], pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", "n", "h", "sketch", "fine"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n long, h long, sketch binary, fine binary")


def widened(data: bytes, size: int) -> np.ndarray:
    """Numbers of `size` bytes each."""
    raw = np.zeros((len(data) // size, 8), dtype=np.uint8)
    raw[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return raw.view("<i8").ravel()


def stars(docs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """pivot and member: for each signature that several sets share, one of them, and each other one.

    Signatures travel packed, a row for each batch and group of signatures; total (shingles of all sets) sets the groups.
    They carry the low bytes of the set numbers (h of classes); every set with the same ones is taken for a candidate.
    """
    groups = max(1, -(-total // 1_500_000))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in portions(batches, 0):
            for at in range(0, whole.num_rows, 4000):
                numbers: dict[int, int] = {}
                sigs, owner = [], []
                for s in shingle_sets(whole.column(0).slice(at, 4000)):
                    h = set_number(s)
                    if len(s) and h not in numbers:
                        numbers[h] = len(numbers)
                        sigs.append(signatures(s))
                        owner.append(np.full(len(sigs[-1]), numbers[h], dtype=np.uint16))
                if not sigs:
                    continue
                sig, own = np.concatenate(sigs), np.concatenate(owner)
                del sigs, owner
                part = (sig % U(groups)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                key = (sig // U(groups))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                own, part = own[order], part[order]
                del sig, order
                edges = np.searchsorted(part, np.arange(groups + 1))
                ids = np.fromiter(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :ID_BYTES]
                for g in range(groups):
                    a, b = edges[g], edges[g + 1]
                    if b > a:
                        used, where = np.unique(own[a:b], return_inverse=True)
                        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.ascontiguousarray(ids[used]).tobytes()]), pa.array([np.ascontiguousarray(key[a:b]).tobytes()]), pa.array([where.astype("<u2").tobytes()])], ["g", "ids", "keys", "own"])

    def meet(t: pa.Table) -> pa.Table:
        keys, ids = [], []
        for i, k, o in zip(*(t.column(c).to_pylist() for c in ("ids", "keys", "own"))):
            keys.append(widened(k, KEY_BYTES).astype(np.uint32))
            ids.append(widened(i, ID_BYTES)[np.frombuffer(o, "<u2")])
        release()
        key, own = np.concatenate(keys), np.concatenate(ids)
        del keys, ids
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        del order
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        several = np.zeros(len(key), dtype=bool)
        several[:-1] |= ~new[1:]
        several[1:] |= ~new[1:]
        key, own = key[several], own[several]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else own
        keep = first != own
        pairs = np.unique(np.stack([first[keep], own[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        return pa.table({"pivot": pa.array(pairs[:, 0], pa.int64()), "member": pa.array(pairs[:, 1], pa.int64())})

    packed = docs.select("text").mapInArrow(tidy(pack), "g int, ids binary, keys binary, own binary")
    short = staged(packed.groupBy("g").applyInArrow(meet, "pivot long, member long").distinct(), "short-candidates")
    sets = classes.select("h", F.col("h").bitwiseAND(F.lit((1 << 8 * ID_BYTES) - 1)).alias("low"))
    found = short.join(sets.select(F.col("low").alias("pivot"), F.col("h").alias("p")), "pivot").join(sets.select(F.col("low").alias("member"), F.col("h").alias("m")), "member")
    alike = sets.groupBy("low").agg(F.collect_set("h").alias("all")).filter(F.size("all") > 1)  # a few numbers each: sets are told apart by 64 bits
    alike = alike.select(F.array_min("all").alias("pivot"), F.explode("all").alias("member")).filter("pivot != member")
    return found.select(F.col("p").alias("pivot"), F.col("m").alias("member")).unionByName(alike).distinct()


def needed(ids: DataFrame, classes: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over (set number, first document) of the sets with these ids."""
    first = F.coalesce(F.col("rep"), F.lit(-1))  # as full_sets has it for rows without a doc_id
    slot = F.col("h").bitwiseXOR(first).bitwiseXOR(F.shiftleft(first, 17)).bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = ids.join(classes, ids["id"] == classes["h"]).select(slot.alias("s")).distinct()
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for w, bits in words.collect():  # at most FILTER_BITS / 64 rows
        out[w] = bits
    return out


def full_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """h and the set (bytes) of the documents that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in portions(batches, 1):
            out_h, out_s = [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if len(s):
                    h, doc = set_number(s), -1 if doc is None else doc
                    slot = (h ^ doc ^ (doc << 17)) & (FILTER_BITS - 1)
                    if int(words[slot >> 6]) >> (slot & 63) & 1:
                        out_h.append(h)
                        out_s.append(s.tobytes())
            if out_h:
                yield pa.RecordBatch.from_arrays([pa.array(out_h, pa.int64()), pa.array(out_s, pa.binary())], ["h", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "h long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b)
    x = np.concatenate((a, b))
    x.sort()
    same = int((x[1:] == x[:-1]).sum())
    return DEN * same >= NUM * (both - same)


class Group:
    """Sets that are compared with one another: `lead` ones with all, the others with lead ones only.

    Sketches have 256 ranges, or as many as `ranges` says.
    """

    def __init__(self, ids: list[int], lead: list[bool], sizes: list[int], sketches: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
        self.order, self.ids, self.lead = order, [ids[i] for i in order], np.array([lead[i] for i in order])
        self.sizes = np.array([sizes[i] for i in order])
        held = [sketches[i] for i in order]
        self.coarse = np.stack([x.reshape(16, -1).sum(axis=1, dtype=np.int32) for x in held])
        self.cells = np.array([len(x) for x in held])
        # For each number of ranges: the first set that has as many, and the counts of sets with as many or twice as many.
        self.levels = {}
        for m in np.unique(self.cells).tolist():
            a, b = np.searchsorted(self.cells, [m, 2 * m + 1]).tolist()
            self.levels[m] = (a, np.stack([held[i].reshape(m, -1).sum(axis=1, dtype=np.int16) for i in range(a, b)]))

    def partners(self, i: int, apart: np.ndarray | None = None) -> np.ndarray:
        """Earlier sets (no larger ones) that size and sketch let be similar to set i, the likeliest first."""
        lo = int(np.searchsorted(self.sizes[:i], -(-NUM * int(self.sizes[i]) // DEN)))
        ok = np.ones(i - lo, dtype=bool) if self.lead[i] else self.lead[lo:i].copy()
        if apart is not None:
            ok &= apart[lo:i]
        cand = np.flatnonzero(ok) + lo
        most = (DEN - NUM) * (self.sizes[cand] + self.sizes[i]) // (DEN + NUM)
        cand = cand[np.abs(self.coarse[cand] - self.coarse[i]).sum(axis=1) <= most]
        least = np.zeros(len(cand), dtype=np.int64)
        for m in np.unique(self.cells[cand]).tolist():
            first, counts = self.levels[m]
            at = np.flatnonzero(self.cells[cand] == m)
            least[at] = np.abs(counts[cand[at] - first] - counts[i - first]).sum(axis=1, dtype=np.int64)
        ok = (DEN + NUM) * least <= (DEN - NUM) * (self.sizes[cand] + self.sizes[i])
        return cand[ok][np.argsort(least[ok], kind="stable")]

    def possible(self) -> list[list[int]]:
        """Places of the sets, in classes: sets of different classes are not similar. Sets alone are left out."""
        label = np.arange(len(self.ids))
        for i in range(1, len(self.ids)):
            for j in np.unique(label[self.partners(i, label != label[i])]).tolist():
                label[label == j] = label[i]
        order = np.argsort(label, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        return [x.tolist() for x in parts if len(x) > 1]

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join the group's classes; pairs already in one class are not compared again."""
        sets = [sets[i] for i in self.order]
        label = np.arange(len(sets))
        out = []
        for i in range(1, len(sets)):
            for j in self.partners(i, label != label[i]).tolist():
                if label[j] != label[i] and linked(sets[i], sets[j]):
                    out.append((self.ids[i], self.ids[j]))
                    label[label == label[j]] = label[i]
        return out


def _grouped(rows: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """work(key, ids, leads, payloads) on each group of rows (keys, id, lead, payload...); it gives tuples of schema.

    Groups come one after another in sorted tasks, so memory is one group and many small ones cost little.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    n, names = len(keys), rows.columns
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(got):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], kinds[f[1]]) for k, f in enumerate(fields)], [f[0] for f in fields])

        key, held = None, {}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(len(names))]
            out = []
            for row in zip(*cols):
                if row[:n] != key:
                    if len(held) > 1:
                        out += work(key, held)
                    key, held = row[:n], {}
                held[row[n]] = row[n + 1 :]
            yield done(out)
        if len(held) > 1:
            yield done(work(key, held))

    return dealt.mapInArrow(tidy(run), schema)


def _survivors(weight, limit: int):
    """Work on groups with lead, n and sketch: classes of sets that may be similar, in blocks of a total weight.

    It gives class number, a and b (blocks that meet, where the class is long), id, lead.
    """

    def work(key, held: dict) -> list[tuple]:
        g = Group(list(held), [x[0] for x in held.values()], [x[1] for x in held.values()], [unpacked(x[2]) for x in held.values()])
        out = []
        for part in g.possible():
            ids = [g.ids[i] for i in part]
            name = set_number(np.array(sorted(ids), dtype=np.int64).view(np.uint64))
            block = (np.cumsum([weight(n) for n in g.sizes[part].tolist()]) // limit).tolist()
            last = block[-1]
            for i, k in zip(part, block):
                for a, b in sorted({(min(k, o), max(k, o)) for o in range(last + 1)}):
                    out.append((name, a, b, g.ids[i], bool(g.lead[i])))
        return out

    return work


def _links(key, held: dict) -> list[tuple]:
    sets = [np.frombuffer(x[1], np.uint64) for x in held.values()]
    return Group(list(held), [x[0] for x in held.values()], [len(s) for s in sets], [sketch(s, ranges(len(s))) for s in sets]).links(sets)


def _possible(rows: DataFrame, keys: list[str], sketches: DataFrame, work) -> DataFrame:
    """The classes that work makes of the groups in rows, with the sketches (h, n, sketch) of their sets."""
    wanted = sketches.join(rows.select(F.col("id").alias("h")).distinct(), "h", "left_semi").dropDuplicates(["h"])
    drawn = rows.join(wanted, F.col("id") == F.col("h")).select(*keys, "id", "lead", "n", "sketch")
    left = _grouped(drawn, keys, "name long, a int, b int, id long, lead boolean", work)
    return staged(left.groupBy("name", "a", "b", "id").agg(F.max("lead").alias("lead")), "possible")


def verified(rows: DataFrame, keys: list[str], docs: DataFrame, table: DataFrame, classes: DataFrame) -> DataFrame:
    """rows: keys, id, lead. Links u, v between similar sets of a group; full sets move only for what the sketches leave."""
    some = table.filter("n > 0")
    left = _possible(rows, keys, some.select("h", "n", "sketch"), _survivors(ranges, FINE_BYTES))
    fine = some.select("h", "n", F.coalesce("fine", "sketch").alias("sketch"))
    left = _possible(left, ["name", "a", "b"], fine, _survivors(lambda n: 8 * n, SET_BYTES))
    sets = full_sets(docs, needed(left.select("id").distinct(), classes))
    full = left.join(sets, F.col("id") == F.col("h")).select("name", "a", "b", "id", "lead", "shingles")
    return staged(_grouped(full, ["name", "a", "b"], "u long, v long", _links), "links")


def links(docs: DataFrame, table: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Verified links between set numbers that connect every two similar sets."""
    pairs = staged(stars(docs, classes, total), "candidates")
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    sized = pairs.groupBy("pivot").agg(blocks.alias("blocks"))
    member = pairs.join(sized, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), F.col("member").alias("id"))
    own = sized.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("id"))
    rows = staged(member.unionByName(own).withColumn("lead", F.lit(True)), "groups")
    found = verified(rows, ["pivot", "block"], docs, table, classes)
    large = sized.filter("blocks > 1")
    if large.isEmpty():
        return found
    # Across the blocks of a large group: what is not of its largest class, against every block.
    label = components(found)
    mine = pairs.join(large, "pivot").select("pivot", "blocks", F.col("member").alias("id"))
    mine = mine.join(label, "id", "left").select("pivot", "blocks", "id", F.coalesce("label", "id").alias("label"))
    mine = staged(mine, "large")
    most = mine.groupBy("pivot", "label").agg(F.count("*").alias("c")).groupBy("pivot").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    rest = mine.join(most, "pivot").filter("label != top").select("pivot", "blocks", "id")
    per = rest.groupBy("pivot").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("chunks"))
    rest = rest.join(per, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("lead"))
    every = mine.join(per, "pivot").select("pivot", "id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("lead"))
    rows = rest.unionByName(every).groupBy("pivot", "chunk", "block", "id").agg(F.max("lead").alias("lead"))
    return found.unionByName(verified(staged(rows, "groups"), ["pivot", "chunk", "block"], docs, table, classes))


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h (number of the set), label (of the class; null for empty sets), component (its smallest doc_id)."""
    table = staged(set_table(docs), "sets")
    classes = staged(table.filter("n > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    label = settled(docs.sparkSession, lambda: components(links(docs, table, classes.select("h", "rep"), total)), "labels")
    own = classes.join(label, classes["h"] == label["id"], "left").select("h", "rep", F.coalesce("label", "h").alias("label"))
    least = own.groupBy("label").agg(F.min("rep").alias("component"))
    of_set = own.join(least, "label").select("h", "label", "component")
    filled = table.filter("n > 0").select("doc_id", "n", "h").join(of_set, "h").select("doc_id", "n", "h", "label", "component")
    return filled.unionByName(table.filter("n = 0").select("doc_id", "n", "h", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component")))


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return classified(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with the number of each row's set (null: an empty set) in a column of that name."""
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at):
            h = pa.array([set_number(s) if len(s) else None for s in shingle_sets(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), f"{fields}, `{name}` long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the first document of each class only; all columns stay, whatever their names.

    The first is the one with the smallest doc_id, null last; of rows with that id in the class, one stays. Rows without
    words are classes of their own.
    """
    rows = staged(classified(docs), "classified")
    plain = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    if plain:  # those that go are looked for; the others stay where they are
        gone = rows.filter("doc_id != component").select(F.col("doc_id").alias("d"))
        whole = sieved(docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id")), F.xxhash64("id"), gone.select(F.xxhash64("d").alias("k")))
        some = whole.filter("maybe").join(gone, F.col("id") == F.col("d"), "left_anti")
        return whole.filter("not maybe").select("whole.*").unionByName(some.select("whole.*"))
    keep, own, number, rank = unused(docs.columns, "_keep", "_own", "_number", "_rank")
    first = rows.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")).alias("f"))
    first = first.select(F.col("f.doc_id").alias(keep), F.col("f.h").alias(own))
    out = numbered(docs, number)
    some = out.join(first, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(number) == F.col(own)), "left_semi")
    some = some.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", number).orderBy(F.xxhash64("text"), "text"))).filter(F.col(rank) == 1)
    return some.drop(rank, number).unionByName(out.filter(F.col(number).isNull()).drop(number))
