"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text. A text is parsed against it greedily into longest matches; the
language that needs the fewest phrases for a symbol wins, ties to the smaller name. Letters are folded to lower case,
every run of other characters is one blank. The blocks of a long text are parsed side by side from a fresh start, and each
is then corrected from its first symbol on with the state that the block before it ends in, until both parses are in the
same state: phrases cross the edges of blocks, and the counts are those of one parse of the whole text.

Null text or one without a letter: `und`, score 0. If nothing can be learned all are `und`. Repeated rows are predicted
each; a null doc_id is neither held out nor learned from. Extra columns are ignored. Score: 1 - phrases of the best /
phrases of the second (1 where only one language is learned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import portions, tidy

BLOCK = 1024
#: Symbols: 0 blank, 1 a letter that no sample has, 2.. every letter of the samples, the last one the end of a short block.
#: An automaton over more symbols than DENSE is a sparse table over the symbols of its own language.
DENSE = 256
OUT = "doc_id long, lang_pred string, score double"


class SuffixAutomaton:
    """Smallest automaton of all substrings of a sequence of symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            return cur
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[cur] = q
            return cur
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[cur] = copy
        return cur

    def parser(self, width: int) -> Dense | Sparse:
        """The greedy parse over symbols below width, of which the last is the end of a short block."""
        return (Dense if width <= DENSE else Sparse)(self.next, width)


def _from_start(first: dict[int, int], width: int) -> np.ndarray:
    """At each symbol, what Dense has at the first state."""
    start = np.full(width, 1, dtype=np.int64)  # a symbol that the text lacks is a phrase by itself
    for c, t in first.items():
        start[c] = (t * width) << 2
    return start


class Dense:
    """Flat table: at state * width + symbol, (next state * width) << 2 | phrases that end."""

    def __init__(self, rows: list[dict[int, int]], width: int):
        n = len(rows)
        start = _from_start(rows[0], width)
        table = np.tile(start + 1, (n, 1))
        table[0] = start
        for s, row in enumerate(rows):
            for c, t in row.items():
                table[s, c] = (t * width) << 2
        table[:, width - 1] = (np.arange(n) * width) << 2
        self.table = table.reshape(-1).astype(np.int32 if n * width < 2**28 else np.int64)
        self.dtype = self.table.dtype

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return self.table.take(state + symbols)


class Sparse:
    """The same numbers as Dense for wide alphabets: sorted transitions, and the first state's row where there is none."""

    dtype = np.dtype(np.int64)

    def __init__(self, rows: list[dict[int, int]], width: int):
        self.start = _from_start(rows[0], width)
        there = sorted((s * width + c, (t * width) << 2) for s, row in enumerate(rows) for c, t in row.items())
        self.keys, self.values = (np.array(x, dtype=np.int64) for x in zip(*there, (len(rows) * width, 0)))

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        key = state + symbols
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at) == key, self.values.take(at), self.start.take(symbols) + (state > 0))


class Model:
    """The languages' parsers, made from {lang: [sample, ...]}."""

    def __init__(self, samples: dict[str, list[str]]):
        from collections import Counter

        self.langs = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        letters = {c: k + 2 for k, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        self.width = len(letters) + 3
        self.symbol = np.zeros(0x110000, dtype=np.uint8 if self.width <= 256 else np.uint16 if self.width <= 65536 else np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                self.symbol[c] = letters.get(x.lower()[:1], 1)
        for c, k in letters.items():
            self.symbol[ord(c)] = k
        self.parsers, self.own = [], []
        for lang in self.langs:
            symbols: list[int] = []
            for text in samples[lang]:
                symbols += [*self.symbols(text).tolist(), 0]
            if self.width <= DENSE:
                self.own.append(None)
                self.parsers.append(SuffixAutomaton(symbols).parser(self.width))
                continue
            here = sorted({c for c in symbols if c > 1})  # letters of other languages alone are unseen in this one
            own = np.ones(self.width, dtype=np.int64)
            own[0], own[here], own[self.width - 1] = 0, np.arange(len(here)) + 2, len(here) + 2
            self.own.append(own)
            self.parsers.append(SuffixAutomaton(own[symbols].tolist()).parser(len(here) + 3))

    def symbols(self, text: str) -> np.ndarray:
        got = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = got > 0
        keep[1:] |= got[:-1] > 0  # one blank for a run
        return got[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (text x language) and whether a text has a letter."""
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        letter = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            got = self.symbols(text)
            letter[i] = bool(len(got)) and bool(got.max() > 0)
            for k in range(0, len(got), BLOCK):
                blocks.append(got[k : k + BLOCK])
                owner.append(i)
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not blocks:
            return out, letter
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(blocks), dtype=np.int64)
        place[order] = np.arange(len(blocks))
        grid = np.full((int(sizes.max()), len(blocks)), self.width - 1, dtype=self.symbol.dtype)
        for k, b in enumerate(order):
            grid[: sizes[b], k] = blocks[b]
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left")
        who = np.array(owner)
        later = np.flatnonzero(np.diff(who, prepend=-1) == 0)  # blocks that go on from the one before
        full = int((sizes[order] == BLOCK).sum()) if len(later) else 0  # only full blocks are followed, and they come first
        tails = place[later]
        kept = max(full, int(tails.max()) + 1) if len(later) else 0
        last = np.ones(len(blocks), dtype=bool)
        last[later - 1] = False
        for lang, (parser, own) in enumerate(zip(self.parsers, self.own)):
            state = np.zeros(len(blocks), dtype=parser.dtype)
            count = np.zeros(len(blocks), dtype=parser.dtype)
            states = np.zeros((len(grid) if kept else 0, kept), dtype=parser.dtype)
            counts = np.zeros(states.shape, dtype=np.int16)
            for t, n in enumerate(active.tolist()):
                v = parser.step(state[:n], grid[t, :n] if own is None else own.take(grid[t, :n]))
                count[:n] += v & 3
                state[:n] = v >> 2
                if kept:
                    m = min(n, kept)
                    states[t, :m], counts[t, :m] = state[:m], count[:m]
            if kept:
                self._carry(parser, own, grid, sizes, place, later, state, count, states, counts)
            total = count[place] + (last & (state[place] > 0))
            out[:, lang] = np.bincount(who, weights=total, minlength=len(texts)).astype(np.int64)
        return out, letter

    @staticmethod
    def _carry(parser, own, grid, sizes, place, later, state, count, states, counts) -> None:
        """Correct state and count (in place) of blocks parsed from a fresh start by what the block before ends in.

        states and counts hold the fresh parse after each symbol. Where both parses are in the same state the rest is
        the same. A block that never gets there ends in another state, and the block after it is corrected again.
        """
        fresh_state, fresh_count = state.copy(), count.copy()
        todo = later
        while len(todo):
            ends = state[place[todo]].copy()
            cols, at = place[todo], np.arange(len(todo))
            s, c = state[place[todo - 1]], np.zeros(len(todo), dtype=count.dtype)
            new_state, new_count = s.copy(), c.copy()
            open_ = s != 0  # else the fresh start was right
            new_state[~open_], new_count[~open_] = fresh_state[cols[~open_]], fresh_count[cols[~open_]]
            at, s, c = at[open_], s[open_], c[open_]
            for t in range(len(grid)):
                if not len(at):
                    break
                here = cols[at]
                v = parser.step(s, grid[t, here] if own is None else own.take(grid[t, here]))
                c, s = c + (v & 3), v >> 2
                met, ended = s == states[t, here], t + 1 >= sizes[todo[at]]
                done = met | ended
                if done.any():
                    k = at[done]
                    new_state[k] = np.where(met[done], fresh_state[cols[k]], s[done])
                    new_count[k] = c[done] + np.where(met[done], fresh_count[cols[k]] - counts[t, cols[k]], 0)
                    at, s, c = at[~done], s[~done], c[~done]
            state[cols], count[cols] = new_state, new_count
            again = todo[new_state != ends] + 1
            todo = again[np.isin(again, later)]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts, letter = self.phrases(texts)
        names, scores = [], []
        for row, ok in zip(counts.tolist(), letter.tolist()):
            if not ok or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            best = min(range(len(row)), key=lambda k: (row[k], self.langs[k]))
            rest = min([n for k, n in enumerate(row) if k != best], default=None)
            names.append(self.langs[best])
            scores.append(1.0 if rest is None else 1.0 - row[best] / max(rest, 1))
        return names, scores


_MODELS: dict[int, tuple[dict, Model]] = {}


def model_of(samples: dict[str, list[str]]) -> Model:
    """The model of these samples, made once in a process."""
    key = hash(tuple((k, *v) for k, v in sorted(samples.items())))
    if key not in _MODELS or _MODELS[key][0] != samples:
        _MODELS.clear()
        _MODELS[key] = (samples, Model(samples))
    return _MODELS[key][1]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_samples(docs: DataFrame, rows: int = 240, chars: int = 32_000) -> dict[str, list[str]]:
    """Whole texts of labelled documents of each language, in the order of a hash of doc_id.

    The bound of the fit: as many as fit into `chars` characters a language, `rows` at most. Where the first one alone is
    longer, its first `chars` characters. doc_id and lang are read only to pick.
    """
    learn = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "n")
    picked = learn.select("doc_id", "lang", F.length("text").alias("n")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= rows)
    picked = picked.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("upto") <= chars) | (F.col("k") == 1))
    picked = F.broadcast(picked.select("doc_id", "lang", "n").distinct())  # rows * languages at most
    got = learn.withColumn("n", F.length("text")).join(picked, ["doc_id", "lang", "n"], "left_semi").select("lang", "doc_id", F.substring("text", 1, chars).alias("part"))
    out: dict[str, list[str]] = {}
    for lang, _, part in sorted(map(tuple, got.distinct().collect())):
        out.setdefault(lang, []).append(part)
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred, score of every document; only its text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for batch in portions(batches, 1):
            names, scores = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), OUT)


def accepted(docs: DataFrame, samples: dict[str, list[str]], min_score: float = 0.0) -> DataFrame:
    """docs whose text has a language, with at least that score; all columns stay, whatever their names."""
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for batch in portions(batches, at):
            lang, score = model.predict([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([a != "und" and s >= min_score for a, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(tidy(run), fields)
