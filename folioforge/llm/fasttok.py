"""Token ids of a tokenizers vocabulary, one library call for each distinct pre-token.

Both vocabularies split a text into pre-tokens by a pattern and encode each by itself. Here numpy finds the
pre-tokens of ordinary Latin texts, the library encodes each distinct one once, and the ids are gathered. A text
with a character outside that range, an apostrophe (contraction rules), NUL or a string of an added token goes to the
library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from folioforge.llm.common import release

LIMIT = 0x300
_SEP = 0
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)
#: Classes of a code point.
OTHER, LETTER, NUMBER, BLANK, END = range(5)


def _classes() -> np.ndarray:
    kinds = np.zeros(LIMIT, dtype=np.uint8)
    for c in range(LIMIT):
        k = unicodedata.category(chr(c))[0]
        kinds[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    kinds[list(_SPACES)] = BLANK
    kinds[_SEP] = END
    return kinds


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PreTokenEncoder:
    """Encodes texts with the vocabulary at path.

    keep_spaces: pre-tokens of the byte-level pattern, where one space leads the next pre-token and other white
    space stands by itself; else white space goes and every digit is a pre-token of its own.
    """

    def __init__(self, path: str, keep_spaces: bool, cache: int = 200_000, block_chars: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        release()  # what parsing the file took
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)", re.IGNORECASE if any(t.normalized for t in added) else 0)
        self.keep_spaces, self.limit, self.block_chars = keep_spaces, cache, block_chars
        self.kinds = _classes()
        rng = np.random.default_rng(20240607)
        self.values = rng.integers(1, 2**63, LIMIT, dtype=np.uint64) | np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self._forget()
        self.tokenizer.model._resize_cache(0)  # each pre-token is asked for once
        self.mapped = _byte_letters()

    def _forget(self) -> None:
        """No pre-token is known: `known` are sorted keys, whose ids lie in `flat` from `begins`, `sizes` of them."""
        self.known = np.zeros(0, dtype=np.uint64)
        self.begins = self.sizes = np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, keys: np.ndarray, slots: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        more = np.array([i for x in ids for i in x], dtype=np.uint32)
        end = self.used + len(more)
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(end, 2 * len(self.flat)) - self.used, dtype=np.uint32)))
        self.flat[self.used : end] = more
        self.known = np.insert(self.known, slots, keys)
        self.begins = np.insert(self.begins, slots, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, slots, sizes)
        self.used = end

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                out = np.full(n, base, dtype=np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """A uint32 array of ids for each text."""
        out: list = [None] * len(texts)
        block: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if "'" in text or "\0" in text or "\u0130" in text or len(text) > self.block_chars or self.added.search(text):
                out[i] = self._whole([text])[0]
                continue
            if block and size + len(text) > self.block_chars:
                self._block(texts, block, out)
                block, size = [], 0
            block.append(i)
            size += len(text) + 1
        if block:
            self._block(texts, block, out)
        return out

    def _block(self, texts: list[str], rows: list[int], out: list) -> None:
        points = np.frombuffer("\0".join([texts[i] for i in rows] + [""]).encode("utf-32-le"), dtype=np.uint32)
        odd = np.flatnonzero(points >= LIMIT)
        if len(odd):
            ends = np.flatnonzero(points == 0)
            bad = set(np.unique(np.searchsorted(ends, odd)).tolist())
            for k in bad:
                out[rows[k]] = self._whole([texts[rows[k]]])[0]
            rows = [r for k, r in enumerate(rows) if k not in bad]
            if rows:
                self._block(texts, rows, out)
            return
        kinds = self.kinds[points]
        starts, ends = self._spans(points, kinds)
        n = len(points)
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[points] * self.powers[:n], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * self.inverses[starts]
        keys ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._forget()
        slot = np.searchsorted(self.known, distinct)
        new = slot == len(self.known)
        new[~new] = self.known[slot[~new]] != distinct[~new]
        missing = np.flatnonzero(new)
        if len(missing):
            text = points.tobytes()
            model, mapped = self.tokenizer.model, self.mapped
            found = []
            for s, e in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist()):
                word = text[4 * s : 4 * e].decode("utf-32-le")
                word = (word if self.keep_spaces else word.lower()).encode().decode("latin-1").translate(mapped)
                found.append([x.id for x in model.tokenize(word)])
            self._learn(distinct[missing], slot[missing], found)
            slot = np.searchsorted(self.known, distinct)
        counts = self.sizes[slot][where]
        begins = self.begins[slot][where]
        at = np.cumsum(counts)
        ids = self.flat[np.repeat(begins - at + counts, counts) + np.arange(at[-1] if len(at) else 0)]
        # documents end at separators: ids before the first pre-token that starts after each
        stops = np.searchsorted(starts, np.flatnonzero(points == 0))
        edges = np.concatenate(([0], np.concatenate(([0], at))[stops]))
        for k, r in enumerate(rows):
            out[r] = ids[edges[k] : edges[k + 1]]

    def _spans(self, points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; separators belong to none."""
        n = len(points)
        new = np.ones(n, dtype=bool)
        new[1:] = kinds[1:] != kinds[:-1]
        if not self.keep_spaces:
            new |= kinds == NUMBER
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            keep = kinds[starts] < BLANK
            return starts[keep], ends[keep]
        blank = kinds == BLANK
        full = kinds < BLANK
        last = np.zeros(n, dtype=bool)  # the last blank before something
        last[:-1] = blank[:-1] & full[1:]
        lead = last & (points == 0x20)
        new |= last
        new[1:] &= ~(lead[:-1] & full[1:])
        new |= kinds == END
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        keep = kinds[starts] != END
        return starts[keep], ends[keep]
