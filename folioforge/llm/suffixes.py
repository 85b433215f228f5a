"""Suffix arrays by linear grouping, and the repeated windows of a block of byte strings."""

from __future__ import annotations

import numpy as np


def grouped_order(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of numbers.

    First, suffixes are put into groups by their Lyndon prefix: groups start as the first symbols and are taken from the
    highest down; each suffix of a group points to the last one before it that is in a lower group (previous smaller),
    and those pointed at rise to a new group just above their own, the higher the more often they are pointed at.
    Then groups are filled in order: each suffix, in ascending order, hands the next free place of their groups to the
    suffixes that end their Lyndon prefix where it starts. Nothing is renamed or sorted again.
    """
    n = len(symbols)
    members: list[list[int]] = []
    group, number = [0] * n, {}
    for s in sorted(set(symbols)):
        number[s] = len(members)
        members.append([])
    for i, s in enumerate(symbols):
        group[i] = number[s]
        members[group[i]].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    smaller = [-2] * n
    at = len(members) - 1
    while at >= 0:
        votes: dict[int, int] = {}
        for i in sorted(x for x in members[at] if group[x] == at):
            p = i - 1
            while p >= 0 and smaller[p] != -2:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                votes[p] = votes.get(p, 0) + 1
        risen: dict[tuple[int, int], list[int]] = {}
        for p, count in votes.items():
            risen.setdefault((-count, group[p]), []).append(p)
        for (_, low), moved in sorted(risen.items()):
            new, high = len(members), above[low]
            members.append(moved)
            below.append(low)
            above.append(high)
            above[low] = below[high] = new
            for p in moved:
                group[p] = new
        at = below[at]
    free, total = [0] * len(members), 0
    at = next((g for g in range(len(members)) if below[g] == -1), -1)
    while at >= 0:
        free[at] = total
        total += sum(group[x] == at for x in members[at])
        at = above[at]
    out, placed = [0] * n, [False] * n
    for k in range(-1, n):
        p = (n if k < 0 else out[k]) - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = smaller[p]
    return out


#: No byte of UTF-8; ends each string of a block.
END = 0xFF
#: Bytes that end a phrase: blanks, line feeds, END, some digits, and an eighth of the bytes of longer characters.
ENDS_PHRASE = np.array([b in (0x20, 0x0A, 0x30, 0x38, END) or (b >= 0x80 and b % 8 == 0) for b in range(256)])


def repeated(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of that length in the strings: string numbers, starts, and class numbers in sorted order of content.

    The block is parsed into phrases, no one the start of another; the suffix array of the phrases gives the order of
    all byte suffixes: by the rest of their phrase, then by the rank of what follows it. Equal windows are neighbours,
    and are compared byte by byte.
    """
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    windows = np.maximum(sizes - length, 0)
    string = np.repeat(np.arange(len(strings)), windows)
    start = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(string):
        return string, start, string
    stops = np.flatnonzero(ENDS_PHRASE[text]) + 1
    starts = np.concatenate(([0], stops[:-1]))
    raw = text.tobytes()
    phrases = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    words = sorted(set(phrases))
    rank = {w: i for i, w in enumerate(words)}
    ids = [rank[w] for w in phrases]
    order = np.array(grouped_order(ids))
    ahead = np.empty(len(order) + 1, dtype=np.int64)
    ahead[order], ahead[-1] = np.arange(len(order)), -1
    tails = {w: i for i, w in enumerate(sorted({w[o:] for w in words for o in range(len(w))}))}
    tail = np.array([tails[w[o:]] for w in words for o in range(len(w))])
    first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    at = base[string] + start
    phrase = np.searchsorted(stops, at, side="right")
    sort = np.lexsort((ahead[phrase + 1], tail[first[np.array(ids)[phrase]] + at - starts[phrase]]))
    string, start, at = string[sort], start[sort], at[sort]
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(at), dtype=bool)
    for a in range(1, len(at), 8192):
        b = min(a + 8192, len(at))
        new[a:b] = (view[at[a - 1 : b - 1]] != view[at[a:b]]).any(axis=1)
    return string, start, np.cumsum(new) - 1
