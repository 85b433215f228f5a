"""Suffix arrays and removal of repeated byte strings, against plain versions."""

import collections
import hashlib
import random

import pytest

from folioforge.llm import repeats
from folioforge.llm.suffixes import grouped_order, repeated

SCHEMA = "doc_id long, text string, doc long, k long, run string, body string"


def test_grouped_order():
    r = random.Random(1)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(30))]
        assert grouped_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows():
    r = random.Random(2)
    for _ in range(100):
        strings = [bytes(r.choice(b"ab 0") for _ in range(r.randrange(40))) for _ in range(6)]
        classes = collections.defaultdict(list)
        for s, a, c in zip(*(x.tolist() for x in repeated(strings, 5))):
            classes[c].append(strings[s][a : a + 5])
        assert all(len(set(x)) == 1 for x in classes.values())
        want = collections.Counter(s[i : i + 5] for s in strings for i in range(len(s) - 4))
        assert want == {x[0]: len(x) for x in classes.values()}


def plain(rows):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    n = repeats.LENGTH
    seen = collections.Counter(b[i : i + n] for _, b in bodies for i in range(len(b) - n + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [repeats.BLOCK, 2])
def test_without_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    r = random.Random(3)
    fill = lambda n: " ".join("".join(r.choice("abcdeé中") for _ in range(r.randrange(1, 9))) for _ in range(n))
    passage = fill(120)
    texts = [None, "", "short", "a" * 3000, "xy" * 700, fill(30) * 40, fill(400)]
    texts += [fill(40 + i) + passage[i % 5 : len(passage) - i % 3] + fill(20) for i in range(12)]
    near = fill(300)
    texts += [near, near, *(near[: 400 + 97 * i] + "#" + near[401 + 97 * i :] for i in range(8))]
    texts += [passage[:399].encode()[:399].decode(errors="ignore"), passage[50:430] + passage[60:470]]
    rows = [*enumerate(texts), (3, "a" * 3000), (None, near), (None, near), (None, fill(90))]
    got = repeats.without_repeats(spark.createDataFrame([(d, t, 1, 2, "x", None) for d, t in rows], SCHEMA)).collect()
    want = plain(rows)
    assert sorted(((g["doc_id"], len(g["body"]) - len(g["kept"]), len(g["spans"]), hashlib.sha256(g["kept"]).hexdigest()) for g in got), key=repr) == want
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
