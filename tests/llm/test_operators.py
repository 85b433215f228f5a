"""Operators on hand-made rows: nulls, empty and odd texts, repeats, ties, empty tables, clashing column names."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest

from folioforge.llm import exact, jaccard, langid, licences, mixing, packing, privacy, tokenfiles, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, h long, label string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 2, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    long = list(rng.choice(words, 900))
    out = [None, "", " \t\n", "one", "One  two", "one two\n", "a b c d e", "A B C D E", "x" * 5000, "é ß 中文 'quoted' it's\0end"]
    for k in range(60):
        near = list(long[: 100 + 10 * (k % 7)])
        for _ in range(k % 6):
            near[rng.integers(len(near))] = "edit"
        out.append(" ".join(near))
    return out + out[40:45] + [" ".join(long)]


def test_exact(spark, texts):
    want = collections.defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        want[t].append(i)
    for weak in (exact.sha256, lambda t: exact.F.left(exact.sha256(t), exact.F.lit(1))):
        got = exact.duplicates(frame(spark, texts), weak).collect()
        assert len(got) == len(texts)
        for r in got:
            g = want[norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (g[0], len(g), g[0] == r.doc_id, hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    kept = exact.keep_first(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and kept.count() == len(want)
    assert exact.duplicates(frame(spark, texts).limit(0)).count() == 0


def plain_classes(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard(spark, texts, monkeypatch):
    want = plain_classes(texts)
    for block, size in ((jaccard.BLOCK, jaccard.SET_BYTES), (4, 3000)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "SET_BYTES", size)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes_of(frame(spark, texts)).collect()}
        assert got == want
    assert jaccard.classes_of(frame(spark, texts).limit(0)).count() == 0


def test_jaccard_of_long_texts(spark, monkeypatch):
    """Fine sketches: sizes about the powers of two where their number of ranges changes, half-shared and nearly equal texts."""
    rng = np.random.default_rng(11)
    words = [f"v{k}" for k in range(5000)]
    out = []
    for n in (514, 520, 1030, 2060):
        base = list(rng.choice(words, n))
        out.append(" ".join(base[: n // 2] + list(rng.choice(words, n // 2))))
        for e in (0, n // 60, n // 50, n // 45, n // 40, n // 30):
            near = list(base[: n - int(rng.integers(0, 8))])
            for at in rng.choice(len(near), e, replace=False):
                near[at] = "edit"
            out.append(" ".join(near))
    want = plain_classes(out)
    for fine, size in ((jaccard.FINE_BYTES, jaccard.SET_BYTES), (2000, 20000)):
        monkeypatch.setattr(jaccard, "FINE_BYTES", fine)
        monkeypatch.setattr(jaccard, "SET_BYTES", size)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes_of(frame(spark, out)).collect()} == want


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(12)
    for n in (5, 300, 511, 513, 514, 570, 1025, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1))
            d = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 2**63, int(rng.integers(0, d + 1)), dtype=np.uint64))))
            for cells in (lambda m: 256, jaccard.ranges):
                g = jaccard.Group([1, 2], [True, True], [len(a), len(b)], [jaccard.sketch(x, cells(len(x))) for x in (a, b)])
                assert not jaccard.linked(a, b) or g.partners(1).tolist() == [0]


def test_signatures_meet():
    rng = np.random.default_rng(1)
    for n in (5, 9, 30, 200, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            d = n // 9  # removed and added: similarity of 0.8 or a little more
            b = np.unique(np.concatenate((a[d:], rng.integers(0, 2**63, d, dtype=np.uint64))))
            if jaccard.linked(a, b) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))


def test_packing_and_files(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    d = frame(spark, texts)
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0)):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]
        if end:
            got = packing.best_fit(packing.token_pieces(d, path), open_bins=3, group_rows=20).collect()
            assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got} == {(i, k): (len(x[k * 4096 : k * 4096 + 4096]), zlib.crc32(x[k * 4096 : k * 4096 + 4096].tobytes())) for i, x in enumerate(ids) for k in range(-(-len(x) // 4096))}
            bins = collections.defaultdict(list)
            for r in got:
                bins[r.sequence_id].append((r.offset, r.length))
            for b in bins.values():
                b.sort()
                assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(n for _, n in b) <= 4096
        else:
            index = tokenfiles.write_sequences(d, path, width=64, rows_per_file=20)
            start = np.cumsum([0, *map(len, ids)])
            assert sorted(map(tuple, tokenfiles.read_documents(index).collect())) == [(i, start[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
            f = tokenfiles.SequenceFile(index.orderBy("part", "row").first().path)
            assert f.sequence(0)[0].to_pylist() == np.concatenate(ids)[:64].tolist() and all(f.sequence(0)[1].to_pylist())


def test_mixing(spark, texts):
    got = mixing.mix(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by[r.source]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
    total = sum(s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(s[1] - s[2]) < 1.5 and s[2] <= 2 * s[0] for s in by.values())
    made = mixing.materialise(frame(spark, texts), mixing.mix(frame(spark, texts))).collect()
    assert sum(len(WORD.findall(r.text)) for r in made) == sum(r.taken for r in got)
    assert mixing.mix(frame(spark, texts).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 19))
    v[7] = v[9]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(900, None, 1), (901, [None] * 19, 1), (950, [float("nan")] * 19, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), topk.F.col("vec_id") % 50 == 0, query_rows=3)
    w = np.floor(256 * v).astype(int)
    want = [(q, k + 1, c, s) for q in range(0, 300, 50) for k, (s, c) in enumerate([(-a, b) for a, b in sorted((-int(w[q] @ w[c]), c) for c in range(300) if c != q)][:5])]
    assert sorted(map(tuple, got.collect())) == want


def test_language(spark):
    samples = {"aa": ["the cat and the dog went on"] * 3, "bb": ["der hund und die katze gingen"] * 3}
    rows = ["the dog and the cat", "die katze und der hund", None, "", "123 !?", "the cat and the dog " * 5000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame(spark, rows), samples).collect()}
    assert [got[i][0] for i in range(6)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert [r.doc_id for r in langid.accepted(frame(spark, rows), samples).orderBy("doc_id").collect()] == [0, 1, 5]


def test_cross_parsing_counts_longest_matches():
    text = "abracadabra banana bandana"
    model = langid.Model({"x": [text]})
    for query in ("abra banan", "zzz", "dabra nab", "a"):
        left, n = query, 0
        while left:
            k = len(left)
            while k > 1 and left[:k] not in text + " ":
                k -= 1
            left, n = left[k:], n + 1
        assert model.phrases([query])[0][0][0] == n, query


def test_private_data(spark):
    rows = ["mail a.b@c.de, call +1 (988) 555-2485", "9.9.9.9 and 300.1.1.1", "card 4111 1111 1111 1111", "write bob (at) foo (dot) com now", None, "plain words at the end", "version 3. of 2024-01-02 at 10:30", "1" * 20000]
    got = {r.doc_id: r for r in privacy.find(frame(spark, rows)).collect()}
    assert (got[0].n_email, got[0].n_phone, got[1].n_ip, got[2].n_card) == (1, 1, 1, 1)
    assert got[3].base_spans == "" and got[3].spans == "email:6:28"
    assert all(got[i].spans == "" for i in (4, 5, 6, 7))


def test_licences(spark):
    rows = ["x\nReleased under the MIT License.", "All rights reserved. Some licence text here", None, "", "This program is free software: no match"]
    got = {r.doc_id: (r.licences, r.n_known, r.n_unknown) for r in licences.scan(frame(spark, rows)).collect()}
    assert got[0] == ("MIT", 1, 0) and got[1] == ("Proprietary", 1, 1) and got[2] == got[3] == ("", 0, 0)
