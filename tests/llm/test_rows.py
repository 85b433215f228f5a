"""Clashing column names, rows that repeat ids, colliding digests, hot keys, empty tables, stages that delete what they wrote."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import common, exact, jaccard, mixing, topk

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _doc int, _sha int, _k int, _w int, _n int, h int, digest int, row int, taken int, size int, _rank int, _number int, `late` int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(12), 99) for i, t, s in rows], CLASH)


ROWS = [(1, "alpha beta gamma", "a"), (1, "alpha beta gamma", "a"), (2, "alpha  beta gamma", "b"), (None, "alpha beta\tgamma", None), (3, "one two three four five six seven", "a"), (3, "quite another text of its own here", "a"), (4, None, "b"), (5, "", "b"), (None, None, None)]


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs = clashing(spark, ROWS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert tuple(r)[5:] == (*range(12), 99), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_run_on_an_empty_table(spark, tmp_path):
    clashing(spark, ROWS).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_keeps_one_row_of_each_text(spark):
    kept = exact.keep_first(clashing(spark, ROWS)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(1, "alpha beta gamma"), (3, "one two three four five six seven"), (3, "quite another text of its own here"), (4, "")]


def test_exact_tells_colliding_texts_apart(spark):
    rows = [(i, t, "s") for i, t in enumerate(["a", "b", "a ", "a  ", None, "", "b"])]
    for weak in (lambda t: exact.F.lit("same"), lambda t: exact.F.substring(exact.sha256(t), 1, 1)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.duplicates(clashing(spark, rows), weak).collect()}
        assert got == {0: (0, 1, True), 1: (1, 2, True), 6: (1, 2, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 2, True), 5: (4, 2, False)}


def test_exact_goes_on_from_a_checkpoint(spark, tmp_path):
    def part(name, rows):
        clashing(spark, rows).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    state = str(tmp_path / "state")
    first = exact.duplicates(part("p1", [(5, "x", "s"), (6, "y", "s")]), checkpoint=state).collect()
    assert all(r.kept and r.group_size == 1 for r in first)
    later = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.duplicates(part("p2", [(7, "x", "s"), (8, "z", "s"), (4, "y", "s")]), checkpoint=state).collect()}
    assert later == {7: (5, 2, False), 8: (8, 1, True), 4: (4, 2, True)}


def test_hot_keys_are_looked_up_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(k, "hot" if k < 50 else None if k < 80 else f"s{k}") for k in range(100)]
    left = spark.createDataFrame(rows, "id long, s string")
    of = spark.createDataFrame([(s, n, f"of {s}") for s, n in collections.Counter(s for _, s in rows).items()], "t string, n long, v string")
    got = common.looked_up(left, of, "s", "t", "n", 100).collect()
    assert sorted((r.id, r.v) for r in got) == [(i, f"of {s}") for i, s in rows]


def test_one_of_each_with_repeated_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base, "a"), (7, base + " end", "a"), (7, " ".join(f"v{k}" for k in range(40)), "a"), (7, base, "a"), (9, base + " other", "a"), (None, base + " more", "a"), (None, "alone in its class", "a"), (1, "", "a"), (1, "", "a")]
    got = sorted((r.doc_id or 0, len(r.text.split())) for r in jaccard.one_of_each(clashing(spark, rows)).collect())
    assert got in ([(0, 4), (1, 0), (1, 0), (7, 40), (7, 60)], [(0, 4), (1, 0), (1, 0), (7, 40), (7, 61)])


def test_materialise_takes_what_the_mix_takes(spark):
    rows = [(1, "a b c d e f", "z")] * 7 + [(1, "u v w x y z", "z"), (2, "p q", "z"), (3, "r s t", None), (3, "r s t", None), (4, None, "z")]
    docs = clashing(spark, rows)
    mixed = mixing.mix(docs)
    assert sum(len(r.text.split()) for r in mixing.materialise(docs, mixed).collect()) == sum(r.taken for r in mixed.collect())
    assert sum(len(r.text.split()) for r in mixing.mixture(docs).collect()) == sum(r.taken for r in mixed.collect())


def test_top_k_of_blocks_repeats_and_an_empty_table(spark):
    rng = np.random.default_rng(4)
    v = [rng.normal(size=9).tolist() for _ in range(60)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(3, v[3]), (61, None), (None, v[0]), (62, [1.0, None]), (63, [float("inf")])], "vec_id long, embedding array<double>")
    want = {}
    w = np.floor(256 * np.array(v))
    cand = [(i, w[i]) for i in range(60)] + [(3, w[3])]
    for q in range(0, 60, 2):
        best = sorted(((-int(w[q] @ x), i) for i, x in cand if i != q))[:3]
        want[q] = [(i, -s) for s, i in best]
    for size in (8192, 7):
        got = collections.defaultdict(list)
        for r in sorted(topk.top_k(frame, topk.F.col("vec_id") % 2 == 0, 3, 4, size).collect()):
            got[r.query_id].append((r.vec_id, r.score))
        assert got == want
    assert topk.top_k(frame.limit(0), topk.F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 12, 14, 15, 18, 21, 22, 27, 32, 33, 50, 77])
def test_signatures_of_small_sets(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        d, e = rng.integers(0, n // 4 + 1, 2)
        b = np.unique(np.concatenate((a[d:], rng.integers(0, 2**63, e, dtype=np.uint64))))
        if jaccard.linked(a, b) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))
    sigs = [np.unique(jaccard.signatures(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)))) for _ in range(1000)]
    shared = collections.Counter(np.concatenate(sigs).tolist()).most_common(1)[0][1]
    assert shared <= 20  # of 1000 unrelated sets


def test_settled_deletes_what_lies_between(spark, tmp_path):
    seen = []

    def make():
        seen.append(common.staged(spark.range(5).toDF("x"), "between"))
        return seen[0].filter("x > 1")

    out = common.settled(spark, make, "end")
    path = seen[0].inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    import os

    assert out.count() == 3 and not os.path.exists(path)
    common.forget(spark, out)
