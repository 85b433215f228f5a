"""The pipeline's stages against plain versions on a small table."""

import re

import corpus_pipeline
from test_operators import frame, plain_classes, texts  # noqa: F401


def test_stages(spark, texts, tmp_path):  # noqa: F811
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        if k == 1:
            seen, out = set(), {}
            for i, t in sorted(left.items()):
                n = re.sub(r"[\x20\x09-\x0D]+", " ", t)
                if n not in seen:
                    out[i] = t
                seen.add(n)
            left = out
        if k == 2:
            ids = sorted(left)
            label = plain_classes([left[i] for i in ids])
            left = {i: left[i] for j, i in enumerate(ids) if label[j][1] == j}
        if k < 3:
            assert {r.doc_id: r.text for r in docs.collect()} == left, name
        else:
            size = lambda t: len(t.split())
            assert {r.doc_id for r in docs.collect()} <= set(left)
            assert abs(sum(size(r.text) for r in docs.collect()) - 1.5 * sum(map(size, left.values()))) < 20
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and all(0 < r.length <= 4096 for r in got)


def test_stages_begin_with_heaps_given_back(spark, tmp_path):
    frame(spark, ["a first text", "a second text"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() > before, name
