"""Near copies whose doc_ids are negative or null."""

from folioforge.llm import jaccard

WORDS = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"v{k}" for k in range(60))
ROWS = [(-7, WORDS), (-3, WORDS + " end"), (5, WORDS + " other end"), (-2, OTHER), (-(2**63), "alone by itself"), (None, "no id at all here"), (None, OTHER + " end"), (-1, "minus one alone")]


def test_negative_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.classes_of(docs).select("doc_id", "component_id").filter("doc_id is not null").collect()))
    assert got == [(-(2**63), -(2**63)), (-7, -7), (-3, -7), (-2, -2), (-1, -1), (5, -7)]
    assert sorted(r.component_id or 0 for r in jaccard.classes_of(docs).filter("doc_id is null").collect()) == [-2, 0]
    kept = jaccard.one_of_each(docs).filter("doc_id is not null").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [-(2**63), -7, -2, -1]
