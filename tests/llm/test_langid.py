"""Language identification over alphabets wider than one byte and one script."""

import numpy as np
import pytest

from folioforge.llm import langid


def phrases(query, text):
    n = 0
    while query:
        k = len(query)
        while k > 1 and query[:k] not in text:
            k -= 1
        query, n = query[k:], n + 1
    return n


def prose(rng, letters, words):
    return " ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(words))


SCRIPTS = {
    "la": "abcdefghijklmnopqrstuvwxyz",
    "ru": "".join(map(chr, range(0x430, 0x450))),
    "el": "".join(map(chr, range(0x3B1, 0x3CA))),
    "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 400))),
    "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 400))),
}


@pytest.mark.parametrize("langs", [("la", "ru", "el"), ("la", "ru", "el", "zh", "ko")])
def test_every_letter_counts(langs):
    rng = np.random.default_rng(5)
    samples = {x: [prose(rng, SCRIPTS[x], 150), prose(rng, SCRIPTS[x], 150)] for x in langs}
    model = langid.Model(samples)
    every = set("".join(SCRIPTS[x] for x in langs)) & set("".join(t for v in samples.values() for t in v))
    assert sorted(model.symbols("".join(sorted(every))).tolist()) == list(range(2, len(every) + 2))
    assert model.symbols("กא").tolist() == [1, 1]
    for x in langs:
        for query in (samples[x][0][10:90], prose(rng, SCRIPTS[x], 30), samples[langs[0]][1][:40] + " " + prose(rng, SCRIPTS[x], 9), "ก" + samples[x][1][:9]):
            assert model.phrases([query])[0][0].tolist() == [phrases(query.lstrip(), " ".join(samples[y]) + " ") for y in model.langs], (x, query)


def test_same_script_told_apart_by_letters():
    rng = np.random.default_rng(6)
    halves = {"aa": SCRIPTS["zh"][:200], "bb": SCRIPTS["zh"][200:], "la": SCRIPTS["la"]}
    model = langid.Model({x: [prose(rng, c, 400)] for x, c in halves.items()})
    assert model.predict([prose(rng, c, 30) for c in halves.values()])[0] == ["aa", "bb", "la"]


def test_long_texts_are_parsed_whole():
    rng = np.random.default_rng(8)
    samples = {"la": [prose(rng, "abcd", 500)], "lb": [prose(rng, "abce", 500)]}
    model = langid.Model(samples)
    piece = samples["la"][0]
    queries = [prose(rng, "abcd", 900), piece * 3, prose(rng, "abcd", 300)[: langid.BLOCK], prose(rng, "abce", 500)[: langid.BLOCK + 1], piece[:700] + "ก" + piece[:900], "a" * 5000]
    got = model.phrases(queries)[0].tolist()
    for q, row in zip(queries, got):
        assert row == [phrases(q, " ".join(samples[y]) + " ") for y in model.langs]
    assert [model.phrases([q])[0][0].tolist() for q in queries] == got


def test_samples_are_whole_texts_within_the_bound(spark):
    rows = [(i, "x" * (10 + i), "en") for i in range(50)] + [(99, "y" * 500, "de"), (98, None, "en"), (97, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.labelled_samples(docs, 5, 100)
    assert len(got["en"]) <= 5 and sum(map(len, got["en"])) <= 100 and set(got["en"]) <= {t for _, t, _ in rows}
    assert got.get("de", ["y" * 100]) == ["y" * 100] and set(got) <= {"en", "de"}


def test_ties_repeats_and_an_empty_table(spark):
    model = {"aa": ["xyz xyz"], "bb": ["xyz xyz"]}
    docs = spark.createDataFrame([(1, "xyz"), (1, "xyz"), (None, "xyz"), (2, "123")], "doc_id long, text string")
    got = [tuple(r) for r in langid.identify(docs, model).collect()]
    assert sorted(got, key=repr) == [(1, "aa", 0.0), (1, "aa", 0.0), (2, "und", 0.0), (None, "aa", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0 and langid.labelled_samples(docs.selectExpr("*", "'e' as lang").limit(0)) == {}
