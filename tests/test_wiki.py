"""Links, folders of notes, streams, mentions and sessions on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioforge import streaming
from folioforge.operators import entities, quality, relations, search, sessions, units, wiki
from folioforge.sources import notes

PAGES = "path string, title string, stem string, kind string, status string, tags array<string>, aliases array<string>, confidence double, visibility string, body string"


def pages(spark, rows):
    return spark.createDataFrame([(f"wiki/{t}.md", t, t, "concept", "published", ["x"], a, 1.0, None, b) for t, a, b in rows], PAGES)


def test_links_outside_prose_do_not_count(spark):
    body = "[[A]] `[[B]]` ```\n[[C]]\n``` $x [[D]]$ $$[[E]]$$ ![alt](u) [text [[F]](u) ![[pic.PNG]] [[G#part|shown]] cost $5 and [[H]] for $6\n[[ ]]"
    got = [r.target for r in wiki.links(pages(spark, [("P", [], body)])).collect()]
    assert got[0] == "A" and "G" in got and not {"B", "C", "E", "pic.PNG"} & set(got)


def test_aliases_of_two_pages_stay_broken(spark):
    p = pages(spark, [("A", ["one", "two"], "[[one]] [[two]] [[B (note)]]"), ("B (note)", ["two", "A"], "[[b]] [[wiki/x]] [[https://x.y]]"), ("C", None, "")])
    assert {(r.path, r.target) for r in wiki.broken_links(p).collect()} == {("wiki/A.md", "two")}
    assert {r.path for r in wiki.orphan_pages(p).collect()} == {"wiki/C.md", "wiki/A.md"}
    assert wiki.health(p.limit(0)).first().health == 100.0


def test_phrase_search_counts_tokens(spark):
    d = spark.createDataFrame([(1, "Café, café! x"), (2, "cafe-cafe cafe"), (3, "nothing"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.hits for r in search.phrase_search(d, '"CAFÉ cafe"').collect()} == {1: 1, 2: 2}
    assert search.phrase_search(d, " !").count() == 0 and search.phrase_search(d.limit(0), "x").count() == 0


def test_greedy_units(spark):
    d = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 3, 20, 1, 1, 1])], "doc long, k int, n int")
    assert [r.unit for r in units.packed_units(d, "doc", "k", 10).orderBy("k").collect()] == [0, 1, 2, 3, 3, 3]


def test_mentions_anywhere(spark):
    d = spark.createDataFrame([(1, "intro,alpha beta end"), (2, "xbetax"), (3, "alpha  beta end"), (4, None)], "doc_id long, text string")
    p = spark.createDataFrame([(1, "alpha beta end"), (2, "beta"), (3, ""), (4, "lpha bet")], "item_id long, phrase string")
    assert {tuple(r) for r in relations.mentions(d, p).collect()} == {(1, 1), (2, 1), (2, 2), (2, 3), (4, 1)}


def test_sessions_across_days(spark):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    rows = [(1, at(23, 50), 1), (2, at(24, 10), 1), (3, at(24, 40), 1), (4, at(72), 1), (5, at(72), None), (6, at(72, 31), None)]
    e = spark.createDataFrame(rows, "id int, ts timestamp, v int")
    assert [r.session_no for r in sessions.sessionize(e, ["v"]).orderBy("id").collect()] == [0, 0, 0, 1, 0, 1]


def test_verdicts(spark):
    none = F.lit(None).cast("double")
    v = lambda *a: spark.range(1).select(quality.verdict(*[F.lit(x) if x is not None else none for x in a])).first()[0]
    assert v(-0.2, 0.0, None, None, None, 3, True, False) == "keep_current"
    assert v(0.0, 0.0, None, None, None, 0, True, False) == "manual_review"
    assert v(0.1, 0.2, None, None, None, 2, False, False) == "switch" and v(0.1, 0.05, None, None, None, 2, False, False) == "manual_review"
    assert v(0.1, 0.2, None, None, None, 2, True, True) == "keep_current"


def test_a_cost_with_an_unknown_price_and_split_without_words(spark):
    s = spark.createDataFrame([("a", k, w) for k, w in enumerate([["x", "y"], ["x", "y"], ["x", "y"], ["z"]])], "concept string, source int, words array<string>")
    assert [tuple(r) for r in quality.split_suggestions(s).collect()] == [("a", 0.0, 0.5)]
    assert entities.occurrences(spark.createDataFrame([("s", "x", None)], "source string, surface string, entity_id long")).first().status == "unresolved"


def test_notes_out_and_in(spark, tmp_path):
    rows = [("a/One.md", {"title": "One"}, "text [[Two]]\n---\n"), ("processed/No.md", {}, "x"), (".hid/No.md", {}, "x"), ("Two.md", None, "é")]
    d = spark.createDataFrame(rows, "path string, fields map<string,string>, body string")
    notes.write_notes(d, str(tmp_path / "vault"))
    got = {r.path: r for r in notes.read_notes(spark, str(tmp_path / "vault")).withColumn("title", notes.field("title")).collect()}
    assert set(got) == {"a/One.md", "Two.md"} and got["a/One.md"].title == "One" and got["a/One.md"].body == "text [[Two]]\n---\n" and got["Two.md"].body == "é"
    notes.append_log(spark.range(2).toDF("n"), str(tmp_path / "log"))
    notes.append_log(spark.range(1).toDF("n"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_changed_notes_stream(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    for text, name in (("one", "a.md"), ("two", "b.md"), ("no", "c.txt")):
        (tmp_path / "in" / name).write_text(text)
    run = lambda: streaming.changed_notes(spark, str(tmp_path / "in"), lambda b, n: seen.extend(sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in b.collect())), str(tmp_path / "check"), None).awaitTermination()
    run()
    (tmp_path / "in" / "d.md").write_text("three")
    run()
    assert seen == [("a.md", b"one"), ("b.md", b"two"), ("d.md", b"three")]


def test_stream_sessions_are_the_batch_ones(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:29:59"), ("u", "2024-01-01 01:30:00"), ("v", "2024-01-01 00:10:00")], "user string, t string").selectExpr("user", "cast(t as timestamp) as ts")
    assert sorted((r.user, r.calls) for r in streaming.sessions(e, ["user"]).collect()) == [("u", 1), ("u", 2), ("v", 1)]


def test_similar_names_equal_all_pairs(spark):
    import random

    from folioforge.operators import identity

    rng = random.Random(4)
    names = [" ".join(rng.sample([f"w{k}" for k in range(12)], rng.randint(1, 8))) for _ in range(150)] + ["a b", "x"]
    d = spark.createDataFrame([(i, n, "preferred") for i, n in enumerate(names)], "entity_id int, label string, role string")
    got = {(r.entity_a, r.entity_b): r.score for r in identity.merge_suggestions(identity.keyed(d)).collect()}
    sets = [{w for w in n.split() if len(w) > 1} for n in names]
    want = {(i, j): round(len(a & b) / len(a | b), 2) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b and 10 * len(a & b) >= 7 * len(a | b)}
    assert {k: v for k, v in got.items()} == want


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 0.9])
def test_similar_names_with_copies_long_names_and_several_labels(spark, monkeypatch, least):
    import random

    from folioforge.operators import identity

    monkeypatch.setattr(identity, "MEMBERS", 4)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(24)]
    names = [" ".join(rng.sample(words[: rng.choice((6, 24))], rng.randint(1, 6))) for _ in range(50)] + [" ".join(rng.sample(words, rng.randint(9, 20))) for _ in range(40)]
    names += [names[0]] * 10 + ["w1", "w1 w2", "w2 w1", "berry x", "berries x", "", None, "a b"]
    rows = [(i, n) for i, n in enumerate(names)] + [(1, "w3 w4"), (2, "w4 w3"), (3, names[4]), (None, "w1")]
    d = spark.createDataFrame([(i, n, "preferred") for i, n in rows], "entity_id int, label string, role string")
    got = [((r.entity_a, r.entity_b), r.score) for r in identity.merge_suggestions(identity.keyed(d), least).collect()]
    want = {}
    for i, n in rows:
        for j, m in rows:
            if None not in (i, j, n, m) and i < j:
                a, b = ({w for w in x.split() if len(w) > 1} for x in (n, m))
                score = 1.0 if {n, m} == {"berry x", "berries x"} else len(a & b) / len(a | b) if a | b else 0.0
                if score >= least:
                    want[i, j] = max(want.get((i, j), 0.0), round(score, 2))
    assert len(got) == len(want) and {k: pytest.approx(v, abs=0.0101) for k, v in want.items()} == dict(got)


def test_merge_suggestions_pair_copies_without_comparing_them(spark, tmp_path):
    from folioforge.queries import knowledge

    d = spark.createDataFrame([(i, "old rod", "Brand#12", "SMALL", 10) for i in range(300)] + [(900, "old rod", None, "SMALL", 10), (901, "old rod", None, "SMALL", 10)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    d.write.parquet(str(tmp_path / "part.parquet"))
    got = knowledge.merge_suggestions(spark, str(tmp_path)).collect()
    assert len(got) == len(set(map(tuple, got))) == 300 * 299 // 2 and all(r.entity_a < r.entity_b < 300 and r.score == 1.0 for r in got)


def test_splits_equal_all_pairs_also_with_repeated_and_missing_sources(spark):
    import random

    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(rng.choice((2, 60)))]), [rng.choice("abcdef") for _ in range(rng.choice((0, 1, 1, 2)))]) for c in "pqrstuv" for _ in range(rng.choice((3, 8, 40)))]
    rows += [("one", 1, ["a"]), ("one", 1, ["a", "b"]), ("one", 1, ["c"]), ("two", 1, ["a"]), ("two", 1, ["a"]), ("two", 2, ["b"]), ("six", 1, ["a", "b"]), ("six", 1, ["a"]), ("six", 2, ["a", "b"]), (None, 1, ["a"]), ("none", 3, None)]
    want = {}
    for c in {r[0] for r in rows} - {None}:
        held = [(s, set(w)) for k, s, w in rows if k == c and w]
        scores = [len(x & y) / len(x | y) for i, (s, x) in enumerate(held) for t, y in held[:i] if None not in (s, t) and s != t]
        if len(held) >= 3 and scores and min(scores) < 0.6 and sum(scores) / len(scores) > 0.05:
            want[c] = (pytest.approx(min(scores), abs=0.0051), pytest.approx(sum(scores) / len(scores), abs=0.0051))
    d = spark.createDataFrame(rows, "concept string, source int, words array<string>")
    got = {r.concept: (r.least, r["mean"]) for r in quality.split_suggestions(d, 3, 0.6, 0.05).collect()}
    assert len(want) > 4 and got == want


def test_split_suggestions_count_copies_of_word_sets(spark, tmp_path):
    from folioforge.queries import wiki as registered

    d = spark.range(150000).selectExpr("id as p_partkey", "'old rod' as p_name", "if(id % 2 = 0, 'Brand#1', 'Brand#2') as p_brand", "if(id % 3 = 0, 'SMALL', 'LARGE') as p_type")
    d.unionByName(spark.sql("select 200000L as p_partkey, 'old rod' as p_name, cast(null as string) as p_brand, 'PROMO' as p_type")).write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in registered.split_suggestions(spark, str(tmp_path)).collect()] == [("old rod", 0.0, 0.44)]
