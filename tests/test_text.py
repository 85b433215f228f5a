"""Text rules on hand-made rows, with results read off the reference's rules."""

from pyspark.sql import functions as F

from folioforge.functions import text


def results(spark, rule, rows):
    d = spark.createDataFrame(list(enumerate(rows)), "i int, c string")
    return [r.r for r in d.select("i", rule(F.col("c")).alias("r")).orderBy("i").collect()]


def test_first_paragraph(spark):
    words = "word " * 60
    rows = {
        None: None,
        "": None,
        "# Title\n\n#tag is text": "#tag is text",
        "####### seven": "####### seven",
        "##": "##",
        "## Title\r\n  See [[A page]] and [[B#part|the B]] [S1](#s1), **bold** and _soft_ .": "See A page and the B, bold and soft.",
        "[S1](#s1) [S12](#s12)\n**Next** line": "Next line",
        "a  b\u2028c": "a b",
        "x" * 200: "x" * 200,
        "One sentence of some length. " + words: "One sentence of some length.",
        "Short one. A sentence that ends later. " + words: ("Short one. A sentence that ends later. " + words)[:200].rsplit(" ", 1)[0] + "…",
        "y" * 19 + ". " + words: ("y" * 19 + ". " + words)[:200].rsplit(" ", 1)[0] + "…",
        "y" * 20 + ". " + words: "y" * 20 + ".",
        "z " * 124 + "zz. " + words: "z " * 99 + "z…",
        "z " * 123 + "zz. " + words: "z " * 123 + "zz.",
        "z " * 124 + "z.z " + words: "z " * 124 + "z.",
        "w" * 195 + ",;: " + words: "w" * 195 + "…",
        "v" * 300: "v" * 200 + "…",
        "." * 100 + "," * 150 + "a": None,
        "\U0001f600" * 201: "\U0001f600" * 200 + "…",
    }
    assert dict(zip(rows, results(spark, text.first_paragraph, rows))) == rows


def test_keys_of_any_script(spark):
    from folioforge.operators import identity

    rows = ["Straße", "STRASSE", "e\u0301tude", "\u00c9TUDE", "\uff21\uff22\uff23", "abc", "Users", "User", "Lens", "Len", "HTTPS", "", None, "«Zitat»", "zitat", "a_b/c-d:e"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "entity_id int, label string").selectExpr("*", "'preferred' as role")
    got = {r.entity_id: (r.label_key, r.match_key) for r in identity.keyed(d).collect()}
    assert got[0][0] == got[1][0] == "strasse" and got[2] == got[3] and got[4][0] == got[5][0] == "abc" and got[13][0] == got[14][0]
    assert got[6][1] == got[7][1] == "user" and got[8][1] == "lens" and got[9][1] == "len" and got[10][1] == "http"
    assert got[11] == ("", "") and got[12] == (None, None) and got[15][0] == "a b c d e"
    found = identity.resolve(spark.createDataFrame([("strasse",), ("ÉTUDE",)], "surface string"), identity.keyed(d)).collect()
    assert {(r.surface, r.status) for r in found} == {("strasse", "ambiguous"), ("ÉTUDE", "ambiguous")}


def test_display_names(spark):
    rows = {"Phase II)": "Phase II", "(draft": "draft", "Extreme Programming (XP)": "Extreme Programming (XP)", "(a) (b": "(a) (b", "Phase II))": "Phase II", "Yahoo!)": "Yahoo!", "f(x)": "f(x)", '"quoted"': "quoted", "(": "(", "[x] y]": "[x] y", "((a)": "(a)"}
    assert {k: text.display_name(k) for k in rows} == rows
    assert results(spark, text.clean_name, ["  «Phase  II)» ", None]) == ["Phase II", None]


def test_names_and_notes(spark):
    long = "---\ntitle: A\ntags: [x]\n---\nbody\n---\nmore"
    assert results(spark, lambda c: text.frontmatter(c)[0], [long, "no", None, "---\nopen"]) == ["title: A\ntags: [x]", None, None, None]
    assert results(spark, lambda c: text.frontmatter(c)[1], [long, "no", None]) == ["body\n---\nmore", "no", None]
    assert results(spark, text.is_noise, ["Untitled", "unknown thing", "a thing unknown", "Thing", " - "]) == [True, True, True, False, True]
    assert results(spark, text.base_name, ["Extreme Programming (XP)", "Thing (note)", "X (A)", "plain"]) == ["Extreme Programming", "Thing (note)", "X (A)", "plain"]
    assert results(spark, lambda c: text.derived_title(F.lit(""), c), ["what is the best way to do it today?"]) == ["What Is The Best Way To Do It"]
    assert results(spark, lambda c: text.text_stats(c)[1], ["see ![[a.png]] `code x` https://x.y/z two **words**", None]) == [3, None]
    assert results(spark, text.without_pictures, ["a **----- Start of picture text -----**<br>junk\n**----- End of picture text -----**<br> b", "x **==> picture [1 x 2] intentionally omitted <==** y"]) == ["a  b", "x  y"]
