"""Phrase search with BM25, licence gate, query expansion."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters below U+0250 with marks, and the letters without; marks by themselves come last and stand for nothing."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.combining((unicodedata.normalize("NFD", chr(c)) + " ")[1])]
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


PLAIN = _plain_letters()


def token_line(c: Column) -> Column:
    """Lower-case tokens (runs of letters, numbers, private characters) without marks, a blank before and after each."""
    x = F.translate(F.lower(c), *PLAIN)
    return F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), r"[^\p{L}\p{N}\p{Co}]+", " ")


def phrase_search(segments: DataFrame, phrase: str, key: str = "doc_id", body: str = "text", limit: int = 50) -> DataFrame:
    """key, hits, score: segments that hold the phrase, best first; score is BM25 with the phrase as one term.

    Lengths and counts are summed in one pass; the ranking is a top-k of the segments that have the phrase.
    """
    words = [w for w in segments.sparkSession.range(1).select(token_line(F.lit(phrase))).first()[0].split(" ") if w]
    if not words:
        return segments.select(key, F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("score")).limit(0)
    rows = segments.select(key, token_line(F.coalesce(F.col(body), F.lit(""))).alias("line"))
    rows = rows.select(key, F.regexp_count("line", F.lit("[^ ]+")).alias("n"), F.regexp_count("line", F.lit(f"(?= {' '.join(words)} )")).alias("hits"))
    total, size, df = rows.agg(F.count("*"), F.sum("n"), F.count_if(F.col("hits") > 0)).first()
    if not df:
        return rows.select(key, F.col("hits").cast("long"), F.lit(0.0).alias("score")).limit(0)
    idf = F.log(F.lit((total - df + 0.5) / (df + 0.5)))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    score = idf * F.col("hits") * 2.2 / (F.col("hits") + 1.2 * (0.25 + 0.75 * F.col("n") / F.lit(size / total)))
    return rows.filter("hits > 0").select(key, F.col("hits").cast("long").alias("hits"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def snippet(body: Column, phrase: str, tokens: int = 32) -> Column:
    """Up to `tokens` words from the start of the phrase on, with an ellipsis where more follow."""
    words = F.split(F.trim(F.regexp_replace(F.substring(body, F.greatest(F.locate(phrase.lower(), F.lower(body)), F.lit(1)), F.length(body)), r"\s+", " ")), " ")
    return F.concat(F.array_join(F.slice(words, 1, tokens), " "), F.when(F.size(words) > tokens, "…").otherwise(""))


def index_drift(table: DataFrame, index: DataFrame) -> DataFrame:
    """key, state of rows (key, hash) whose index entry is missing, stale, or without a row (extra)."""
    i = index.select(F.col("key").alias("k"), F.col("hash").alias("h"))
    j = table.join(i, F.col("key") == F.col("k"), "full")
    state = F.when(F.col("k").isNull(), "missing").when(F.col("key").isNull(), "extra").when(F.col("hash") != F.col("h"), "stale")
    return j.select(F.coalesce("key", "k").alias("key"), state.alias("state")).filter("state is not null")


def allowed(licence: Column, mode: str, permissive: list[str]) -> Column:
    """Whether a source may be shown; under permissive_only an unknown licence may not."""
    if mode == "all":
        return F.lit(True)
    if mode == "deny":
        return F.lit(False)
    return F.coalesce(F.lower(licence).isin(*[p.lower() for p in permissive]), F.lit(False))


def effective_mode(sources: DataFrame, mode: str) -> str:
    """permissive_only becomes all where no source has a licence."""
    return "all" if mode == "permissive_only" and sources.filter("licence is not null").isEmpty() else mode


def expanded(questions: DataFrame, aliases: DataFrame, most: int = 10, least: int = 3) -> DataFrame:
    """questions (id, question) with the concepts whose alias is in them as whole words, in the order they come up.

    aliases: alias, concept. Short aliases count only in capitals. Questions are cut into runs of as many words as an
    alias has, and meet aliases on equal runs: no pattern over all aliases.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    usable = (F.length("alias") >= least) | ((F.length("alias") >= 2) & (F.col("alias") == F.upper("alias")) & (F.col("alias") != F.lower("alias")))
    a = aliases.filter(usable).select(clean(F.col("alias")).alias("run"), "concept").filter("run != ''").distinct()
    a = a.withColumn("size", F.size(F.split("run", " ")))
    sizes = [r[0] for r in a.select("size").distinct().collect()]  # word counts of aliases: a few
    q = questions.select("id", F.split(clean(F.col("question")), " ").alias("w"))
    runs = None
    for n in sorted(sizes):
        every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))  # noqa: B023
        part = q.filter(F.size("w") >= n).select("id", F.posexplode(every).alias("at", "run"))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return questions.select("id", F.lit(1).alias("rank"), F.lit("").alias("concept")).limit(0)
    met = runs.join(a.select("run", "concept"), "run").groupBy("id", "concept").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("at", "concept"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "rank", "concept")
