"""Pages of a wiki: their links, the titles they answer to, and what is wrong with them.

Pages are rows of path, title, stem, kind, status, tags, aliases, confidence, visibility, body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text

#: File types that a link to a medium ends with.
MEDIA = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "tiff", "avif", "mp4", "webm", "ogv", "mov", "mkv", "avi", "mp3", "wav", "ogg", "flac", "m4a", "pdf", "csv", "xlsx", "docx")
#: Folders of a vault, fields that every page has, ranks of a status, pages outside the graph.
FOLDERS = ("wiki", "raw", "source", "sources", "queries", ".drafts", ".olw")
REQUIRED = ("title", "status", "tags")
RANKS = {"draft": 0, "verified": 1, "published": 2}
SYSTEM = ("index", "log")

#: What is no prose: fenced and inline code, formulas, images, links with an address.
NO_PROSE = "|".join([r"```[\s\S]*?```", r"`[^`]+`", r"\$\$[\s\S]*?\$\$", r"(?<!\$)\$(?!\$)(?:\\.|[^$\n])+?(?<!\\)\$(?!\$)", r"\\\([\s\S]*?\\\)", r"!\[[^\]]*\]\([^)]*\)", r"\[[^\]\n]+\]\([^)]*\)"])
LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"


def prose(body: Column) -> Column:
    """The body with a blank for everything in which links and tags don't count."""
    return F.regexp_replace(body, NO_PROSE, " ")


def links_of(body: Column) -> Column:
    """Targets of the links in a body, media left out, in order."""
    media = rf"\.({'|'.join(MEDIA)})$"
    return F.filter(F.regexp_extract_all(prose(body), F.lit(LINK), F.lit(1)), lambda t: ~F.lower(t).rlike(media))


def links(pages: DataFrame) -> DataFrame:
    """path, stem, kind, target: a row for each link."""
    return pages.select("path", "stem", "kind", F.explode(links_of(F.col("body"))).alias("target"))


def page_kind(path: Column) -> Column:
    """draft, system, synthesis, source, query or concept, by where a page lies."""
    low = F.lower(path)
    inside = lambda d: low.rlike(rf"(^|/){d}/")
    name = F.element_at(F.split(low, "/"), -1)
    return F.when(path.rlike(r"(^|/)\.drafts/"), "draft").when(name.isin("index.md", "log.md"), "system").when(inside("synthesis"), "synthesis").when(inside("sources"), "source").when(inside("queries"), "query").otherwise("concept")


def title_index(pages: DataFrame) -> DataFrame:
    """key, path: titles, stems and paths within the wiki; aliases that one page alone has and that are none of those."""
    rel = F.regexp_replace(F.regexp_replace("path", "^wiki/", ""), r"\.md$", "")
    own = pages.select(F.explode(F.array(F.lower("stem"), F.lower(rel), F.lower("title"))).alias("key"), "path").filter("key is not null").groupBy("key").agg(F.min("path").alias("path"))
    base = F.trim(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", ""))
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when((base != "") & (base != F.col("title")), F.array(base)).otherwise(F.array().cast("array<string>")))
    alias = pages.select(F.explode(names).alias("a"), "path").select(F.lower(F.trim("a")).alias("key"), "path").filter("key != ''")
    one = alias.groupBy("key").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")
    return own.unionByName(one.join(own, "key", "left_anti"))


def inbound(pages: DataFrame) -> DataFrame:
    """key, stems: for each link target (lower case), the pages outside the drafts that link to it."""
    return links(pages.filter("kind != 'draft'")).groupBy(F.lower("target").alias("key")).agg(F.array_sort(F.collect_set("stem")).alias("stems"))


def broken_links(pages: DataFrame) -> DataFrame:
    """path, target: links without a page, each once for a page; addresses and folders of the vault don't count."""
    t, low = F.rtrim(F.col("target")), F.lower("target")
    address = F.col("target").rlike("^https?://") | (F.col("target").contains("/") & F.split("target", "/")[0].contains("."))
    folder = F.rtrim(F.regexp_replace(t, "/+$", "")).isin(*FOLDERS) | (~low.startswith("sources/") & F.col("target").rlike(rf"^({'|'.join(f.replace('.', chr(92) + '.') for f in FOLDERS)})/"))
    found = links(pages).withColumn("key", low).filter(~address & ~folder)
    missing = found.join(title_index(pages).select("key"), "key", "left_anti")
    return missing.groupBy("path", "key").agg(F.min("target").alias("target")).select("path", "target")


def orphan_pages(pages: DataFrame) -> DataFrame:
    """path: concept pages to which no page but themselves and the system pages links."""
    concept = pages.filter("kind = 'concept'").select("path", "stem", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("stem")))).alias("key"))
    into = links(pages.filter("kind != 'draft'")).filter(~F.lower("stem").isin(*SYSTEM)).select(F.lower("target").alias("key"), F.col("stem").alias("from")).distinct()
    linked = concept.join(into, "key").filter("from != stem").select("path")
    return pages.filter("kind = 'concept'").select("path").join(linked, "path", "left_anti")


def disconnected_drafts(pages: DataFrame) -> DataFrame:
    """path: drafts that link to no other draft; none if all drafts have one title."""
    title = F.lower(F.coalesce("title", "stem"))
    drafts = pages.filter("kind = 'draft'").select("path", title.alias("own"), "body")
    titles = drafts.select(F.col("own").alias("key")).distinct()
    several = titles.limit(2).agg(F.count("*") == 2).scalar()
    to = drafts.select("path", "own", F.explode(links_of(F.col("body"))).alias("target")).select("path", "own", F.lower("target").alias("key")).filter("key != own")
    linked = to.join(titles, "key", "left_semi").select("path").distinct()
    return drafts.select("path").join(linked, "path", "left_anti").filter(several)


def issues(pages: DataFrame) -> DataFrame:
    """path, issue: everything found on the pages, each issue once for a page."""
    each = lambda rows, issue: rows.select("path", F.lit(issue).alias("issue"))
    lacks = F.exists(F.array(*[F.col(c).isNull() for c in REQUIRED]), lambda x: x)
    bad = F.exists("tags", lambda t: t != text.tag(t))
    inline = prose(F.col("body")).rlike(r"(^|[^/\p{L}\p{N}_])#\p{L}")
    found = [each(pages.filter(lacks), "missing_frontmatter"), each(pages.filter(bad), "invalid_tag"), each(pages.filter("confidence < 0.3"), "low_confidence"), each(pages.filter(inline), "inline_tag"), each(broken_links(pages), "broken_link"), each(orphan_pages(pages), "orphan")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


#: Issues that don't count against the health of a wiki.
ADVISORY = ("inline_tag",)


def health(pages: DataFrame) -> DataFrame:
    """health: share of pages without a structural issue, in percent, one decimal."""
    bad = issues(pages).filter(~F.col("issue").isin(*ADVISORY)).select("path").distinct().withColumn("bad", F.lit(1)).withColumn("page", F.lit(0))
    n = pages.select("path", F.lit(0).alias("bad"), F.lit(1).alias("page")).unionByName(bad).agg(F.sum("bad").alias("b"), F.sum("page").alias("p"))
    share = 100.0 * (1 - F.coalesce("b", F.lit(0)) / F.greatest(F.coalesce("p", F.lit(0)), F.lit(1)))
    return n.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)), 1).alias("health"))


def chosen(pages: DataFrame, contains: str | None = None, tag: str | None = None, kind: str | None = None, min_status: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Pages that pass every given filter; without a status a page counts as published, without a confidence it passes."""
    rank = F.coalesce(*[F.when(F.col("status") == s, r) for s, r in RANKS.items()], F.when(F.col("status").isNull(), RANKS["published"]))
    out = pages
    if contains is not None:
        out = out.filter(F.contains(F.lower("title"), F.lit(contains.lower())) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lit(contains.lower())))
    if tag is not None:
        out = out.filter(F.coalesce(F.array_contains("tags", tag), F.lit(False)))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if min_status in RANKS:
        out = out.filter(rank >= RANKS[min_status])
    if min_confidence is not None:
        out = out.filter(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    return out


def visible(pages: DataFrame, excluded: list[str], default: str = "public") -> DataFrame:
    """Public pages without an excluded tag."""
    hidden = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, excluded))) if excluded else F.lit(False)
    return pages.filter((F.coalesce("visibility", F.lit(default)) == "public") & ~hidden)


def found(pages: DataFrame, term: str) -> DataFrame:
    """path, found_by: alias, title or summary, the first of them that holds the term."""
    low = F.lit(term.lower())
    by = F.when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == low), "alias").when(F.contains(F.lower("title"), low) | F.contains(F.lower("stem"), low), "title").when(F.contains(F.lower(F.coalesce("summary", F.lit(""))), low), "summary")
    return pages.select("path", by.alias("found_by")).filter("found_by is not null")


def resolved_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (name) with the page of it: by path, else by title (concept before source before synthesis), else by an alias that one page has."""
    order = F.when(F.col("kind") == "concept", 1).when(F.col("kind") == "source", 2).when(F.col("kind") == "synthesis", 3).otherwise(4)
    keys = pages.select(F.lower("path").alias("key"), "path", F.lit(0).alias("rank"))
    keys = keys.unionByName(pages.select(F.lower("title").alias("key"), "path", order.alias("rank")))
    one = pages.select(F.explode("aliases").alias("a"), "path").groupBy(F.lower("a").alias("key")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).filter("n = 1")
    keys = keys.unionByName(one.select("key", "path", F.lit(9).alias("rank")))
    best = keys.filter("key is not null").groupBy("key").agg(F.min(F.struct("rank", "path")).alias("b"))
    return wanted.withColumn("key", F.lower("name")).join(best, "key", "left").select("name", F.col("b.path").alias("path"))


def page_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or changed (another hash of the body); pages as before are left out."""
    a = before.select(F.col("path").alias("p"), F.sha2(F.col("body").cast("binary"), 256).alias("old"))
    b = after.select("path", F.sha2(F.col("body").cast("binary"), 256).alias("new"))
    j = a.join(b, F.col("p") == F.col("path"), "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select(F.coalesce("path", "p").alias("path"), change.alias("change")).filter("change is not null")
