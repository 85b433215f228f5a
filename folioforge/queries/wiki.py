"""Pages, links, search and quality. The fixture has no wiki: pages are made of documents by the rule that WIKI states."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import entities, quality, search, units, wiki
from folioforge.queries.knowledge import docs
from folioforge.sources import metric_events, table

Q = {}


def add(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def pages(spark, d):
    """Each document as a page; its links, before the text, go to other pages, itself, aliases, media, code and addresses."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    topic = lambda c: F.concat(F.lit("Topic "), s(c))
    title = topic(n)
    path = F.concat(F.when(n % 11 == 3, "wiki/.drafts/").when(n % 5 == 1, "wiki/sources/").when(n % 5 == 0, "wiki/synthesis/").otherwise("wiki/"), title, F.lit(".md"))
    body = F.concat(F.lit("[["), topic((n * 7 + 3) % 1500), F.lit("]] [[topic "), s(n + 1), F.lit("|shown]] [["), title, F.lit("]] ![[pic"), s(n), F.lit(".png]] `[[Topic 0]]` [[Alias "), s(n % 40), F.lit("]] [[https://x.org/"), s(n), F.lit("]]\n"), F.coalesce("text", F.lit("")))
    status = F.when(n % 4 == 0, "draft").when(n % 4 == 1, "verified").when(n % 4 == 2, "published")
    tags = F.when(n % 13 != 0, F.array(F.lower("source"), F.when(n % 7 == 0, "Bad Tag").otherwise("note")))
    conf = F.when(n % 17 != 0, F.round((n % 10) / 10.0, 1))
    return docs(spark, d).select(title.alias("title"), title.alias("stem"), path.alias("path"), wiki.page_kind(path).alias("kind"), status.alias("status"), tags.alias("tags"), F.array(F.concat(F.lit("Alias "), s(n % 700))).alias("aliases"), conf.alias("confidence"), F.when(n % 9 == 0, "private").alias("visibility"), F.lit(None).cast("string").alias("summary"), body.alias("body"))


WIKI = """p as (select doc_id, 'Topic ' || doc_id as title, case when doc_id % 11 = 3 then 'wiki/.drafts/' when doc_id % 5 = 1 then 'wiki/sources/' when doc_id % 5 = 0 then 'wiki/synthesis/' else 'wiki/' end || 'Topic ' || doc_id || '.md' as path,
 case when doc_id % 11 = 3 then 'draft' when doc_id % 5 = 1 then 'source' when doc_id % 5 = 0 then 'synthesis' else 'concept' end as kind,
 case doc_id % 4 when 0 then 'draft' when 1 then 'verified' when 2 then 'published' end as status, case when doc_id % 13 <> 0 then [lower(source), case when doc_id % 7 = 0 then 'Bad Tag' else 'note' end] end as tags,
 'Alias ' || doc_id % 700 as alias, case when doc_id % 17 <> 0 then round((doc_id % 10) / 10.0, 1) end as confidence, case when doc_id % 9 = 0 then 'private' end as visibility, coalesce(text, '') as text from documents),
l as (select path, title as stem, kind, unnest(['Topic ' || (doc_id * 7 + 3) % 1500, 'topic ' || (doc_id + 1), title, 'Alias ' || doc_id % 40, 'https://x.org/' || doc_id]) as target from p),
own as (select key, min(path) as path from (select lower(title) as key, path from p union all select lower(replace(replace(path, 'wiki/', ''), '.md', '')), path from p) group by 1),
ix as (select * from own union all select lower(alias), min(path) from p where lower(alias) not in (select key from own) group by 1 having count(distinct path) = 1),
broken as (select path, min(target) as target from l where target not like 'http%' and lower(target) not in (select key from ix) group by path, lower(target)),
orphan as (select path from p where kind = 'concept' and lower(title) not in (select lower(target) from l where kind <> 'draft' and lower(target) <> lower(stem))),
issue as (select path, 'missing_frontmatter' as issue from p where status is null or tags is null union select path, 'invalid_tag' from p where list_contains(tags, 'Bad Tag')
 union select path, 'low_confidence' from p where confidence < 0.3 union select path, 'broken_link' from broken union select path, 'orphan' from orphan
 union select path, 'inline_tag' from p where regexp_matches(regexp_replace(regexp_replace(text, '\\$\\$[\\s\\S]*?\\$\\$', ' ', 'g'), '`[^`]+`', ' ', 'g'), '(^|[^/\\p{L}\\p{N}_])#\\p{L}'))
"""


@add("wikilinks", f"with {WIKI} select path, target, count(*) as links from l group by 1, 2")
def wikilinks(spark, d):
    return wiki.links(pages(spark, d)).groupBy("path", "target").agg(F.count("*").alias("links"))


@add("title_index", f"with {WIKI} select key, path from ix")
def title_index(spark, d):
    return wiki.title_index(pages(spark, d))


@add("inbound_links", f"with {WIKI} select lower(target) as key, count(distinct stem) as pages from l where kind <> 'draft' group by 1")
def inbound_links(spark, d):
    return wiki.inbound(pages(spark, d)).select("key", F.size("stems").cast("long").alias("pages"))


@add("broken_links", f"with {WIKI} select path, target from broken")
def broken_links(spark, d):
    return wiki.broken_links(pages(spark, d))


@add("orphan_pages", f"with {WIKI} select path from orphan")
def orphan_pages(spark, d):
    return wiki.orphan_pages(pages(spark, d))


@add("lint_issues", f"with {WIKI} select path, issue from issue")
def lint_issues(spark, d):
    return wiki.issues(pages(spark, d))


@add("lint_summary", f"with {WIKI} select issue, count(*) as pages, count(*) filter (path like '%drafts%') as in_drafts from issue group by 1")
def lint_summary(spark, d):
    i = wiki.issues(pages(spark, d))
    return i.groupBy("issue").agg(F.count("*").alias("pages"), F.count_if(F.col("path").contains("drafts")).alias("in_drafts"))


@add("health_score", f"with {WIKI} select round(greatest(0.0, least(100.0, 100.0 * (1 - (select count(distinct path) from issue where issue <> 'inline_tag') / greatest((select count(*) from p), 1)))), 1) as health")
def health_score(spark, d):
    """Share of pages without a structural issue, in percent."""
    return wiki.health(pages(spark, d))


@add("repaired_links", f"with {WIKI} select b.path, b.target, x.path as page from broken b join ix x on x.key = lower(trim(regexp_replace(b.target, '[^a-zA-Z ]+', '0', 'g')))")
def repaired_links(spark, d):
    """Broken links whose cleaned form is a page's key (here: any number stands for 0)."""
    p = pages(spark, d)
    key = F.lower(F.trim(F.regexp_replace("target", "[^a-zA-Z ]+", "0")))
    return wiki.broken_links(p).withColumn("key", key).join(wiki.title_index(p).withColumnRenamed("path", "page"), "key").select("path", "target", "page")


@add("stubs", f"with {WIKI} select target as title, count(*) as pages from broken group by 1 order by pages desc, title limit 5")
def stubs(spark, d):
    """New pages for the broken links that most pages have; 5 at most in a run."""
    return wiki.broken_links(pages(spark, d)).groupBy(F.col("target").alias("title")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "title").limit(5)


@add("article_filter", f"with {WIKI} select path from p where list_contains(tags, 'note') and kind = 'concept' and coalesce(case status when 'draft' then 0 when 'verified' then 1 end, 2) >= 1 and coalesce(confidence, 1) >= 0.5 and contains(lower(title), 'topic')")
def article_filter(spark, d):
    return wiki.chosen(pages(spark, d), contains="TOPIC", tag="note", kind="concept", min_status="verified", min_confidence=0.5).select("path")


@add("visible_pages", f"with {WIKI} select path from p where coalesce(visibility, 'public') = 'public' and not coalesce(list_contains(tags, 'Bad Tag'), false)")
def visible_pages(spark, d):
    return wiki.visible(pages(spark, d), ["Bad Tag", "secret"]).select("path")


@add("find_pages", f"with {WIKI} select path, case when lower(alias) = 'alias 17' then 'alias' else 'title' end as found_by from p where lower(alias) = 'alias 17' or contains(lower(title), 'alias 17')")
def find_pages(spark, d):
    return wiki.found(pages(spark, d), "Alias 17")


@add("resolved_pages", f"""with {WIKI}, w as (select distinct target as name from l union select distinct path from p), k as (select lower(path) as key, path, 0 as rank from p
 union all select lower(title), path, case kind when 'concept' then 1 when 'source' then 2 when 'synthesis' then 3 else 4 end from p union all select lower(alias), min(path), 9 from p group by 1 having count(distinct path) = 1)
select name, (select first(path order by rank, path) from k where key = lower(name)) as path from w""")
def resolved_pages(spark, d):
    p = pages(spark, d)
    wanted = wiki.links(p).select(F.col("target").alias("name")).union(p.select("path")).distinct()
    return wiki.resolved_pages(wanted, p)


@add("page_changes", f"with {WIKI} select path, case when doc_id % 3 = 0 then 'added' when doc_id % 3 = 1 then 'removed' else 'changed' end as change from p where doc_id % 6 <> 2")
def page_changes(spark, d):
    """Between two snapshots: a third of the pages is new, a third gone, of the rest every second one has another body."""
    p = pages(spark, d).withColumn("n", F.split("title", " ")[1].cast("long"))
    before = p.filter("n % 3 != 0")
    after = p.filter("n % 3 != 1").withColumn("body", F.when(F.col("n") % 6 == 5, F.concat("body", F.lit("\nmore"))).otherwise(F.col("body")))
    return wiki.page_changes(before, after)


@add("page_kinds", f"with {WIKI} select kind, count(*) as pages from p group by 1")
def page_kinds(spark, d):
    return pages(spark, d).groupBy("kind").agg(F.count("*").alias("pages"))


BM25 = """with t as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents),
c as (select doc_id, len(w) as n, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) as hits from t),
s as (select count(*) as total, sum(n) / count(*) as size, count(*) filter (hits > 0) as df from c)
select doc_id, cast(hits as bigint) as hits, round(case when ln((total - df + 0.5) / (df + 0.5)) > 0 then ln((total - df + 0.5) / (df + 0.5)) else 1e-6 end * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n / size)), 6) as score
from c, s where hits > 0 order by score desc, doc_id limit 50"""


@add("phrase_search", BM25)
def phrase_search(spark, d):
    return search.phrase_search(docs(spark, d), "of the")


@add("index_drift", "select doc_id as key, case when doc_id % 3 = 0 then 'missing' else 'stale' end as state from documents where doc_id % 3 = 0 or (doc_id % 3 = 1 and lang = 'de') union all select doc_id + 1000000000, 'extra' from documents where lang = 'fr'")
def index_drift(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("key"), "lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    old = t.filter("key % 3 != 0").withColumn("hash", F.when((F.col("lang") == "de") & (F.col("key") % 3 == 1), "old").otherwise(F.col("hash")))
    gone = t.filter("lang = 'fr'").withColumn("key", F.col("key") + 1000000000)
    return search.index_drift(t.drop("lang"), old.unionByName(gone).drop("lang"))


@add("licence_gate", """with s as (select source, case ascii(right(source, 1)) % 4 when 0 then 'MIT' when 1 then 'CC-BY' when 2 then 'custom' end as licence from documents)
select source, count(*) as segments, count(*) filter (lower(licence) in ('mit', 'cc-by')) as shown, count(*) filter (coalesce(lower(licence) not in ('mit', 'cc-by'), true)) as hidden_by_policy from s group by 1""")
def licence_gate(spark, d):
    k = F.ascii(F.right("source", F.lit(1))) % 4
    s = docs(spark, d).select("source", F.when(k == 0, "MIT").when(k == 1, "CC-BY").when(k == 2, "custom").alias("licence"))
    ok = search.allowed(F.col("licence"), search.effective_mode(s, "permissive_only"), ["mit", "cc-by"])
    return s.groupBy("source").agg(F.count("*").alias("segments"), F.count_if(ok).alias("shown"), F.count_if(~ok).alias("hidden_by_policy"))


@add("query_expansion", """with a as (select distinct list_extract(string_split(p_name, ' '), -1) as alias, p_name as concept from part), q as (select p_partkey as id, string_split(trim(regexp_replace(lower('Compare a ' || p_name || ' or ' || p_type), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ') as w from part),
m as (select id, concept, min(list_position(w, alias)) as pos from q join a on list_contains(w, alias) where length(alias) >= 3 group by 1, 2)
select id, cast(rank as int) as rank, concept from (select *, row_number() over (partition by id order by pos, concept) as rank from m) where rank <= 10""")
def query_expansion(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Compare a "), "p_name", F.lit(" or "), "p_type").alias("question"))
    a = p.select(F.element_at(F.split("p_name", " "), -1).alias("alias"), F.col("p_name").alias("concept")).distinct()
    return search.expanded(q, a)


UNITS = """with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn) as k, turn, cast(coalesce(length(text), 0) as bigint) as n from conversations),
r as (select conv_id, k, turn, n, cast(0 as bigint) as unit, n + {first} as filled from t where k = 1 union all
 select t.conv_id, t.k, t.turn, t.n, case when r.filled + t.n + {join} > {most} then r.unit + 1 else r.unit end, case when r.filled + t.n + {join} > {most} then t.n + {first} else r.filled + t.n + {join} end from r join t on t.conv_id = r.conv_id and t.k = r.k + 1)
select conv_id, turn, n, cast(unit as int) as unit from r"""


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@add("segment_units", UNITS.format(first=2, join=2, most=600))
def segment_units(spark, d):
    """Whole segments in order, packed greedily; a long one is a unit by itself."""
    return units.packed_units(turns(spark, d), "conv_id", "turn", 600)


@add("page_parts", UNITS.format(first=0, join=1, most=500))
def page_parts(spark, d):
    """Pages of a group to parts, a joining character between two."""
    return units.packed_units(turns(spark, d), "conv_id", "turn", 500, 1, False)


@add("page_groups", """with s as (select *, case when turn % 4 <> 3 then role end as slug from conversations), f as (select *, case when slug is null or slug is distinct from lag(slug) over w or lag(turn) over w is null then 1 else 0 end as brk from s window w as (partition by conv_id order by turn)),
r as (select *, sum(brk) over (partition by conv_id order by turn) as run from f) select conv_id, min(turn) as first, max(turn) as last, min(slug) as slug from r group by conv_id, run""")
def page_groups(spark, d):
    c = table(spark, d, "conversations").withColumn("slug", F.when(F.col("turn") % 4 != 3, F.col("role")))
    return units.page_groups(c, "conv_id", "turn", "slug")


@add("contents_groups", """with e as (select conv_id as doc, turn as n, role as s, turn * 3 as page from conversations), k as (select *, row_number() over (partition by doc, s order by n) as k, lead(page) over (partition by doc order by n) as nxt from e)
select doc, n, case when k > 1 then s || '-' || k else s end as slug, page as first, coalesce(nxt - 1, 9999) as last from k""")
def contents_groups(spark, d):
    e = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.col("role").alias("slug"), (F.col("turn") * 3).alias("page"))
    return units.contents_groups(e, F.lit(9999).cast("long"))


@add("within_budget", """with s as (select source, doc_id, left(coalesce(text, ''), 8000) as t from documents), r as (select *, sum(length(t)) over (partition by source order by doc_id) - length(t) as before from s)
select source, doc_id, sha256(left(t, cast(20000 - before as bigint))) as body_sha256 from r where before < 20000""")
def within_budget(spark, d):
    """Sources' notes for a prompt: 8000 characters of each, 20000 in all."""
    x = docs(spark, d).select("source", "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return units.within_budget(x, "source", "doc_id", "t", 8000, 20000).select("source", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("body_sha256"))


@add("chunks_to_do", "select doc_id, cast(i as int) as idx from (select *, unnest(range(0, length(text) // 3000 + 1)) as i from documents where text is not null) where not (doc_id % 2 = 0 and i < 2 and lang <> 'de')")
def chunks_to_do(spark, d):
    """Chunks without a checkpoint of the same hash, number and size."""
    x = docs(spark, d).filter("text is not null").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 3000).cast("int"))).alias("idx"))
    done = x.filter("doc_id % 2 = 0 and idx < 2").select("doc_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")).alias("hash"), "idx")
    return x.join(done, ["doc_id", "hash", "idx"], "left_anti").select("doc_id", "idx")


@add("first_language", "select source, first(lang order by doc_id) as lang, first(doc_id order by doc_id) as first_chunk from documents where lang is not null group by 1")
def first_language(spark, d):
    x = docs(spark, d).filter("lang is not null")
    return x.groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("first_chunk"))


@add("draft_annotations", """with x as (select source, least(1.0, 0.25 * count(*)) as conf, count(*) as n, bool_and(coalesce(quality, 1) = 0) as low from documents left join labels using (doc_id) group by 1)
select source, array_to_string(list_filter([case when conf < 0.4 then 'low-confidence' end, case when n < 2 then 'single-source' end, case when n > 0 and low then 'low-quality-sources' end], lambda v: v is not null), ',') as notes from x""")
def draft_annotations(spark, d):
    x = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = x.groupBy("source").agg(F.least(F.lit(1.0), 0.25 * F.count("*")).alias("conf"), F.count("*").alias("n"), F.bool_and(F.coalesce("quality", F.lit(1)) == 0).alias("low"))
    return g.select("source", F.array_join(quality.annotations(F.col("conf"), F.col("n"), F.col("low")), ",").alias("notes"))


@add("publish_gate", f"with {WIKI} select path, coalesce(confidence, 1.0) >= 0.6 as publishable from p where kind = 'draft'")
def publish_gate(spark, d):
    return pages(spark, d).filter("kind = 'draft'").select("path", quality.publishable(F.col("confidence"), 0.6).alias("publishable"))


@add("rejections", "with r as (select user_id as concept, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'error') select concept, count(*) as n, count(*) >= 5 as blocked, array_to_string(list(cast(event_id as varchar) order by k) filter (k <= 3), ',') as feedback from r group by 1")
def rejections(spark, d):
    """Rejections of a concept: five block it, the last three are shown."""
    e = metric_events(spark, d).filter("tool = 'error'").select(F.col("vault_id").alias("concept"), F.col("ts").alias("at"), F.col("id").alias("feedback"))
    return quality.blocked(e)


@add("compile_queue", "select p_partkey as entity_id from part where p_size < 20 and p_partkey not in (select l_partkey from lineitem where l_quantity > 49) union select p_partkey from part where p_partkey not in (select l_partkey from lineitem)")
def compile_queue(spark, d):
    """Pending concepts that nothing blocks, and stubs without a source."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    blocked = li.filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    pending = p.filter("p_size < 20").select("p_partkey").join(blocked, "p_partkey", "left_anti")
    bare = p.select("p_partkey").join(li.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return pending.union(bare).distinct().select(F.col("p_partkey").alias("entity_id"))


@add("split_suggestions", """with s as (select p_name as concept, p_partkey as source, list_distinct(list_filter(string_split(lower(p_type || ' ' || p_brand || ' ' || p_name), ' '), lambda w: length(w) > 3 and not list_contains(string_split(p_name, ' '), w))) as w from part),
x as (select concept, count(*) over (partition by concept) as n, source, w from s where len(w) > 0), pr as (select a.concept, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as j from x a join x b on a.concept = b.concept and a.source < b.source where a.n >= 3)
select concept, round(min(j), 2) as least, round(avg(j), 2) as mean from pr group by 1 having min(j) < 0.05 and avg(j) > 0.1""")
def split_suggestions(spark, d):
    p = table(spark, d, "part")
    words = F.filter(F.split(F.lower(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" "), "p_name")), " "), lambda w: (F.length(w) > 3) & ~F.array_contains(F.split("p_name", " "), w))
    return quality.split_suggestions(p.select(F.col("p_name").alias("concept"), F.col("p_partkey").alias("source"), words.alias("words")))


@add("query_scores", """with x as (select o_orderkey as id, [lower(o_orderpriority), 'b'] as e, [lower(o_orderstatus), 'b', lower(o_orderpriority)][1:1 + cast(o_orderkey % 3 as int)] as a, ['urgent', 'low'] as f, o_orderpriority as answer from orders),
s as (select id, case when len(list_intersect(e, a)) = 0 then 0.0 else 2.0 * len(list_intersect(e, a)) / (len(e) + len(a)) end as f1, len(list_filter(f, lambda q: contains(lower(answer), q))) / len(f) as held from x) select id, round((f1 + held) / 2, 6) as score from s""")
def query_scores(spark, d):
    o = table(spark, d, "orders")
    pages_ = F.slice(F.array("o_orderstatus", F.lit("B"), "o_orderpriority"), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))
    s = quality.query_score(F.array("o_orderpriority", F.lit("b")), pages_, F.array(F.lit("URGENT"), F.lit("low")), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), F.round(s, 6).alias("score"))


VERDICT = """with x as (select s_suppkey as id, s_acctbal / 20000 as w, s_acctbal / 40000 as m, case when s_suppkey % 3 = 0 then null else (s_suppkey % 11 - 2) / 30.0 end as l, (s_suppkey % 7 - 1) / 25.0 as o, s_suppkey % 4 as q, s_suppkey % 2 = 0 as mv from supplier)
select id, case when w < -0.1 or m <= -0.05 or coalesce(l < -0.05, false) or o < -0.05 then 'keep_current' when q = 0 then 'manual_review' when m > 0.1 then 'switch' when mv and (m > 0 or coalesce(l > 0, false) or o > 0) then 'switch' else 'manual_review' end as verdict from x"""


@add("verdicts", VERDICT)
def verdicts(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    bal = F.col("s_acctbal")
    v = quality.verdict(bal / 20000, bal / 40000, F.when(k % 3 != 0, (k % 11 - 2) / 30.0), (k % 7 - 1) / 25.0, F.lit(None).cast("double"), k % 4, k % 2 == 0, F.lit(False))
    return s.select(k.alias("id"), v.alias("verdict"))


@add("output_budgets", "with x as (select doc_id, 8192 - greatest(1, coalesce(length(text), 0) // 4) - 256 as free from documents) select doc_id, cast(case when free >= 512 then greatest(512, least(4096, free)) end as bigint) as tokens from x")
def output_budgets(spark, d):
    return docs(spark, d).select("doc_id", quality.output_budget(F.coalesce(F.length("text"), F.lit(0)), 8192, 4096).cast("long").alias("tokens"))


@add("link_coverage", f"with {WIKI} select count(*) as links, count(*) filter (lower(target) in (select key from ix)) as resolved, round(count(*) filter (lower(target) in (select key from ix)) / count(*), 6) as rate from l")
def link_coverage(spark, d):
    p = pages(spark, d)
    j = wiki.links(p).select(F.lower("target").alias("key")).join(wiki.title_index(p).select("key", F.lit(1).alias("hit")), "key", "left")
    return j.agg(F.count("*").alias("links"), F.count("hit").alias("resolved"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


@add("usage_cost", """with p(tool, price) as (values ('click', 2.5), ('view', 0.5), ('purchase', 10.0), ('error', 0.0)), t as (select user_id, event_type, sum(value) as units from events where value > 200 group by all)
select user_id as vault_id, case when bool_and(price is not null) then round(sum(units * price / 1000000), 6) end as cost from t left join p on tool = event_type group by 1""")
def usage_cost(spark, d):
    """Cost of each vault's slow calls; unknown where the price of one of its tools is."""
    prices = spark.createDataFrame([("click", 2.5), ("view", 0.5), ("purchase", 10.0), ("error", 0.0)], "tool string, price double")
    t = metric_events(spark, d).filter("latency_ms > 200").groupBy("vault_id", "tool").agg(F.sum("latency_ms").alias("units"))
    j = t.join(prices, "tool", "left").groupBy("vault_id").agg(F.bool_and(F.col("price").isNotNull()).alias("known"), F.sum(F.col("units") * F.col("price") / 1000000).alias("cost"))
    return j.select("vault_id", F.when(F.col("known"), F.round("cost", 6)).alias("cost"))


@add("since", "select event_type as tool, count(*) as calls from events where ts >= (select cast(max(ts) as date) from events) - interval 3 day group by 1")
def since(spark, d):
    """Calls since three days before the last one's day."""
    e = metric_events(spark, d)
    start = e.agg(F.date_sub(F.to_date(F.max("ts")), 3)).first()[0]  # one value
    return e.filter(F.col("ts") >= F.lit(start).cast("timestamp")).groupBy("tool").agg(F.count("*").alias("calls"))


@add("audit_rows", """select event_id as id, '{"tool":"' || event_type || '","label_hash":"' || left(sha256(json_extract_string(props, '$.k')), 8) || '","ms":' || cast(cast(floor(value) as bigint) as varchar) || '}' as metadata from events""")
def audit_rows(spark, d):
    e = metric_events(spark, d)
    return e.select("id", F.to_json(F.struct("tool", text.short_hash(F.col("label")).alias("label_hash"), F.floor("latency_ms").alias("ms"))).alias("metadata"))


@add("vault_statistics", "select count(*) as notes, count(distinct lang) as languages, count(distinct source) as sources, count(distinct sha256(text)) as texts, cast(sum(length(text)) as bigint) as chars, cast((select count(*) from labels where quality = 1) as bigint) as high_quality from documents")
def vault_statistics(spark, d):
    x = docs(spark, d).select("lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.length("text").alias("n"), F.lit(0).alias("q"))
    q = table(spark, d, "labels").filter("quality = 1").select(*[F.lit(None).cast(t).alias(c) for c, t in x.dtypes[:-1]], F.lit(1).alias("q"))
    return x.unionByName(q).agg(F.count_if(F.col("q") == 0).alias("notes"), F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("sources"), F.countDistinct("h").alias("texts"), F.sum("n").alias("chars"), F.sum("q").alias("high_quality"))


@add("lineage", "select o_custkey as article, count(*) as runs, array_to_string(list(cast(o_orderkey as varchar) order by o_orderdate desc, o_orderkey desc)[1:10], ',') as lineage from orders group by 1")
def lineage(spark, d):
    """The last ten runs of an article, newest first."""
    o = table(spark, d, "orders")
    runs = F.reverse(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))))
    g = o.groupBy(F.col("o_custkey").alias("article")).agg(F.count("*").alias("runs"), runs.alias("r"))
    return g.select("article", "runs", F.array_join(F.transform(F.slice("r", 1, 10), lambda s: s["o_orderkey"].cast("string")), ",").alias("lineage"))


@add("languages", "select lang, count(*) as notes, min(source) as first_source from documents where lang is not null group by 1")
def languages(spark, d):
    return docs(spark, d).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("notes"), F.min("source").alias("first_source"))


@add("first_approval", "select l_partkey as article, min(l_shipdate) filter (l_linestatus = 'F') as approved_at, max(l_shipdate) as updated_at from lineitem group by 1")
def first_approval(spark, d):
    """The first approval of an article stays, later ones only update it."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("article")).agg(F.min(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("approved_at"), F.max("l_shipdate").alias("updated_at"))


@add("single_source", "select p_name as concept, case when count(*) = count(case when p_size > 5 then p_brand end) then count(distinct p_brand) = 1 else count(distinct p_type) = 1 end as single from part group by 1")
def single_source(spark, d):
    p = table(spark, d, "part")
    return entities.single_source(p.select(F.col("p_name").alias("concept"), F.col("p_type").alias("path"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("uri")))


QUERIES = Q
