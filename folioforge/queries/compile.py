"""Notes on their way to articles: names, headings, merges of partial results, caches, edits and passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import identity, ranges, segments
from folioforge.queries.knowledge import fold_sql, key_sql
from folioforge.sources import metric_events, table

QUERIES = {}


def add(name, sql):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


TAG_SQL = "regexp_replace(regexp_replace(replace(lower(trim(p_brand || ' / ' || p_type)), ' ', '-'), '[^\\p{L}\\p{N}_/-]', '', 'g'), '^[^\\p{L}\\p{N}]+', '')"


@add("note_names", f"""select p_partkey, {TAG_SQL} as tag, case when p_size % 2 = 0 then p_name else p_name || ' (' || lower(left(p_type, 3)) || ')' end as base_name,
 case when p_retailprice / 2500 < 0.4 then 'low' when p_retailprice / 2500 < 0.7 then 'medium' else 'high' end as confidence from part""")
def note_names(spark, d):
    """Tags, base names (upper-case abbreviations go, others stay) and confidence levels."""
    p = table(spark, d, "part")
    short = F.left("p_type", F.lit(3))
    name = F.concat("p_name", F.lit(" ("), F.when(F.col("p_size") % 2 == 0, F.upper(short)).otherwise(F.lower(short)), F.lit(")"))
    return p.select("p_partkey", text.tag(F.concat("p_brand", F.lit(" / "), "p_type")).alias("tag"), text.base_name(name).alias("base_name"), text.confidence_level(F.col("p_retailprice") / 2500).alias("confidence"))


@add("heading_slugs", """with h as (select doc_id, source || ' of ' || left(regexp_replace(text, '[\\n*#]', ' ', 'g'), 30) as h from documents)
select doc_id, nullif(left(regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '') as slug from h""")
def heading_slugs(spark, d):
    """Slugs of the headings; every other document has a bold line for one."""
    x = table(spark, d, "documents")
    title = F.concat("source", F.lit(" of "), F.left(F.regexp_replace("text", "[\\n*#]", " "), F.lit(30)))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n## "), title)).otherwise(F.concat(F.lit("**"), title, F.lit("**")))
    return x.select("doc_id", text.heading_slug(text.heading(F.concat(body, F.lit("\n"), "text"))).alias("slug"))


@add("clip_cleanup", """with l as (select doc_id, string_split(text, chr(10)) as l from documents),
h as (select doc_id, l, list_transform(l[1:30], lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) as h from l),
f as (select doc_id, l, list_filter(h, lambda x: not (len(regexp_extract_all(x, '\\S+')) between 1 and 5 and not regexp_matches(trim(x), '^[#*>\\[!-]'))) as f from h)
select doc_id, sha256(array_to_string(list_concat(f, l[31:]), chr(10))) as text_sha256 from f""")
def clip_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.without_clip_header(F.col("text")).cast("binary"), 256).alias("text_sha256"))


@add("segment_identity", "select doc_id || ':' || i || ':' || left(sha256(substr(text, cast(i * 2000 + 1 as bigint), 2000)), 8) as segment_id, doc_id || ':' || i as identity from (select *, unnest(range(0, length(text) // 2000 + 1)) as i from documents) where i * 2000 < length(text)")
def segment_identity(spark, d):
    s = segments.fixed_slices(table(spark, d, "documents"), 2000)
    place = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"))
    return s.select(F.concat_ws(":", place, text.short_hash(F.col("text"))).alias("segment_id"), place.alias("identity"))


@add("manual_edits", "with s as (select doc_id, sha256(text) as body, case when lang = 'de' then '' when doc_id % 7 = 0 then sha256(text || ' ') else sha256(text) end as stored from documents) select doc_id, stored <> '' and stored <> body as edited from s")
def manual_edits(spark, d):
    """Published bodies that differ from their stored hash; without a stored hash there is no edit."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    body = sha(F.col("text"))
    stored = F.when(F.col("lang") == "de", "").when(F.col("doc_id") % 7 == 0, sha(F.concat("text", F.lit(" ")))).otherwise(body)
    return table(spark, d, "documents").select("doc_id", ((stored != "") & (stored != body)).alias("edited"))


@add("response_cache", "with c as (select event_type as tool, sha256(event_type || '/' || user_id || '/' || json_extract_string(props, '$.k')) as key from events) select tool, count(distinct key) as entries, count(*) - count(distinct key) as hits, round((count(*) - count(distinct key)) / count(*), 6) as hit_rate from c group by 1")
def response_cache(spark, d):
    """First calls of a key make an entry, later ones hit it."""
    e = metric_events(spark, d)
    key = F.sha2(F.concat_ws("/", "tool", F.col("vault_id").cast("string"), "label").cast("binary"), 256)
    n = e.groupBy("tool", key.alias("key")).agg(F.count("*").alias("n"))
    hits = F.sum("n") - F.count("*")
    return n.groupBy("tool").agg(F.count("*").alias("entries"), hits.alias("hits"), F.round(hits / F.sum("n"), 6).alias("hit_rate"))


QUESTION_SQL = "trim(regexp_replace(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[?]$', ''))"


@add("first_answers", f"with q as (select left(sha256({QUESTION_SQL}), 16) as question_hash, conv_id, turn from conversations where role = 'user') select question_hash, conv_id, turn, cast(n as bigint) as asked from (select *, count(*) over (partition by question_hash) as n, row_number() over (partition by question_hash order by conv_id, turn) as k from q) where k = 1")
def first_answers(spark, d):
    """Each question once, as first asked."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    q = c.groupBy(text.short_hash(text.question_key(F.col("text")), 16).alias("question_hash")).agg(F.min(F.struct("conv_id", "turn")).alias("at"), F.count("*").alias("asked"))
    return q.select("question_hash", "at.conv_id", "at.turn", "asked")


def _ordered(spark, d, label, most=None):
    """order, labels: the distinct labels of its parts in line order, ties by label, any case; the first casing stays."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), label.alias("label"))
    x = li.join(p, "l_partkey").groupBy("l_orderkey", F.lower("label").alias("key")).agg(F.min(F.struct("l_linenumber", "label")).alias("f"))
    got = F.transform(F.array_sort(F.collect_list("f")), lambda f: f["label"])
    return x.groupBy("l_orderkey").agg(F.array_join(F.slice(got, 1, most) if most else got, "|").alias("labels"))


ORDERED_SQL = """with x as (select l_orderkey, min({{'n': l_linenumber, 'label': {0}}}) as f from lineitem join part on p_partkey = l_partkey group by l_orderkey, lower({0})),
r as (select *, row_number() over (partition by l_orderkey order by f) as k from x) select l_orderkey, string_agg(f.label, '|' order by k) as labels from r where k <= {1} group by 1"""


@add("merged_concepts", ORDERED_SQL.format("(case when p_size % 2 = 0 then upper(p_name) else p_name end)", 1000))
def merged_concepts(spark, d):
    return _ordered(spark, d, F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))


@add("suggested_topics", ORDERED_SQL.format("p_type", 5))
def suggested_topics(spark, d):
    """Five topics of each source at most, in order."""
    return _ordered(spark, d, F.col("p_type"), 5)


NAMES_SQL = "(select p_name as label, min(p_partkey) as entity_id from part group by 1)"


@add("fold_collisions", f"""with e as (select entity_id, label from {NAMES_SQL} union all select entity_id + 1000000, label || 's' from {NAMES_SQL}), l as (select entity_id, {key_sql('label')} as label_key, {fold_sql('label')} as match_key from e)
select a.entity_id as entity_a, b.entity_id as entity_b, a.match_key from l a join l b on a.match_key = b.match_key and a.entity_id < b.entity_id and a.label_key <> b.label_key""")
def fold_collisions(spark, d):
    """Singular and plural labels of different entities."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("entity_id"))
    plural = p.select(F.concat("label", F.lit("s")).alias("label"), (F.col("entity_id") + 1000000).alias("entity_id"))
    return identity.fold_collisions(identity.keyed(p.unionByName(plural).withColumn("role", F.lit("preferred"))))


@add("orphan_segments", "select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id where l.doc_id is null")
def orphan_segments(spark, d):
    """Rows whose partner is missing: documents without a label."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@add("section_of_page", "select doc_id as page, n_name as section from documents join nation on doc_id between n_nationkey * 37 and n_nationkey * 37 + 30")
def section_of_page(spark, d):
    """Pages in the ranges of a table of contents."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("section"), (F.col("n_nationkey") * 37).cast("long").alias("first"), (F.col("n_nationkey") * 37 + 30).cast("long").alias("last"))
    return ranges.range_join(table(spark, d, "documents").select(F.col("doc_id").alias("page")), n, "page", 32).select("page", "section")


@add("run_differences", """with a as (select l_partkey as id, count(*) as n from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as id, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.n <> b.n then 'changed' else 'same' end as status from a full join b on a.id = b.id""")
def run_differences(spark, d):
    """Two runs compared by id: one shuffle of counts in place of a full outer join of both."""
    li = table(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')")
    n = li.groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return n.select("id", F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("status"))


@add("harmonic_means", "select p_brand, round(case when count(x) = 0 then null when min(x) <= 0 then 0 else count(x) / sum(case when x > 0 then 1.0::double / x end) end, 6) as score from (select p_brand, case when p_size % 5 = 0 then null else (p_size - case when p_brand like '%1' then 1 else 0 end)::double end as x from part) group by 1")
def harmonic_means(spark, d):
    """Over what is known; 0 where any value is 0 or less."""
    x = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") - F.when(F.col("p_brand").endswith("1"), 1).otherwise(0)).cast("double"))
    p = table(spark, d, "part").select("p_brand", x.alias("x"))
    score = F.when(F.min("x") <= 0, F.lit(0.0)).otherwise(F.count("x") / F.sum(F.when(F.col("x") > 0, 1 / F.col("x"))))
    return p.groupBy("p_brand").agg(F.round(score, 6).alias("score"))


@add("concept_passages", "select l_partkey, l_orderkey, l_linenumber, cast(k as int) as rank from (select *, row_number() over (partition by l_partkey order by l_discount desc, l_linenumber, l_orderkey) as k from lineitem) where k <= 20")
def concept_passages(spark, d):
    """The 20 passages of each concept with the most confidence, then in order."""
    k = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_discount"), "l_linenumber", "l_orderkey"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount")
    return li.withColumn("rank", k).filter("rank <= 20").drop("l_discount")


@add("first_ordinals", "with f as (select source, sha256(text) as h, min(doc_id) as first from documents group by 1, 2) select source, first, cast(row_number() over (partition by source order by first) - 1 as int) as ordinal from f")
def first_ordinals(spark, d):
    """Distinct notes of a source, numbered as they first came."""
    f = table(spark, d, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("first"))
    return f.select("source", "first", (F.row_number().over(Window.partitionBy("source").orderBy("first")) - 1).alias("ordinal"))


@add("note_page", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20 offset 40")
def note_page(spark, d):
    """The third page of 20 notes, longest first."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)
