"""What is left to do, and names offered, over documents and parts by rules that the query and its SQL both state."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import upkeep, wiki
from folioforge.queries.knowledge import NOTES, docs, key_sql, notes
from folioforge.queries.wiki import WIKI, pages
from folioforge.sources import table

Q = {}


def add(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def name():
    return F.col("doc_id").cast("string")


def body_of():
    return F.coalesce("text", F.lit(""))


@add("notes_to_read", f"select path, content_hash from {NOTES} where not (content_hash is not null and path is not null and doc_id % 5 <> 0 and doc_id % 4 in (0, 1) and doc_id % 3 <> 0)")
def notes_to_read(spark, d):
    """All but the notes whose record has their hash, a state of read notes and today's prompt version."""
    n = F.col("doc_id")
    state = F.when(n % 4 == 0, "ingested").when(n % 4 == 1, "compiled").when(n % 4 == 2, "failed")
    records = notes(spark, d).select("path", F.when(n % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), state.alias("status"), F.when(n % 3 == 0, "v1").otherwise("v2").alias("prompt_version"))
    return upkeep.to_read(notes(spark, d).select("path", "content_hash"), records, "v2")


@add("seeded_notes", f"select path, source || ',' || lang as concepts from {NOTES} where content_hash is not null and path is not null and doc_id % 3 <> 0")
def seeded_notes(spark, d):
    n = notes(spark, d)
    seeds = n.select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.concat("source", F.lit(","), "lang").alias("concepts"))
    return upkeep.seeded(n, seeds)


TOPIC = "x as (select 'raw/' || doc_id || '.md' as path, ['high', 'medium', 'low'][doc_id % 3 + 1] as quality, unnest(['Zebra quartz', 'Unknown file', string_split(coalesce(text, ''), ' ')[1]]) as topic, coalesce(text, '') as body from documents)"
STATS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '!\[\[[^\]]*\]\]', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), 'https?://\S+', ' ', 'g'), '`[^`]*`', ' ', 'g'), '[#>*_\-\[\]()]', ' ', 'g')"


@add("fallback_topics", f"""with {TOPIC}, y as (select *, trim(regexp_replace({STATS}, '\\s+', ' ', 'g')) as plain, {key_sql('topic')} as key, {key_sql("path || ' ' || body")} as hay from x)
 select path, topic from y where (length(plain) >= 80 or len(regexp_extract_all(plain, '[\\p{{L}}\\p{{N}}_]{{2,}}')) >= 12) and key <> '' and key <> 'untitled' and key not like 'unknown %' and (quality = 'high' or contains(hay, key))""")
def fallback_topics(spark, d):
    quality = F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("doc_id") % 3 + 1).cast("int"))
    topics = F.array(F.lit("Zebra quartz"), F.lit("Unknown file"), F.split(body_of(), " ")[0])
    return upkeep.suggested_topics(docs(spark, d).select(F.concat(F.lit("raw/"), name(), F.lit(".md")).alias("path"), quality.alias("quality"), topics.alias("topics"), body_of().alias("body")))


@add("merge_candidates", """with k as (select p_partkey as id, case when p_partkey % 7 <> 0 then lower(p_name) else '' end as key from part), c as (select p_partkey as x, (p_partkey * 31) % 900 + 1 as y from part), q as (select c.x, c.y, coalesce(a.key, '') as kx, coalesce(b.key, '') as ky from c left join k a on a.id = x left join k b on b.id = y where x <> y)
 select distinct case when ky < kx or (ky = kx and y < x) then y else x end as entity_a, case when ky < kx or (ky = kx and y < x) then x else y end as entity_b, 's' as surface from q""")
def merge_candidates(spark, d):
    """Each pair is met in both directions, and gives one row."""
    p = table(spark, d, "part")
    pairs = p.select(F.col("p_partkey").cast("long").alias("entity_x"), ((F.col("p_partkey") * 31) % 900 + 1).cast("long").alias("entity_y"), F.lit("s").alias("surface"))
    pairs = pairs.unionByName(pairs.select(F.col("entity_y").alias("entity_x"), F.col("entity_x").alias("entity_y"), "surface"))
    preferred = p.filter("p_partkey % 7 != 0").select(F.col("p_partkey").cast("long").alias("entity_id"), F.lower("p_name").alias("label_key"))
    return upkeep.merge_candidates(pairs, preferred)


@add("related_names", """with n as (select lower(x) as key, max(x) as other from (select p_name as x from part union select p_brand from part union select split_part(p_type, ' ', 1) from part) group by 1),
 a as (select p_name as name, lower(p_brand) as alias from part union select p_name, lower(p_type) from part),
 m as (select name, coalesce(case when e.other <> name then e.other end, case when contains(alias, ' ') and f.other <> name then f.other end) as other from a left join n e on e.key = alias left join n f on f.key = split_part(alias, ' ', 1))
 select name, other as related from m where other is not null union select other, name from m where other is not null""")
def related_names(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.explode(F.array("p_name", "p_brand", F.split("p_type", " ")[0])).alias("name")).distinct()
    aliases = p.select(F.col("p_name").alias("name"), F.explode(F.array(F.lower("p_brand"), F.col("p_type"))).alias("alias"))
    return upkeep.related_names(names, aliases)


@add("export_aliases", f"""with a as (select p_name as name, unnest([p_type, p_name || ' of the kind', p_name || ' 1', split_part(p_name, ' ', 1) || '/x']) as alias from part), k as (select *, {key_sql('alias')} as key from a)
 select distinct name, alias from k where not contains(alias, '/') and len(string_split(alias, ' ')) <= 4 and key in (select key from k group by 1 having count(distinct name) = 1)""")
def export_aliases(spark, d):
    p = table(spark, d, "part")
    made = F.array(F.col("p_type"), F.concat("p_name", F.lit(" of the kind")), F.concat("p_name", F.lit(" 1")), F.concat(F.split("p_name", " ")[0], F.lit("/x")))
    return upkeep.export_aliases(p.select(F.col("p_name").alias("name"), F.explode(made).alias("alias")))


@add("failure_reasons", """select doc_id, case doc_id % 7 when 0 then 'truncated' when 1 then 'missing_sources' when 2 then 'llm_output' end as reason,
 case doc_id % 7 when 0 then 'cut ' || doc_id when 1 then '{"reason":"no_sources","message":""}' when 2 then '{"reason":"bad_request"}' when 3 then 'odd' when 4 then 'no object ' || doc_id when 5 then '["truncated"]' else '{"reason":5}' end as message from documents""")
def failure_reasons(spark, d):
    """Payloads: with a message, with an empty one, without one, of an unknown reason, no JSON, no object, a reason that is a number."""
    made = [F.concat(F.lit('{"message":"cut '), name(), F.lit('","reason":"truncated"}')), F.lit('{"reason":"no_sources","message":""}'), F.lit('{"reason":"bad_request"}'), F.lit('{"reason":"strange","message":"odd"}'), F.concat(F.lit("no object "), name()), F.lit('["truncated"]'), F.lit('{"reason":5}')]
    payload = F.element_at(F.array(*made), (F.col("doc_id") % 7 + 1).cast("int"))
    reason, message = upkeep.failure_reason(payload)
    return docs(spark, d).select("doc_id", reason.alias("reason"), message.alias("message"))


@add("equations", r"""with p as (select doc_id, '$$a' || chr(10) || 'b$$ \(x\) \[y\] \frac{1}{2} \fraction ' || repeat('\sum ', doc_id % 3) || coalesce(text, '') as t from documents),
 n as (select doc_id, len(regexp_extract_all(t, '(?s)\$\$.+?\$\$')) + len(regexp_extract_all(t, '(?s)\\\[.+?\\\]')) + len(regexp_extract_all(t, '(?s)\\\(.+?\\\)')) + len(regexp_extract_all(t, '\\(frac|sum|int|prod|sqrt|begin)([^a-zA-Z0-9_]|$)')) as n from p)
 select doc_id, array_to_string(list_transform(range(0, n), lambda k: 'eq-' || doc_id || '-' || k), ',') as refs from n""")
def equations(spark, d):
    body = F.concat(F.lit("$$a\nb$$ \\(x\\) \\[y\\] \\frac{1}{2} \\fraction "), F.expr("repeat('\\\\sum ', int(doc_id % 3))"), body_of())
    return docs(spark, d).select("doc_id", F.array_join(text.equations(body, F.col("doc_id")), ",").alias("refs"))


@add("title_aliases", "select doc_id, array_to_string(list_sort([chr((65 + doc_id % 26)::int) || 'X', 'ZZ', 'c++ ' || doc_id]), ',') as aliases from documents")
def title_aliases(spark, d):
    """Titles hold characters that mean something in a pattern; abbreviations in small letters or of one letter don't count."""
    title = F.concat(F.lit("C++ "), name())
    short = F.concat(F.chr(F.lit(65) + F.col("doc_id") % 26), F.lit("X"))
    body = F.concat(F.lit("On "), title, F.lit(" ("), short, F.lit("), "), title, F.lit("(ZZ) and "), title, F.lit(" (a) or "), title, F.lit(" (B). "), title, F.lit(" (ZZ)"), body_of())
    return docs(spark, d).select("doc_id", F.array_join(text.title_aliases(title, body), ",").alias("aliases"))


@add("without_annotations", "select doc_id, sha256('# A' || chr(10) || 'b<!-- other: stays -->' || chr(10) || coalesce(text, '')) as body_hash from documents")
def without_annotations(spark, d):
    body = F.concat(F.lit("<!-- auto: low\nconfidence -->\n# A\n<!--old-auto: x -->b<!-- other: stays -->\n"), body_of())
    return docs(spark, d).select("doc_id", F.sha2(text.without_annotations(body, ("auto", "old-auto")).cast("binary"), 256).alias("body_hash"))


@add("line_feeds", r"select doc_id, case when doc_id % 2 = 0 then 'a' || chr(10) || 'b' || chr(10) || 'c' else 'a\nb' end as text from documents")
def line_feeds(spark, d):
    return docs(spark, d).select("doc_id", text.with_line_feeds(F.when(F.col("doc_id") % 2 == 0, "a\\nb\\nc").otherwise("a\\nb")).alias("text"))


@add("disconnected_drafts", f"with {WIKI}, w as (select path, lower(title) as own from p where doc_id % 3 <> 0) select path from w where (select count(distinct own) from w) >= 2 and path not in (select l.path from l join w on w.path = l.path where lower(l.target) <> w.own and lower(l.target) in (select own from w))")
def disconnected_drafts(spark, d):
    """Drafts are here two pages of three, so that some have links."""
    n = F.regexp_extract("title", "[0-9]+", 0).cast("long")
    return wiki.disconnected_drafts(pages(spark, d).withColumn("kind", F.when(n % 3 != 0, "draft").otherwise("concept")))


QUERIES = Q
