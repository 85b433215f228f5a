"""Changes to entities, routes of surfaces, names and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import entities, graph, identity
from folioforge.queries.knowledge import LABELS, SURFACES, docs, fold_sql, key_sql, labels, surfaces
from folioforge.sources import notes, table

Q = {}


def add(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def sourced(spark, d):
    """labels with an origin: two-word aliases are the user's, the others extracted."""
    two = F.col("label").contains(" ")
    return labels(spark, d).withColumn("origin", F.when(F.col("role") == "preferred", "preferred").when(two, "user").otherwise("extracted"))


def named(spark, d):
    s = surfaces(spark, d)
    return s.select("surface", text.concept_key(F.col("surface")).alias("label_key"), text.match_key(F.col("surface")).alias("match_key"))


def linked(spark, d):
    """source, entity_id: orders and the entity of each part's name."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    e = p.groupBy(F.col("p_name").alias("n")).agg(F.min("p_partkey").alias("entity_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("p_partkey"))
    return li.join(p, "p_partkey").join(e, F.col("p_name") == F.col("n")).select("source", "entity_id").distinct()


ALL = f"""l as (select *, case when role = 'preferred' then 'preferred' when label like '% %' then 'user' else 'extracted' end as origin from {LABELS}),
s as (select surface, {key_sql('surface')} as label_key, {fold_sql('surface')} as match_key from {SURFACES}),
e as (select distinct l_orderkey as source, entity_id from lineitem join part on l_partkey = p_partkey join (select p_name as n, min(p_partkey) as entity_id from part group by 1) on n = p_name),
pn as (select p_name as n, min(p_partkey) as id from part group by 1), mv as (select a.id as loser, b.id as winner from pn a join pn b on replace(a.n, 'red ', 'blue ') = b.n and a.n <> b.n)"""


@add("fold_entities", f"with {ALL} select match_key, count(distinct entity_id) as entities, min(entity_id) as entity_id from l where role = 'preferred' group by 1")
def fold_entities(spark, d):
    return labels(spark, d).filter("role = 'preferred'").groupBy("match_key").agg(F.countDistinct("entity_id").alias("entities"), F.min("entity_id").alias("entity_id"))


@add("alias_entities", f"with {ALL} select label_key, entity_id, origin = 'user' as blessed from l where role = 'alias' group by all")
def alias_entities(spark, d):
    x = sourced(spark, d)
    return entities.alias_entities(x, True).withColumn("blessed", F.lit(True)).unionByName(entities.alias_entities(x, False).withColumn("blessed", F.lit(False)))


@add("classified_surfaces", f"""with {ALL}, ex as (select label_key as k, count(distinct entity_id) as n, min(entity_id) as x from l where role = 'preferred' group by 1), fo as (select match_key as k, count(distinct entity_id) as n, min(entity_id) as x from l where role = 'preferred' group by 1),
bl as (select label_key as k, count(distinct entity_id) as n, min(entity_id) as x from l where origin = 'user' group by 1), we as (select label_key as k, count(distinct entity_id) as n, min(entity_id) as x from l where origin = 'extracted' group by 1),
r as (select surface, match_key, case when ex.n = 1 or (ex.n is null and fo.n = 1) then 'preferred' when bl.n = 1 then 'blessed' when ex.n > 1 or fo.n > 1 or bl.n > 1 or we.n > 1 then 'ambiguous' when we.n = 1 then 'weak' else 'new' end as route, ex.n as exn, ex.x as exx, fo.x as fox, bl.x as blx, we.x as wex
 from s left join ex on ex.k = label_key left join fo on fo.k = match_key left join bl on bl.k = label_key left join we on we.k = label_key)
select surface, route, case route when 'preferred' then case when exn = 1 then exx else fox end when 'blessed' then blx when 'weak' then wex end as entity_id, case when route = 'new' then match_key end as new_key from r""")
def classified_surfaces(spark, d):
    return entities.classify(named(spark, d), sourced(spark, d))


def candidates(spark, d):
    """source, surface, entity_id: a last word of a part's name in an order, and every entity that has it as an alias."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(F.split("p_name", " "), -1).alias("surface"))
    li = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("source"), "l_partkey").join(p, "l_partkey").select("source", "surface").distinct()
    a = labels(spark, d).filter("role = 'alias'").select("label_key", "entity_id").distinct()
    return li.join(a, text.concept_key(F.col("surface")) == F.col("label_key")).select("source", "surface", "entity_id")


CANDIDATES = f"c as (select distinct l_orderkey as source, list_extract(string_split(p_name, ' '), -1) as surface from lineitem join part on l_partkey = p_partkey where l_linenumber = 1), f as (select distinct source, surface, entity_id from c join l on role = 'alias' and label_key = {key_sql('surface')})"


@add("sticky_resolution", f"with {ALL}, {CANDIDATES} select source, surface, min(entity_id) as entity_id from f semi join e using (source, entity_id) group by 1, 2 having count(distinct entity_id) = 1")
def sticky_resolution(spark, d):
    return entities.sticky(candidates(spark, d), linked(spark, d))


@add("occurrences", f"with {ALL}, {CANDIDATES} select source, surface, case when count(distinct entity_id) > 1 then 'ambiguous' else 'resolved' end as status, array_to_string(list_sort(list(distinct entity_id)), ',') as candidates from f group by 1, 2")
def occurrences(spark, d):
    return entities.occurrences(candidates(spark, d))


@add("alias_collisions", f"with {ALL} select distinct a.entity_id, a.label_key from l a where a.role = 'alias' and exists (select 1 from l b where b.role = 'preferred' and b.label_key = a.label_key and b.entity_id <> a.entity_id)")
def alias_collisions(spark, d):
    return entities.collides(labels(spark, d))


@add("alias_upsert", f"""with {ALL}, o as (select entity_id, label_key, label, origin from l where role = 'alias'), n as (select entity_id, label_key, label, 'rename' as origin from l where origin = 'extracted' and entity_id % 2 = 0),
b as (select entity_id, label_key, bool_or(origin in ('user', 'rename')) as blessed, max(case when origin = 'rename' then 1 else 0 end) as r from (select * from o union all select * from n) group by 1, 2)
select entity_id, label_key, case when blessed and r = 1 then 'rename' when blessed then 'user' else 'extracted' end as origin from b where not (entity_id % 5 = 0 and label_key not like '% %')""")
def alias_upsert(spark, d):
    """A better origin replaces a weak one in place; aliases denied to an entity stay away."""
    x = sourced(spark, d).filter("role = 'alias'")
    new = x.filter("origin = 'extracted' and entity_id % 2 = 0").withColumn("origin", F.lit("rename"))
    denied = x.filter("entity_id % 5 = 0 and label not like '% %'").select("entity_id", "label_key").distinct()
    return entities.upsert_aliases(x, new, denied).select("entity_id", "label_key", "origin")


def moves(spark, d):
    """Red things become the blue ones of the same kind."""
    n = table(spark, d, "part").groupBy(F.col("p_name").alias("n")).agg(F.min("p_partkey").alias("id"))
    w = n.select(F.col("n").alias("w"), F.col("id").alias("winner"))
    return n.withColumn("to", F.replace("n", F.lit("red "), F.lit("blue "))).filter("to != n").join(w, F.col("to") == F.col("w")).select(F.col("id").alias("loser"), "winner")


@add("merged_labels", f"""with {ALL}, m as (select coalesce(winner, entity_id) as entity_id, label_key, case when winner is not null then 'alias' else role end as role, case when winner is not null then 'rename' else origin end as origin from l left join mv on loser = entity_id),
o as (select *, case when role = 'preferred' then 2 when origin in ('user', 'rename') then 1 else 0 end as o from m) select entity_id, label_key, first(role order by o desc, role) as role from o group by 1, 2""")
def merged_labels(spark, d):
    return entities.merged(sourced(spark, d), linked(spark, d), moves(spark, d))[0].select("entity_id", "label_key", "role")


@add("merged_edges", f"with {ALL} select distinct source, coalesce(winner, entity_id) as entity_id from e left join mv on loser = entity_id")
def merged_edges(spark, d):
    return entities.merged(sourced(spark, d), linked(spark, d), moves(spark, d))[1]


@add("split_edges", f"with {ALL} select source, case when entity_id in (select loser from mv) then entity_id * 10 + source % 2 + 1000000 else entity_id end as entity_id from e where not (entity_id in (select loser from mv) and source % 3 = 0)")
def split_edges(spark, d):
    """The losers' sources go to two senses; those without a sense lose the link."""
    e = linked(spark, d)
    gone = moves(spark, d).select(F.col("loser").alias("entity_id"))
    sense = e.join(gone, "entity_id").filter("source % 3 != 0").withColumn("sense_id", F.col("entity_id") * 10 + F.col("source") % 2 + 1000000)
    none = gone.select("entity_id", F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("sense_id"))
    return entities.split(e, sense.select("entity_id", "source", "sense_id").unionByName(none))


@add("unmerged_labels", f"with {ALL}, u as (select winner, loser, label_key, role from mv join l on entity_id = loser), a as (select entity_id, label_key, role from l where entity_id not in (select loser from mv) union select winner, label_key, 'alias' from u) select entity_id, label_key, role from a where (entity_id, label_key) not in (select (winner, label_key) from u) union select loser, label_key, role from u")
def unmerged_labels(spark, d):
    x, m = sourced(spark, d), moves(spark, d)
    log = x.join(m, F.col("entity_id") == F.col("loser")).select("winner", "loser", "label_key", "role").distinct()
    after = x.join(m, F.col("entity_id") == F.col("loser"), "left_anti").select("entity_id", "label_key", "role").union(log.select("winner", "label_key", F.lit("alias"))).distinct()
    return entities.unmerged(after, log)


@add("renamed_concepts", "select p_partkey, case when p_name like 'red %' then replace(p_name, 'red ', 'crimson ') else p_name end as p_name from part")
def renamed_concepts(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    names = p.filter("p_name like 'red %'").select(F.col("p_name").alias("old"), F.replace("p_name", F.lit("red "), F.lit("crimson ")).alias("new")).distinct()
    return entities.renamed(p, "p_name", names)


@add("alias_edits", f"with {ALL}, a as (select distinct entity_id, label_key from l where role = 'alias') select entity_id, label_key from a where not (entity_id % 2 = 0 and label_key not like '% %') union select id, 'extra ' || id from pn where id % 3 = 0")
def alias_edits(spark, d):
    """One-word aliases of even entities are added and then removed; some get a new one, after a removal."""
    a = labels(spark, d).filter("role = 'alias'").select("entity_id", "label_key").distinct()
    one = a.filter("entity_id % 2 = 0 and label_key not like '% %'")
    new = a.select("entity_id").distinct().filter("entity_id % 3 = 0").select("entity_id", F.concat(F.lit("extra "), F.col("entity_id").cast("string")).alias("label_key"))
    edit = lambda x, at, op: x.select(F.lit(at).alias("at"), F.lit(op).alias("op"), "entity_id", "label_key")
    return entities.alias_edits(a, edit(one, 1, "add").union(edit(one, 2, "remove")).union(edit(new, 1, "remove")).union(edit(new, 2, "add")))[0]


@add("minted_aliases", f"with {ALL} select distinct entity_id, label_key from l where origin = 'extracted' and label_key not in (select {key_sql('p_type')} from part) and label_key not in (select list_extract(string_split(n, ' '), -1) from pn where id % 2 = 0)")
def minted_aliases(spark, d):
    """Weak aliases that new preferred labels leave."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    new = p.filter("id % 2 = 0").select(F.element_at(F.split("p_name", " "), -1).alias("label_key")).union(table(spark, d, "part").select(text.concept_key(F.col("p_type"))))
    return entities.minted(new, sourced(spark, d))


@add("followed_merges", "with recursive r as (select p_partkey as entity, p_partkey // 3 as cur from part where p_partkey % 3 = 1 union all select entity, cur // 3 from r where cur % 3 = 1) select entity, min(cur) as final from r group by 1")
def followed_merges(spark, d):
    p = table(spark, d, "part").filter("p_partkey % 3 = 1")
    return identity.follow_merges(p.select(F.col("p_partkey").alias("loser"), F.floor(F.col("p_partkey") / 3).alias("winner")))


@add("concept_lookup", f"""with {ALL}, t as (select surface as term, label_key as key from s union select distinct split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) from part), x as (select label_key, first(entity_id order by case when role = 'preferred' then 0 else 1 end, entity_id) as e from l group by 1),
p as (select t.term, first(l.entity_id order by l.label_key, l.entity_id) as e from t join l on role = 'preferred' and starts_with(l.label_key || ' ', t.key || ' ') where t.key not in (select label_key from x) group by 1)
select t.term, coalesce(x.e, p.e) as entity_id from t left join x on x.label_key = t.key left join p on p.term = t.term""")
def concept_lookup(spark, d):
    first = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("term")).distinct()
    terms = named(spark, d).select(F.col("surface").alias("term"), F.col("label_key").alias("key")).union(first.select("term", "term")).distinct()
    return entities.lookup(terms, labels(spark, d))


@add("kept_candidates", """with t as (select conv_id as doc_id, turn as k, lower(split_part(coalesce(text, ''), ' ', 1)) as name, lower(split_part(coalesce(text, ''), ' ', 2)) as alias, row_number() over (partition by conv_id order by turn) as r from conversations)
, u as (with recursive f as (select doc_id, k, r, true as keep, [alias] as seen from t where r = 1 union all
 select t.doc_id, t.k, t.r, not list_contains(f.seen, t.name), case when list_contains(f.seen, t.name) then f.seen else list_append(f.seen, t.alias) end from f join t on t.doc_id = f.doc_id and t.r = f.r + 1) select * from f)
select doc_id, cast(k as int) as k from u where keep""")
def kept_candidates(spark, d):
    """Candidates of a conversation in order, but for those that an earlier kept one has as an alias."""
    word = lambda n: F.lower(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(n)))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("k"), word(1).alias("name_key"), F.array(word(2)).alias("alias_keys"))
    return entities.first_candidates(c)


REL = f"""c as (select p_type as subject, case p_size % 4 when 0 then 'depends_on' when 1 then 'cites' when 2 then 'related_to' else 'likes' end as predicate, p_name as object, case when p_size % 5 = 0 then null else p_size / 40.0 end as confidence from part
 union all select list_extract(string_split(p_name, ' '), -1), 'part_of', p_name, 0.9 from part union all select p_name || 's', 'extends', p_type, 2.0 from part),
v as (select subject, predicate, object, greatest(0.0, least(1.0, coalesce(confidence, 0.5))) as confidence from c where predicate <> 'likes'),
nm as (select label_key, min(entity_id) as concept from {LABELS} where role = 'preferred' or label like '% %' group by 1 having count(distinct entity_id) = 1 union select distinct {key_sql('p_type')}, -1 from part where p_size > 30)"""


def relation_candidates(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size") % 4
    pred = F.when(k == 0, "depends_on").when(k == 1, "cites").when(k == 2, "related_to").otherwise("likes")
    row = lambda s, r, o, c: p.select(s.alias("subject"), r.alias("predicate"), o.alias("object"), c.cast("double").alias("confidence"))
    a = row(F.col("p_type"), pred, F.col("p_name"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 40.0))
    return a.union(row(F.element_at(F.split("p_name", " "), -1), F.lit("part_of"), F.col("p_name"), F.lit(0.9))).union(row(F.concat("p_name", F.lit("s")), F.lit("extends"), F.col("p_type"), F.lit(2.0)))


def concept_names(spark, d):
    x = labels(spark, d).filter("role = 'preferred' or label like '% %'").groupBy("label_key").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("concept")).filter("n = 1").drop("n")
    return x.union(table(spark, d, "part").filter("p_size > 30").select(text.concept_key(F.col("p_type")), F.lit(-1).cast("long"))).distinct()


@add("valid_relations", f"with {REL} select predicate, count(*) as n, round(sum(confidence), 6) as confidence from v group by 1")
def valid_relations(spark, d):
    return graph.valid(relation_candidates(spark, d)).groupBy("predicate").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@add("closed_graph", f"with {REL} select a.concept as s, predicate, b.concept as o, max(confidence) as confidence, count(*) as evidence from v join nm a on a.label_key = {key_sql('subject')} join nm b on b.label_key = {key_sql('object')} where a.concept <> b.concept group by 1, 2, 3")
def closed_graph(spark, d):
    return graph.closed(graph.valid(relation_candidates(spark, d)), concept_names(spark, d))[0]


@add("graph_audit", f"with {REL} select subject, predicate, object, count(*) as n from v left join nm a on a.label_key = {key_sql('subject')} left join nm b on b.label_key = {key_sql('object')} where a.concept is null or b.concept is null or a.concept = b.concept group by 1, 2, 3")
def graph_audit(spark, d):
    """Candidates that the closed graph leaves over."""
    return graph.closed(graph.valid(relation_candidates(spark, d)), concept_names(spark, d))[1].groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@add("graph_export", f"with {REL}, g as (select a.concept as s, predicate, b.concept as o from v join nm a on a.label_key = {key_sql('subject')} join nm b on b.label_key = {key_sql('object')} where a.concept <> b.concept group by 1, 2, 3) select s, predicate, o from g where s >= 0 and o >= 0 or (s < 0 and o % 2 = 0)")
def graph_export(spark, d):
    names = concept_names(spark, d)
    g = graph.closed(graph.valid(relation_candidates(spark, d)), names)[0].select("s", "predicate", "o")
    nodes = names.select("concept").distinct()
    both = graph.export(nodes, g)
    return both.filter("(s >= 0 and o >= 0) or (s < 0 and o % 2 = 0)")


NAME = "upper(left(p_name, 1)) || substr(p_name, 2) || ' (' || upper(left(p_type, 2)) || ')'"


@add("name_rules", f"""select p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) as base, upper(left(p_type, 2)) as abbreviation, replace('raw\\' || p_name, '\\', '/') as path,
 trim(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, p_size < 10 as noise, true as evidence, '["' || (upper(left(p_name, 1)) || substr(p_name, 2)) || '","' || upper(left(p_type, 2)) || '"]' as aliases,
 '["' || p_brand || '","' || upper(left(p_type, 2)) || '"]' as valid from part""")
def name_rules(spark, d):
    cap = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000))
    name = F.concat(cap, F.lit(" ("), F.upper(F.left("p_type", F.lit(2))), F.lit(")"))
    noisy = F.when(F.col("p_size") < 10, F.concat(F.lit("Unknown "), "p_name")).otherwise(F.col("p_name"))
    valid = text.valid_aliases(F.col("p_name"), F.array(F.col("p_brand"), F.lower("p_brand"), F.lit("the"), F.lit("ab"), F.lit(" "), F.upper("p_name"), F.upper(F.left("p_type", F.lit(2)))))
    return table(spark, d, "part").select("p_partkey", text.base_name(name).alias("base"), text.abbreviation(name).alias("abbreviation"), text.posix(F.concat(F.lit("raw\\"), "p_name")).alias("path"), text.slug(F.concat("p_type", F.lit(" & "), "p_brand")).alias("slug"), text.is_noise(noisy).alias("noise"), text.has_evidence(name, F.concat(F.lit("about "), F.upper("p_name"), F.lit("!")), F.lit("raw/x.md")).alias("evidence"), F.to_json(text.safe_aliases(name)).alias("aliases"), F.to_json(valid).alias("valid"))


@add("free_names", "select doc_id, case when k > 1 then stem || '-' || k else stem end as name from (select doc_id, coalesce(source, 'none') as stem, row_number() over (partition by lower(coalesce(source, 'none')) order by doc_id) as k from documents)")
def free_names(spark, d):
    """File names that don't meet: the second of a stem gets -2."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("doc_id"))
    x = docs(spark, d).select("doc_id", F.coalesce("source", F.lit("none")).alias("stem")).withColumn("k", k)
    return x.select("doc_id", F.when(F.col("k") > 1, F.concat_ws("-", "stem", F.col("k").cast("string"))).otherwise(F.col("stem")).alias("name"))


@add("frontmatter", "select doc_id, 'title: ' || doc_id as frontmatter, sha256(coalesce(text, '')) as content_hash from documents")
def frontmatter(spark, d):
    """Notes made of documents, split again: the hash is of the body alone."""
    whole = F.concat(F.lit("---\ntitle: "), F.col("doc_id").cast("string"), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", text.frontmatter(whole)[0].alias("frontmatter"), text.body_hash(whole).alias("content_hash"))


@add("bibliography", r"select doc_id, list_extract(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) as title, '10.1234/x.' || doc_id as doi, '1987' as year from (select doc_id, 'Report of 1987' || chr(10) || 'doi 10.1234/x.' || doc_id || ' end' || chr(10) || coalesce(text, '') as t from documents)")
def bibliography(spark, d):
    whole = F.concat(F.lit("Report of 1987\ndoi 10.1234/x."), F.col("doc_id").cast("string"), F.lit(" end\n"), F.coalesce("text", F.lit("")))
    title, doi, year = text.bibliography(whole)
    return docs(spark, d).select("doc_id", title.alias("title"), doi.alias("doi"), year.alias("year"))


@add("imported_documents", "with h as (select 'in/' || doc_id || case when doc_id % 4 = 0 then '.pdf' else '.txt' end as path, doc_id, sha256(coalesce(text, '')) as hash from documents), f as (select hash, min(path) as first, bool_or(doc_id % 10 = 0) as old from h group by 1) select path, hash, case when path like '%.pdf' then 'paper' else 'notes' end as kind, not old and path = first as new from h join f using (hash)")
def imported_documents(spark, d):
    raw = docs(spark, d).select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".pdf").otherwise(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id")
    known = raw.filter("doc_id % 10 = 0").groupBy(F.sha2("content", 256).alias("hash")).agg(F.min("doc_id").cast("string").alias("id"))
    return notes.imported(raw.drop("doc_id"), known).drop("id")


@add("index_lines", "with p as (select 'Topic ' || doc_id as title, doc_id, case when doc_id % 5 = 1 then 'source' when doc_id % 5 = 0 then 'synthesis' else 'concept' end as kind from documents), k as (select *, case when kind = 'synthesis' then row_number() over (partition by kind order by doc_id desc) else row_number() over (partition by kind order by lower(title), title) end as k from p) select kind as section, cast(k as int) as k, '- [[' || title || ']]' as line from k where kind <> 'synthesis' or k <= 25")
def index_lines(spark, d):
    n = F.col("doc_id")
    p = docs(spark, d).select(F.concat(F.lit("Topic "), n.cast("string")).alias("title"), F.concat(F.lit("wiki/"), n.cast("string")).alias("path"), n.alias("updated"), F.when(n % 5 == 1, "source").when(n % 5 == 0, "synthesis").otherwise("concept").alias("kind"))
    return notes.index_lines(p)


QUERIES = Q
