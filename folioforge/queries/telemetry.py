"""Usage telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions.text import short_hash
from folioforge.operators import sessions
from folioforge.sources import metric_events, table


def session_tool_mix(spark, sf_dir):
    """One vault for the whole log, as where each vault keeps a log of its own."""
    e = metric_events(spark, sf_dir).withColumn("vault_id", F.lit(1))
    return sessions.tool_mix(e, ["vault_id"]).drop("vault_id")


SESSION_SQL = """
with f as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id) > 1800000000 then 1 else 0 end as brk from events),
s as (select *, sum(brk) over (order by ts, event_id rows unbounded preceding) as session_no from f),
g as (select session_no, event_type as tool, count(*) as calls from s group by all)
select cast(session_no as bigint) as session_no, tool, calls, session_calls, round(100.0 * calls / session_calls, 1) as share
from (select *, cast(sum(calls) over (partition by session_no) as bigint) as session_calls from g) where session_calls >= 5
"""

QUERIES = {"session_tool_mix": (session_tool_mix, SESSION_SQL)}


def _q(name, sql):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


@_q("session_tool_mix_by_user", SESSION_SQL.replace("over (order by", "over (partition by user_id order by").replace("1800000000", "14400000000").replace("select session_no, event_type as tool", "select user_id as vault_id, session_no, event_type as tool").replace("select cast(session_no", "select vault_id, cast(session_no").replace("over (partition by session_no)", "over (partition by vault_id, session_no)"))
def session_tool_mix_by_user(spark, sf_dir):
    return sessions.tool_mix(metric_events(spark, sf_dir), ["vault_id"], 14400)


@_q("daily_rollup", "select cast(ts as date) as day, user_id as vault_id, event_type as tool, count(*) as calls, sum(value) as latency_ms, sum(case when event_type <> 'error' then 1 else 0 end)::bigint as successes, sum(case when event_type = 'error' then 1 else 0 end)::bigint as failures from events group by 1, 2, 3")
def daily_rollup(spark, sf_dir):
    e = metric_events(spark, sf_dir)
    return e.groupBy(F.to_date("ts").alias("day"), "vault_id", "tool").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("latency_ms"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))


@_q("zero_result_queries", "select event_type as tool, json_extract_string(props, '$.k') as label, count(*) as calls from events where cast(json_extract_string(props, '$.k') as int) < 10 group by 1, 2 order by calls desc, tool, label limit 20")
def zero_result_queries(spark, sf_dir):
    """The most frequent queries without a result (here: a label under 10)."""
    e = metric_events(spark, sf_dir).filter(F.col("label").cast("int") < 10)
    return e.groupBy("tool", "label").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool", "label").limit(20)


@_q("single_source_demand", """with c as (select cast(doc_id % 100 as varchar) as name from documents group by 1 having count(distinct source) = 1),
e as (select event_id, case when event_id % 2 = 0 then left(sha256(json_extract_string(props, '$.k')), 8) else json_extract_string(props, '$.k') end as label from events)
select name as concept, count(*) as calls from e join c on label = name or label = left(sha256(name), 8) group by 1 order by calls desc, concept limit 20""")
def single_source_demand(spark, sf_dir):
    """The most asked concepts with one distinct source; a label is a name or its hash."""
    name = (F.col("doc_id") % 100).cast("string")
    one = table(spark, sf_dir, "documents").groupBy(name.alias("concept")).agg(F.countDistinct("source").alias("n")).filter("n = 1")
    keys = one.select("concept", F.explode(F.array(F.col("concept"), short_hash(F.col("concept")))).alias("label"))
    asked = F.when(F.col("id") % 2 == 0, short_hash(F.col("label"))).otherwise(F.col("label"))
    e = metric_events(spark, sf_dir).select(asked.alias("label"))
    return e.join(keys, "label").groupBy("concept").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "concept").limit(20)


@_q("repeat_weak_queries", "select event_type as tool, left(sha256(json_extract_string(props, '$.k')), 8) as label_hash, count(*) as calls from events where value < 10 group by 1, 2 having count(*) >= 2")
def repeat_weak_queries(spark, sf_dir):
    e = metric_events(spark, sf_dir).filter("latency_ms < 10")
    return e.groupBy("tool", F.left(F.sha2(F.col("label").cast("binary"), 256), F.lit(8)).alias("label_hash")).agg(F.count("*").alias("calls")).filter("calls >= 2")


@_q("retention", "select event_id as id from events where ts >= (select max(ts) from events) - interval 7 day")
def retention(spark, sf_dir):
    e = metric_events(spark, sf_dir)
    last = e.agg(F.max("ts")).first()[0]  # one value
    return e.filter(F.col("ts") >= F.lit(last) - F.expr("interval 7 days")).select("id")


@_q("size_cap", "select event_id as id from (select event_id, row_number() over (order by ts, event_id) as k, count(*) over () as n from events) where k > n // 10")
def size_cap(spark, sf_dir):
    """Without the oldest tenth: the cut is the event at that rank, found by range-sorted days, not one global window."""
    from pyspark.sql import Window

    e = metric_events(spark, sf_dir).select("id", "ts", F.to_date("ts").alias("day"))
    days = e.groupBy("day").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    k = F.row_number().over(Window.partitionBy("day").orderBy("ts", "id")) + F.col("before")
    return e.join(before.drop("n"), "day").withColumn("k", k).filter(F.col("k") > F.floor(F.col("all") / 10)).select("id")


@_q("tool_totals", "select event_type as tool, count(*) as calls, round(avg(value), 6) as mean_ms, max(value) as max_ms, count(distinct user_id) as vaults from events where event_type is not null and event_type <> '' group by 1")
def tool_totals(spark, sf_dir):
    e = metric_events(spark, sf_dir).filter("tool is not null and tool != ''")
    return e.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("max_ms"), F.countDistinct("vault_id").alias("vaults"))
