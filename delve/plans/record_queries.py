"""Operators on records, decisions, claims and metrics as queries over the driver's tables, with the same in SQL.

The tables stand in for logs: orders are tasks, users are runs, events are decisions, conversations are request traces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from delve.operators import journal, metrics, records, report, selection
from delve.plans.registry import query, read

# ingest and constraints


@query(
    """select o.o_orderkey as task_id, case when p.o_orderkey is null then 'no_pull_request' when p.o_orderstatus = 'P' then 'not_merged'
    when o.o_orderpriority <> (case when p.o_totalprice > 300000 then '1-URGENT' else p.o_orderpriority end) then 'base_differs' end as reason
    from orders o left join (select * from orders where o_totalprice >= 20000) p on p.o_orderkey = o.o_orderkey"""
)
def ingest_tasks(spark, d):
    orders = read(spark, d, "orders")
    rows = orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("repository"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("base"))
    base = F.when(F.col("o_totalprice") > 300000, "1-URGENT").otherwise(F.col("o_orderpriority"))
    pulls = orders.where("o_totalprice >= 20000").select(F.col("o_orderstatus").alias("repository"), F.col("o_orderkey").alias("number"), base.alias("base_sha"), (F.col("o_orderstatus") != "P").alias("merged"), F.col("o_orderdate").alias("merged_at"))
    kept, rejected = records.ingest_tasks(rows, pulls)
    return kept.select("task_id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("task_id", "reason"))


@query("select c_custkey as task_id from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def fresh_tasks(spark, d):
    taken = read(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("task_id"))
    return records.without(read(spark, d, "customer").select(F.col("c_custkey").alias("task_id")), taken)


@query("select o_orderkey as task_id, o_orderpriority as repository from orders where cast(o_orderdate as date) > date '1997-01-01'")
def recent_tasks(spark, d):
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("repository"), F.col("o_orderdate").alias("merged_at"))
    return records.recent_set(tasks, "1997-01-01").select("task_id", "repository")


@query("select 'flags' as field, 'differs' as reason from (select count(distinct l_returnflag) as n from lineitem) where n <> 2 union all select 'nothing', 'missing' union all select 'absent', 'missing'")
def contract_gates(spark, d):
    actual = read(spark, d, "lineitem").agg(F.countDistinct("l_returnflag").alias("flags"), F.min("l_linenumber").alias("first"), F.max(F.lit(None).cast("string")).alias("nothing"))
    return records.field_gates(actual, {"flags": 2, "nothing": 1, "absent": 2})


@query("select cast(max(o_orderkey) as varchar) as path, max(o_orderkey) as mtime from orders")
def latest_report(spark, d):
    return records.latest_report(read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("mtime")))


@query(
    """with sole as (select distinct o_custkey as task_id, cast(o_orderkey as varchar) as path from orders where o_orderstatus <> 'F'),
    r as (select c_custkey as task_id, c_mktsegment = 'BUILDING' as head, c_acctbal >= 0 as clean, c_nationkey = 0 as refs, not exists (select 1 from sole where sole.task_id = c_custkey and contains(c_name, sole.path)) as request from customer)
    select task_id, 'head' as "check", head as passed from r union all select task_id, 'clean', clean from r union all select task_id, 'refs', refs from r union all select task_id, 'request', request from r"""
)
def leak_checks(spark, d):
    repositories = read(spark, d, "customer").select(
        F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("head"), F.lit("BUILDING").alias("expected_head"), (F.col("c_acctbal") < 0).alias("dirty"), F.col("c_nationkey").alias("refs"), F.col("c_name").alias("request")
    )
    paths = read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus")
    return records.leak_checks(repositories, paths.drop("o_orderstatus"), paths.where("o_orderstatus = 'F'").drop("o_orderstatus"))


@query(
    r"""with w as (select source as task_id, doc_id as path, unnest(list_distinct(regexp_extract_all(text, '\w+'))) as name from documents)
    select task_id, name, count(*) as documents from w where name in ('the', 'und', 'que', 'zzz') group by task_id, name"""
)
def symbol_leaks(spark, d):
    docs = read(spark, d, "documents")
    names = docs.select(F.col("source").alias("task_id")).distinct().select("task_id", F.explode(F.array(*map(F.lit, ("the", "und", "que", "zzz")))).alias("name"))
    found = records.symbol_leaks(docs.select(F.col("source").alias("task_id"), F.col("doc_id").alias("path"), "text"), names)
    return found.groupBy("task_id", "name").agg(F.count("*").alias("documents"))


@query("select r_regionkey as task_id, r_name as symbols from region")
def symbol_gold(spark, d):
    changed = read(spark, d, "region").select(F.col("r_regionkey").alias("task_id"), F.col("r_name").alias("symbol"))
    out = records.symbol_gold(changed, read(spark, d, "nation").select(F.col("n_regionkey").alias("task_id")), wanted=5)
    return out.select("task_id", F.array_join("symbols", ",").alias("symbols"))


# de-duplication


@query("select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by user_id, event_type")
def first_wins(spark, d):
    return records.first_wins(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id, event_type")
def last_wins(spark, d):
    return records.last_wins(read(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select user_id, event_type, max(event_id) as event_id from events where value > 50 group by user_id, event_type")
def last_successes(spark, d):
    """Of records that ended well, the last of each key."""
    return records.last_wins(read(spark, d, "events").where("value > 50").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("select o_custkey, o_orderkey, case when row_number() over (partition by o_custkey order by o_orderkey desc) <= 3 then 'full' else 'summary' end as detail from orders")
def recent_and_older(spark, d):
    return records.recent_and_older(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("with u as (select o_custkey as key, o_orderkey as id from orders union all select c_custkey, c_custkey from customer) select key, count(*) as n, count(distinct id) as ids from u group by key")
def combined(spark, d):
    """U6: rows of two sources under one schema, by name, all kept."""
    orders, customers = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("id"))
    return orders.unionByName(customers).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# aggregates


@query(
    """with r as (select source, count(*) filter (where n_chars > 1000 and quality = 1) as tp, count(*) filter (where n_chars > 1000 and quality = 0) as fp, count(*) filter (where n_chars <= 1000 and quality = 1) as fn from documents join labels using (doc_id) group by source),
    m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from r)
    select source, tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) as f1 from m"""
)
def pooled_scores(spark, d):
    long, good = F.col("n_chars") > 1000, F.col("quality") == 1
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", *(c.cast("long").alias(n) for n, c in (("tp", long & good), ("fp", long & ~good), ("fn", ~long & good))))
    return records.pooled_scores(rows, ["source"])


@query("select event_type, count(*) as runs, round(avg(case when value > 20 then value end), 6) as value from events where value <= 180 or value is null group by event_type")
def protocol_means(spark, d):
    rows = read(spark, d, "events").select("event_type", F.when(F.col("value") > 20, F.col("value")).alias("value"), (F.col("value") > 180).alias("provider_failure"))
    return records.protocol_means(rows, "event_type", ["value"]).withColumn("value", F.round("value", 6))


@query("select event_type as metric, round(sum(cast(round(value * 100) as bigint)) / count(*), 4) as each, round(sum(cast(round(value * 100) as bigint)) / count(*) * 24, 4) as estimate from events group by event_type")
def workload(spark, d):
    totals = read(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value"), F.count("*").alias("runs"))
    return records.workload(totals, tasks=4, seeds=2, systems=3).select("metric", F.round("each", 4).alias("each"), F.round("estimate", 4).alias("estimate"))


@query("select conv_id as scenario, max(strlen(text)) as largest, min(turn) filter (where strlen(text) > 400) as first_over from conversations group by conv_id")
def request_maxima(spark, d):
    requests = read(spark, d, "conversations").select(F.col("conv_id").alias("scenario"), F.col("turn").alias("seq"), F.octet_length("text").alias("bytes"))
    return records.request_maxima(requests, cap=400)


@query(
    """with c as (select conv_id, turn, case when role <> 'system' then length(text) end as tokens from conversations),
    b as (select conv_id, turn, coalesce(sum(tokens) over w, 0)::bigint as used, coalesce(bool_or(tokens is null) over w, false) as unknown from c window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding))
    select conv_id as run, turn as seq, used, unknown or used >= 1000 as blocked from b"""
)
def token_ceiling(spark, d):
    calls = read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.length("text")).alias("tokens"))
    return records.token_ceiling(calls, 1000).select("run", "seq", "used", "blocked")


@query(
    """with e as (select *, coalesce(sum((value > 50)::int) over (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding), 0) as kept from events)
    select event_id as seq, value > 50 and kept >= 2 as retired from e"""
)
def review_keeps(spark, d):
    decisions = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("target"), F.when(F.col("value") > 50, "keep").otherwise("confirm").alias("decision"))
    return records.review_keeps(decisions).select("seq", "retired")


@query(
    """with b as (select cast(o_orderkey as varchar) as path, o_orderpriority as category from orders), a as (select cast(o_orderkey as varchar) as path, case when o_totalprice > 300000 then 'moved' else o_orderpriority end as category from orders where o_orderstatus <> 'P')
    select path, category, 'lost' as change from (select * from b except all select * from a) union all select path, category, 'added' from (select * from a except all select * from b)"""
)
def verdicts_only(spark, d):
    orders = read(spark, d, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    moved = F.when(F.col("o_totalprice") > 300000, "moved").otherwise(F.col("o_orderpriority"))
    return records.verdicts_only(orders.select("path", F.col("o_orderpriority").alias("category")), orders.where("o_orderstatus <> 'P'").select("path", moved.alias("category")))


@query(
    """with c as (select l_orderkey as task_id, cast(l_partkey as varchar) as path, l_returnflag as f from lineitem), t as (select distinct task_id, path from c where f = 'R'), h as (select distinct task_id from t),
    v as (select 'control' as variant, task_id, path, true as applicable from c union all select 'unrelated', task_id, path, true from c union all select 'unrelated', task_id, 'zz_unrelated.py', true from (select distinct task_id from c)
      union all select 'drop_tests', task_id, path, task_id in (select task_id from h) from c where (task_id, path) not in (select task_id, path from t))
    select variant, applicable, count(*) as n, count(distinct task_id) as tasks, count(distinct path) as paths from v group by variant, applicable"""
)
def planted_anomalies(spark, d):
    changes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").cast("string").alias("path"), "l_returnflag")
    out = records.plant_anomalies(changes.drop("l_returnflag"), changes.where("l_returnflag = 'R'").drop("l_returnflag").distinct())
    return out.groupBy("variant", "applicable").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("path").alias("paths"))


@query("select task_id, path, 'high' as confidence from (select l_orderkey as task_id, l_partkey as path from lineitem) where (task_id, path) in (select o_orderkey, o_custkey from orders)")
def oracle_predictions(spark, d):
    gold = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("path"))
    return records.oracle_predictions(gold, read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("path")))


@query("select o_custkey as task_id, arg_min(o_orderpriority, (o_totalprice, o_orderpriority)) as system, min(o_totalprice) as recall from orders group by o_custkey")
def headline(spark, d):
    return records.headline(read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("system"), F.col("o_totalprice").alias("recall")))


# joins on facts and evidence


@query(
    """with f as (select p_partkey as fact_id, [lower(p_type), lower(p_type) || '/' || p_brand, lower(p_type) || '/' || p_brand || '/f' || p_size || '.py', p_name] || case when p_size >= 25 then [p_brand] else [] end as targets from part)
    select distinct fact_id, t as target from (select fact_id, unnest(targets) as t from f) where t in ('economy', 'Brand#13', 'standard/Brand#13', 'cold widget')"""
)
def fact_claims(spark, d):
    path = F.concat_ws("/", F.lower("p_type"), "p_brand", F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".py")))
    facts = read(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), path.alias("path"), F.col("p_name").alias("symbol_id"), F.when(F.col("p_size") >= 25, F.col("p_brand")).alias("handler"))
    targets = spark.createDataFrame([(x,) for x in ("economy", "Brand#13", "standard/Brand#13", "cold widget")], "target string")
    return records.fact_claims(facts, targets).select("fact_id", "target")


@query(
    """select event_id, event_type || ',' || user_id || '::f,' || user_id as touched, case when value > 180 then 'find_tests ' || event_type || ' failed' else 'find_tests ' || event_type || ': ' || user_id || ' tests' end as line,
    cast(regexp_extract(props, '(\\d+)', 1) as bigint) as input, cast(regexp_extract(props, '(\\d+)', 1) as bigint) + user_id as total, user_id = 7 as consistent from events"""
)
def tool_evidence(spark, d):
    user, k = F.col("user_id").cast("string"), F.regexp_extract("props", r"(\d+)", 1)
    touched = records.touched(F.array("event_type"), F.array(F.concat(user, F.lit("::f"))))
    payload = F.format_string('{"input_tokens": %s, "output_tokens": 7, "total_tokens": %s, "cached": 1}', k, (k.cast("long") + F.col("user_id")).cast("string"))
    line = records.evidence_line(F.lit("find_tests"), F.col("value") <= 180, F.col("event_type"), F.col("user_id"))
    rows = read(spark, d, "events").select("event_id", F.array_join(touched, ",").alias("touched"), line.alias("line"), records.usage(payload).alias("u"))
    return rows.select("event_id", "touched", "line", "u.input", "u.total", "u.consistent")


@query("select o_custkey, sha256(string_agg(sha256(o_orderpriority) || ' ' || o_orderkey, chr(10) order by cast(o_orderkey as varchar))) as identity from orders group by o_custkey")
def source_identity(spark, d):
    files = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return records.source_identity(files, "o_custkey")


@query("select event_id, replace(props, ' ', '') as canonical, sha256(replace(props, ' ', '')) as sha256, length(props) + 2 + length(props) - length(replace(props, '\"', '')) as ascii_bytes from events")
def canonical_json(spark, d):
    return records.canonical_json(read(spark, d, "events").select("event_id", "props"), "props").drop("props")


@query(
    """select o_orderkey as task, case when o_orderstatus = 'P' then 'missing' else 'hash_differs' end as problem from orders where o_orderstatus = 'P' or o_totalprice > 300000"""
)
def terminal_evidence(spark, d):
    orders = read(spark, d, "orders")
    stored = orders.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_totalprice") > 300000, "bad").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256)).alias("sha256"))
    return records.terminal_evidence(stored, orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").cast("string").alias("summary")))


# views

_STATUS_SQL = "case when event_type in ('view', 'click') then 'suspected' when event_type = 'error' then 'rejected' else 'confirmed' end"


def _status():
    return F.when(F.col("event_type").isin("view", "click"), "suspected").when(F.col("event_type") == "error", "rejected").otherwise("confirmed")


@query(
    f"""with l as (select distinct user_id as run, {_STATUS_SQL} as status, regexp_extract(props, '(\\d+)', 1) as target from events)
    select run, coalesce(string_agg(target, ',' order by target) filter (where status = 'suspected'), '') as suspected, coalesce(string_agg(target, ',' order by target) filter (where status = 'confirmed'), '') as confirmed,
    coalesce(string_agg(target, ',' order by target) filter (where status = 'rejected'), '') as rejected from l group by run"""
)
def ledger_columns(spark, d):
    ledger = read(spark, d, "events").select(F.col("user_id").alias("run"), _status().alias("status"), F.regexp_extract("props", r"(\d+)", 1).alias("target"))
    return records.ledger_columns(ledger).select("run", *(F.array_join(c, ",").alias(c) for c in ("suspected", "confirmed", "rejected")))


@query("select user_id as run, count(*) filter (where event_type <> 'view') as tool_calls, count(*) filter (where event_type <> 'view' and value <= 20) as failures, count(*) filter (where event_type <> 'view' and value <= 50) as invalid_targets, count(*) filter (where event_type = 'view') as model_calls from events group by user_id")
def run_record(spark, d):
    event = F.when(F.col("event_type") == "view", "model").otherwise("tool")
    return records.run_record(read(spark, d, "events").select(F.col("user_id").alias("run"), event.alias("event"), (F.col("value") > 20).alias("ok"), (F.col("value") > 50).alias("target_valid")))


@query("select p_brand, substr(string_agg(p_type || ':' || p_partkey || ':' || p_name, chr(10) order by p_type, p_partkey, p_name), 1, 500) as outline from part group by p_brand")
def outline(spark, d):
    rows = read(spark, d, "part").select("p_brand", F.col("p_type").alias("path"), F.col("p_partkey").alias("first"), F.col("p_name").alias("qualname"))
    return records.outline(rows, "p_brand", most=500)


@query(
    """select rank, path, category from (select row_number() over (order by coalesce(list_position(['missing_predicted', 'missing_test', 'stale_caller', 'unexpected', 'adjacent', 'expected'], category), 99), path) as rank, path, category
    from (select n_name as path, case n_regionkey when 0 then 'expected' when 1 then 'stale_caller' when 2 then 'adjacent' when 3 then 'unexpected' else 'missing_test' end as category from nation))"""
)
def finding_cards(spark, d):
    region = F.col("n_regionkey")
    category = F.when(region == 0, "expected").when(region == 1, "stale_caller").when(region == 2, "adjacent").when(region == 3, "unexpected").otherwise("missing_test")
    cards = records.finding_cards(read(spark, d, "nation").select(F.col("n_name").alias("path"), category.alias("category")))
    return cards.select(F.col("rank").cast("long").alias("rank"), "path", "category")


# claims and decisions


@query(
    f"""with c as (select user_id as run, event_id as position, event_type as target, case when value > 50 then 'high' else 'low' end as confidence, value from events),
    led as (select distinct user_id as run, event_type as target from events where value > 150),
    r as (select c.*, case when led.run is null then 'unconfirmed' when row_number() over (partition by c.run, c.target order by c.position) > 1 then 'duplicate' when c.value <= 20 then 'unsupported' end as reason from c left join led on led.run = c.run and led.target = c.target)
    select run, position, target, case when reason is null and confidence = 'high' and value <= 80 then 'medium' else confidence end as confidence, reason from r"""
)
def keep_claims(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.col("event_type").alias("target"), "value")
    claims = e.select("run", "position", "target", F.when(F.col("value") > 50, "high").otherwise("low").alias("confidence"), F.array("position").alias("evidence_ids"))
    ledger = e.where("value > 150").select("run", "target").distinct().withColumn("status", F.lit("confirmed"))
    evidence = e.select("run", F.col("position").alias("evidence_id"), (F.col("value") > 20).alias("ok"), F.array("target").alias("touched"), (F.col("value") > 80).alias("strong"))
    kept, dropped = report.keep_claims(claims, ledger, evidence)
    columns = ["run", "position", "target", "confidence"]
    return kept.select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(dropped.select(*columns, "reason"))


@query(
    """with c as (select distinct user_id as run, event_type as target from events where value > 100), k as (select distinct user_id as run, event_type as target from events where value > 150),
    f as (select user_id as run, event_type as target, min(case when value <= 5 then 'a_small' else 'b_odd' end) as refusal from events where value <= 5 or (value > 5 and value <= 10) group by 1, 2)
    select c.run, c.target, case when f.refusal is null then 'low' end as confidence, f.refusal from c left join k on k.run = c.run and k.target = c.target left join f on f.run = c.run and f.target = c.target where k.run is null"""
)
def retained_targets(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("target"), "value")
    ledger = e.where("value > 100").select("run", "target").distinct().withColumn("status", F.lit("confirmed"))
    checks = e.select("run", "target", F.when(F.col("value") <= 5, "a_small").otherwise("b_odd").alias("check"), (F.col("value") > 10).alias("passed"))
    return report.retained(ledger, e.where("value > 150").select("run", "target").distinct(), checks)


@query(
    """with f as (select user_id as run, event_type as target, min(event_id) filter (where value > 100) as c, min(event_id) filter (where value <= 50) as k from events group by 1, 2)
    select run, target, case when k < c then 'low' else 'high' end as tier from f where c is not null"""
)
def confidence_tiers(spark, d):
    decision = F.when(F.col("value") > 100, "confirm").when(F.col("value") <= 50, "keep").otherwise("none")
    return report.confidence_tiers(read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("target"), decision.alias("decision")))


_AREAS = """with e as (select user_id as run, event_id as seq, event_type as target, cast(floor(value) as bigint) as high, case when value > 100 then 'd' when value > 30 then 'r' else 't' end as tool from events),
    o as (select *, max(seq) filter (where tool <> 'r') over (partition by run, target) as last_set from e),
    s as (select run, target, max(last_set) as at, arg_max(case when tool = 'd' then 20 when tool = 't' then 5 end, seq) filter (where tool <> 'r') as base from o group by run, target),
    n as (select s.run, s.target, s.base, max(10 + high) filter (where tool = 'r' and (s.at is null or seq > s.at)) as refs from s join e on e.run = s.run and e.target = s.target group by s.run, s.target, s.base)
    select run, target, cast(greatest(coalesce(base, -1), coalesce(refs, -1)) as bigint) as score, case when coalesce(refs, -1) > coalesce(base, -1) then 'references' when base = 20 then 'dependency' else 'tests' end as reason from n"""


@query(_AREAS)
def regression_areas(spark, d):
    tool = F.when(F.col("value") > 100, "get_dependencies").when(F.col("value") > 30, "find_references").otherwise("find_tests")
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), tool.alias("tool"), F.col("event_type").alias("target"), F.floor("value").cast("long").alias("high_references"))
    return report.regression_areas(rows).select(F.col("run").cast("long").alias("run"), "target", "score", "reason")


@query(
    """with s as (select user_id as run, event_type as target, min(event_id) as seq from events group by 1, 2), t as (select s.*, i.tier, ['inspect_symbol', 'find_references', 'find_tests'][i.tier + 1] as tool from s cross join (select unnest([0, 1, 2]) as tier) i),
    done as (select distinct user_id as run, event_type as target from events where value > 150),
    l as (select t.* from t left join done d on d.run = t.run and d.target = t.target and t.tool = 'find_references' where d.run is null),
    n as (select *, row_number() over (partition by run order by tier, seq, target) as n from l) select run, target, tool, n from n where n <= 8"""
)
def proof_steps(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"), "value")
    done = e.where("value > 150").select("run", F.lit("find_references").alias("tool"), "target").distinct()
    return report.proof_steps(e.groupBy("run", "target").agg(F.min("seq").alias("seq")), done).select("run", "target", "tool", "n")


@query(
    """with e as (select user_id as run, event_id as seq, event_type <> 'view' as call, value > 60 as progress, value > 90 as change, event_type = 'view' as checkpoint, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as candidates, cast(round(value) as bigint) as tokens from events),
    a as (select *, sum(call::int) over w as calls, sum(progress::int) over w as streak, sum(change::int) over w as changes, sum(checkpoint::int) over w as reviews, sum(tokens) over w as used from e window w as (partition by run order by seq rows unbounded preceding)),
    b as (select *, row_number() over (partition by run, streak order by seq) - case when streak > 0 then 1 else 0 end as since, row_number() over (partition by run, changes order by seq) - case when changes > 0 then 1 else 0 end as stalled from a),
    m as (select run, seq, case when calls >= 25 then 'tool_budget' when since >= 4 then 'no_progress' when stalled >= 8 then 'no_ledger_progress' when reviews > 8 then 'review_exhausted' when candidates > 95 then 'candidate_cap' when used >= 900 then 'token_ceiling' end as stop_reason from b)
    select run, min(seq) as seq, arg_min(stop_reason, seq) as stop_reason from m where stop_reason is not null group by run"""
)
def stop_reasons(spark, d):
    view = F.col("event_type") == "view"
    steps = read(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), (~view).alias("tool_call"), (F.col("value") > 60).alias("progress"), (F.col("value") > 90).alias("ledger_change"), view.alias("checkpoint"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("candidates"), F.round("value").cast("long").alias("tokens")
    )
    return report.stop_reasons(steps, candidates=95, tokens=900)


@query(
    """select user_id as run, event_type as target, bool_or(value > 20 and value > 80 and user_id % 3 <> 0 and event_type <> 'view') as direct from events group by 1, 2"""
)
def direct_citations(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("target"), F.col("event_id").alias("evidence_id"), "value")
    tool = F.when(F.col("target") == "view", "search_code").otherwise("find_references")
    aimed = F.when(F.col("run") % 3 == 0, "other").otherwise(F.concat("target", F.lit("::f")))
    evidence = e.select("run", "evidence_id", (F.col("value") > 20).alias("ok"), (F.col("value") > 80).alias("strong"), tool.alias("tool"), F.array("target").alias("touched"), aimed.alias("aimed"))
    return report.direct_citations(e.select("run", "target", "evidence_id"), evidence)


@query(
    """with c as (select o_orderkey as run, 'p' || o_custkey as target, case o_orderstatus when 'F' then 'rejected' when 'O' then 'suspected' else 'confirmed' end as status, o_totalprice > 150000 as strong, o_totalprice > 200000 as refs, o_totalprice > 100000 as tests from orders),
    s as (select 'p' || user_id as path, event_type || user_id as id, row_number() over (partition by user_id order by event_type) as n from (select distinct user_id, event_type from events)), f as (select path, string_agg(id, ' | ' order by id) as ids from s where n <= 3 group by path)
    select run, target, concat_ws(';', case when status = 'suspected' and not strong then 'inspect_symbol ' || target end, case when status <> 'rejected' and not refs and ids is not null then 'find_references ' || ids end, case when status <> 'rejected' and not tests then 'find_tests ' || target end) as needs
    from c left join f on f.path = c.target"""
)
def candidate_needs(spark, d):
    price, status = F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "suspected").otherwise("confirmed")
    candidates = read(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("target"), status.alias("status"), (price > 150000).alias("strong"), (price > 200000).alias("checked_refs"), (price > 100000).alias("checked_tests"))
    user = F.col("user_id").cast("string")
    symbols = read(spark, d, "events").select(F.concat(F.lit("p"), user).alias("path"), F.concat("event_type", user).alias("id")).distinct()
    return report.candidate_needs(candidates, symbols).withColumn("needs", F.array_join("needs", ";"))


@query(
    """with c as (select conv_id as run, turn as position, length(text) as size, length(text) // 3 as least, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as total, row_number() over (partition by conv_id order by turn) = 1 as first from conversations)
    select run, position, case when total <= 300 then 'shown' when first and least <= 300 then 'reduced' else 'deferred' end as decision from c"""
)
def bounded_batch(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("position"), F.length("text").alias("size"), F.floor(F.length("text") / 3).alias("least_size"))
    return report.bounded_batch(rows, 300).select("run", "position", "decision")


@query(
    """select distinct user_id as run, cast(user_id as varchar) || event_type as target, 'existing_target_classified_new_file' as error from events where value > 60 and value < 120 and (user_id, event_type) in (select (user_id, event_type) from events where value > 150) and user_id in (select c_custkey from customer where c_acctbal > 0)"""
)
def repairable_drafts(spark, d):
    user = F.col("user_id")
    e = read(spark, d, "events").select(user.alias("run"), F.concat(user.cast("string"), "event_type").alias("target"), "value")
    drafts = e.select("run", "target", F.when((F.col("value") > 60) & (F.col("value") < 120), "new_file").otherwise("modified").alias("change_type")).distinct()
    ledger = e.where("value > 150").select("run", "target", F.lit("confirmed").alias("status")).distinct()
    existing = e.join(read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("run")), "run", "left_semi").select("target").distinct()
    return report.repairable_drafts(drafts, ledger, existing)


@query(
    """with s as (select user_id as run, event_type as target, min(event_id) as seq from events group by 1, 2), t as (select s.*, i.tier, ['inspect_symbol', 'find_references', 'find_tests'][i.tier + 1] as tool from s cross join (select unnest([0, 1, 2]) as tier) i),
    n as (select *, row_number() over (partition by run order by tier, seq, target) as n from t) select run, target, tool, n from n where n <= 6"""
)
def presubmit_proof(spark, d):
    """Before an accepted submission at most six planned calls are waited for."""
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("target")).agg(F.min("event_id").alias("seq"))
    return report.proof_steps(e, e.select("run", F.lit("").alias("tool"), "target"), most=6).select("run", "target", "tool", "n")


@query(
    """with e as (select *, regexp_extract(props, '(\\d+)', 1) as k from events), n as (select *, row_number() over (partition by user_id, event_type, k order by event_id) as n from e)
    select event_id as seq, case when value <= 2 then 'disabled' when value <= 4 then 'invalid_arguments' when value <= 6 then 'invalid_target' when n > 1 then 'duplicate' when value > 180 then 'stalled' end as waste from n"""
)
def wasted_choices(spark, d):
    v = F.col("value")
    choices = read(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.regexp_extract("props", r"(\d+)", 1).alias("arguments"), (v > 2).alias("enabled"), (v > 4).alias("valid_arguments"), (v > 6).alias("valid_target"), (v > 180).alias("stalled")
    )
    return report.wasted_choices(choices).select("seq", "waste")


@query(
    """select f.task_id, f.path, f.seeds, c.c_name as context from (select o_custkey as task_id, o_orderpriority as path, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as seeds from orders group by 1, 2) f left join customer c on c.c_custkey = f.task_id and c.c_acctbal > 0"""
)
def adjudication_rows(spark, d):
    findings = read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("seed"))
    known = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("context"))
    context = findings.select("task_id", "path").distinct().join(known, "task_id")
    return report.adjudication_rows(findings, context).withColumn("seeds", F.array_join("seeds", ","))


@query("select o.o_orderpriority as kind, coalesce(l.l_linestatus, 'missing') as status, count(*) as count from orders o left join (select l_orderkey, min(l_linestatus) as l_linestatus from lineitem where l_quantity > 45 group by l_orderkey) l on l.l_orderkey = o.o_orderkey group by 1, 2")
def reconcile(spark, d):
    archived = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("kind"))
    current = read(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min("l_linestatus").alias("status"))
    return report.reconcile(archived, current)


@query("select event_id, replace(props, ' ', '') as body from events")
def compacted(spark, d):
    return report.compacted(read(spark, d, "events").select("event_id", F.col("props").alias("body")))


# metrics and selections


@query(
    """with p as (select o_custkey as c, list(distinct o_orderpriority) as p, list(distinct o_orderpriority) filter (where o_orderstatus = 'F') as g from orders group by 1), n as (select c, len(p) as n, coalesce(len(g), 0) as m, coalesce(len(list_intersect(p, g)), 0) as h from p)
    select c, h as tp, n - h as fp, m - h as fn, round(coalesce(h / nullif(n, 0), 0), 6) as precision, round(coalesce(h / nullif(m, 0), 0), 6) as recall, h = n and h = m as exact from n"""
)
def set_scores(spark, d):
    sets = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("g"))
    scores = metrics.set_scores(F.col("p"), F.col("g"))
    return sets.select("c", *((F.round(v, 6) if k in ("precision", "recall") else v).alias(k) for k, v in scores.items()))


@query(
    """with r as (select p_partkey as path, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part)
    select l_orderkey as test_path, min(rank) as best_rank, round(1 / min(rank), 6) as score from lineitem join r on r.path = l_partkey group by l_orderkey"""
)
def reciprocal_test_scores(spark, d):
    from pyspark.sql import Window

    ranked = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return metrics.reciprocal_test_scores(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("test_path"), F.col("l_partkey").alias("source_path")), ranked)


@query(
    """with p as (select user_id as run, event_id as position, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as path from events), f as (select *, min(position) over (partition by run, path) as first from p)
    select run, path, position, case when path not in (select c_custkey from customer where c_acctbal > 0) then 'not_a_source' when position > first then 'repeated' end as reason from f"""
)
def normalised_ranking(spark, d):
    predictions = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("path"))
    kept, dropped = metrics.normalised_ranking(predictions, read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("path")))
    return kept.select("run", "path", "position", F.lit(None).cast("string").alias("reason")).unionByName(dropped)


@query(
    """with h as (select p_brand as path, p_partkey as position, row_number() over (partition by p_brand order by p_partkey) as turn, min(p_partkey) over (partition by p_brand) as first from part where p_size > 3)
    select path, position, turn from h order by turn, first limit 30"""
)
def diverse_by_file(spark, d):
    return selection.diverse_by_file(read(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("position"), "p_size"), 30, skip=F.col("p_size") <= 3).select("path", "position", "turn")


# logs


@query(
    """with e as (select user_id as task, event_id as sequence, case when event_type = 'view' then 'request' when event_type = 'click' then 'reserved' else 'response' end as kind, cast(regexp_extract(props, '(\\d+)', 1) as bigint) % 3 as attempt from events),
    b as (select *, lag(kind) over w as before, max(attempt) over (partition by task order by sequence rows between unbounded preceding and 1 preceding) as number from e window w as (partition by task order by sequence))
    select sequence, case when kind = 'reserved' and coalesce(before, '') <> 'request' then 'reserved_without_request' when kind = 'response' and coalesce(before, '') <> 'reserved' then 'response_without_reservation'
      when kind = 'reserved' and attempt <> coalesce(number + 1, 1) then 'attempt_out_of_order' end as problem from b"""
)
def call_order(spark, d):
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "reserved").otherwise("response")
    events = read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("sequence"), kind.alias("kind"), (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 3).alias("attempt"))
    return journal.call_order_problem(events).select("sequence", "problem")


@query(
    """with r as (select user_id as task, event_id as seq, ts, cast(round(value) as bigint) as tokens from events),
    w as (select *, count(*) over (partition by task order by epoch_us(ts) range between 59999999 preceding and current row) as recent, sum(tokens) over t as total, count(*) over t as n from r window t as (partition by task order by seq rows unbounded preceding))
    select seq, case when n > 30 then 'request_budget' when total > 1500 then 'token_budget' when recent > 1 then 'rate_limit' else 'admitted' end as decision from w"""
)
def admission(spark, d):
    requests = read(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), "ts", F.round("value").cast("long").alias("tokens"))
    return journal.admission(requests, budget_tokens=1500, budget_requests=30, per_minute=1).select("seq", "decision")


@query(
    """with c as (select user_id, event_type, event_id, cast(regexp_extract(props, '(\\d+)', 1) as bigint) as lim, value > 50 as truncated from events),
    w as (select *, min(event_id) filter (where not truncated) over p as whole, max(lim) over p as most, arg_max(event_id, (lim, -event_id)) over p as at from c window p as (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding))
    select event_id, coalesce(whole, case when most >= lim then most end) as served from w"""
)
def subsumed_calls(spark, d):
    """Which earlier answer serves a call: the first that was not cut, else one of the greatest limit if that is enough (its limit is given)."""
    calls = read(spark, d, "events").select("user_id", "event_type", "event_id", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("lim"), (F.col("value") > 50).alias("cut"))
    out = journal.first_calls(calls, "user_id", "event_type", "event_id", limit="lim", truncated="cut")
    by = out.alias("c").join(out.select(F.col("event_id").alias("served_by"), F.col("lim").alias("of"), F.col("cut").alias("was_cut")), "served_by", "left")
    return by.select("event_id", F.when(F.col("was_cut"), F.col("of")).otherwise(F.col("served_by")).alias("served"))
