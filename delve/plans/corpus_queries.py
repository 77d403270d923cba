"""Queries over documents as files: searches that read an index, and renames by similarity, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from delve.operators import graph, journal, renames, search_index
from delve.plans.registry import query, read
from delve.sources import journal as journal_source
from delve.sources.stage import numbered, stage_dir
from delve.streaming import accounting, windows

_TERMS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))".format("text")


def _bm25_sql(where: str = "true") -> str:
    return f"""with toks as (select doc_id, {_TERMS} as terms from documents where {where}),
    q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by item_id, term),
    stats as (select count(*) as n, avg(len(terms)) as ml from toks), tf as (select doc_id, any_value(len) as len, term, count(*) as tf from (select doc_id, len(terms) as len, unnest(terms) as term from toks) where term in (select term from q) group by doc_id, term),
    df as (select term, count(*) as df from tf group by term),
    scored as (select item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / ml)) order by term) as score from tf join q using (term) join df using (term) cross join stats group by item_id, doc_id),
    ranked as (select item_id, doc_id, round(score, 6) as score, row_number() over (partition by item_id order by scored.score desc, doc_id) as rank, count(*) over (partition by item_id) > 10 as truncated from scored)
    select item_id, cast(rank as int) as rank, doc_id, score, truncated from ranked where rank <= 10"""


def _index_search(spark, d, group=None):
    index = search_index.build(read(spark, d, "documents"), by="lang")
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    return search_index.search(index, items, 10, group).hits.select(F.col("q").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score", "truncated")


@query(_bm25_sql())
def bm25_index_search(spark, d):
    """The ten best documents of every benchmark item, from one index."""
    return _index_search(spark, d)


@query(_bm25_sql("lang = 'en'"))
def bm25_index_by_kind(spark, d):
    """The same among the documents of one kind, whose statistics are theirs alone."""
    return _index_search(spark, d, "en")


_FILES = """base as (select 'src/' || doc_id as path, text as content from documents where doc_id % 10 <> 3),
    head as (select case when doc_id % 10 = 5 then 'moved/' || doc_id else 'src/' || doc_id end as path,
      case when doc_id % 20 = 5 then regexp_replace(text, '^[^\\n]*\\n', '') when doc_id % 20 = 15 then substr(text, length(text) // 3 + 1) when doc_id % 10 = 6 then text || 'x' else text end as content from documents where doc_id % 10 <> 4),
    ch as (select coalesce(b.path, h.path) as path, coalesce(b.content, h.content) as content, case when b.path is null then 'A' when h.path is null then 'D' when b.content <> h.content then 'M' end as status from base b full join head h on b.path = h.path),
    mv as (select *, row_number() over (partition by content, status order by path) as n from ch where status in ('A', 'D')),
    ex as (select d.path as src, a.path as dst from mv d join mv a on d.content = a.content and d.n = a.n where d.status = 'D' and a.status = 'A'),
    f as (select path, status, content, strlen(content) + 1 as size from mv where path not in (select src from ex) and path not in (select dst from ex)),
    l as (select path, status, line, any_value(size) as size, count(*) * (strlen(line) + 1) as w from (select path, status, size, unnest(string_split(content, chr(10))) as line from f) group by path, status, line),
    p as (select a.path as src, b.path as dst, sum(least(a.w, b.w))::bigint / greatest(any_value(a.size), any_value(b.size)) as similarity from l a join l b on a.line = b.line where a.status = 'D' and b.status = 'A' group by a.path, b.path having sum(least(a.w, b.w)) >= 0.5 * greatest(any_value(a.size), any_value(b.size))),
    e as (select *, row_number() over (order by similarity desc, case when split_part(src, '/', 2) = split_part(dst, '/', 2) then 0 else 1 end, src, dst) as n from p),
    g as (select 0::bigint as n, []::varchar[] as s, []::varchar[] as d, false as took union all
      select e.n, case when ok then list_append(s, src) else s end, case when ok then list_append(d, dst) else d end, ok from (select e.*, g.s, g.d, not list_contains(g.s, e.src) and not list_contains(g.d, e.dst) as ok from g join e on e.n = g.n + 1) e),
    near as (select src, dst, similarity from e join g using (n) where took), pr as (select src, dst, 1.0::double as similarity from ex union all select * from near)"""


@query(f"with recursive {_FILES} select status, path, case when status <> 'A' then path end as old_path, null::double as similarity from ch where status is not null and path not in (select src from pr) and path not in (select dst from pr) union all select 'R', dst, src, round(similarity, 6) from pr")
def renamed_files(spark, d):
    """Documents as the files of two snapshots: some gone, new, changed, or moved with their first line or first third lost."""
    docs, n, moved = read(spark, d, "documents"), F.col("doc_id") % 10, F.col("doc_id") % 20
    own = F.concat(F.lit("src/"), F.col("doc_id").cast("string"))
    base = docs.where(n != 3).select(own.alias("path"), F.col("text").alias("content"))
    path = F.when(n == 5, F.concat(F.lit("moved/"), F.col("doc_id").cast("string"))).otherwise(own)
    late = F.expr("substr(text, length(text) div 3 + 1)")
    content = F.when(moved == 5, F.regexp_replace("text", r"^[^\n]*\n", "")).when(moved == 15, late).when(n == 6, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return renames.renamed(base, docs.where(n != 4).select(path.alias("path"), content.alias("content")))


@query(
    """with recursive nodes as (select p_brand || '/' || p_size % 2 as g, 'p' || p_partkey as node from part), steps as (select 'p' || l_partkey as src, 'p' || lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem),
    e as (select distinct a.g, src, dst from steps join nodes a on a.node = src join nodes b on b.node = dst and b.g = a.g where src <> dst),
    reach as (select src as a, dst as b from e union select reach.a, e.dst from reach join e on e.src = reach.b),
    comp as (select n.g, n.node, coalesce(least(n.node, min(r.b)), n.node) as component from nodes n left join (select x.a, x.b from reach x join reach y on x.a = y.b and x.b = y.a) r on r.a = n.node group by n.g, n.node),
    ce as (select distinct x.component as src, y.component as dst from e join comp x on x.node = e.src join comp y on y.node = e.dst where x.component <> y.component),
    depth as (select distinct component, 0 as d from comp union select ce.src, depth.d + 1 from depth join ce on ce.dst = depth.component),
    lv as (select component, max(d) as level from depth group by component)
    select g as "group", row_number() over (partition by g order by level, component, node) - 1 as position, node, cast(level as int) as level, component from comp join lv using (component)"""
)
def component_order(spark, d):
    """Parts of a brand and of even or odd size, each needing the part that follows it in an order: components of parts that need each other, and the levels between them."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    part = lambda c: F.concat(F.lit("p"), c.cast("string"))
    steps = read(spark, d, "lineitem").select(part(F.col("l_partkey")).alias("src"), part(F.lead("l_partkey").over(own)).alias("dst")).where("dst is not null")
    return graph.layered_order(read(spark, d, "part").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 2).cast("string")).alias("group"), part(F.col("p_partkey")).alias("node")), steps)


@query("select row_number() over (order by event_id) - 1 as sequence, props as payload, (row_number() over (order by event_id) - 1) // 4000 as append, null::varchar as problem from events")
def journal_sink(spark, d):
    """All events appended to one journal in batches of 4,000, each going on from the tail of the one before, 64 in a write; read back and checked."""
    path = f"{stage_dir(spark)}/journal"
    rows = numbered(read(spark, d, "events").select("event_id", F.col("props").alias("payload")), "sequence", "event_id")
    batch, write = 4000, 64 * 4000  # a write's rows are one task's, so they are bounded
    for first in range(0, rows.count(), write):
        journal_source.append(rows.where(F.col("sequence").between(first, first + write - 1)), path, batch)
    log = journal_source.load(spark, path).withColumn("journal", F.lit(0))
    checked = journal.check_chain(log.select("journal", "sequence", "previous", "payload", "sha256", "segment"))
    return checked.select("sequence", "payload", F.expr("cast(regexp_extract(segment, '([0-9]+)', 1) as long) div 4000").alias("append"), "problem")


# Ten kinds of event of small tasks: a user's events of a thousand, dealt to two attempts.
_ACCOUNTS = """with kinds as (select ['started', 'request', 'reserved', 'observed', 'metadata', 'settled', 'unknown', 'response', 'stopped', 'finished'] as names),
    e as (select user_id * 1000000 + event_id // 1000 as task, list_extract(names, cast((event_id // 7 + user_id) % 10 + 1 as int)) as kind, event_id, event_type, value from events cross join kinds),
    x as (select *, case when kind in ('reserved', 'observed', 'metadata', 'settled', 'unknown') then event_id % 2 + 1 end as attempt, case when kind = 'started' then 40 when kind = 'reserved' then cast(floor(value) as bigint) % 30 when event_id % 9 = 0 then null when event_id % 11 = 0 then 9 else 5 end as tokens,
      kind in ('observed', 'metadata', 'settled') and event_id % 9 <> 0 and event_id % 13 <> 0 as usable from e),
    a as (select task, attempt, coalesce(max(tokens) filter (where kind = 'reserved'), 0) as reserved, min(tokens) filter (where usable) as low, max(tokens) filter (where usable) as high,
      bool_or(kind = 'unknown' or kind in ('observed', 'metadata', 'settled') and not usable or kind = 'settled' and event_id % 17 = 0) as doubt, count(*) filter (where kind = 'settled') as settlements from x where attempt is not null group by task, attempt),
    s as (select task, count(*) as attempts, sum(reserved) as reserved, sum(coalesce(high, 0)) as observed, sum(case when settlements > 0 and not doubt and low = high then high else greatest(reserved, coalesce(high, 0)) end) as charged,
      count(*) filter (where low <> high) as conflicts, count(*) filter (where doubt or high is null) as uncertain, count(*) filter (where settlements = 0) as unresolved, count(*) filter (where settlements > 1) as repeated from a group by task),
    t as (select task, count(*) as events, max(case when kind = 'started' then 40 end) as allocation, count(*) filter (where kind = 'request') - count(*) filter (where kind = 'response') as unanswered,
      arg_max(kind, event_id) filter (where kind in ('finished', 'stopped')) as end_kind, arg_max(event_type, event_id) filter (where kind in ('finished', 'stopped')) as why from x group by task),
    j as (select t.*, coalesce(attempts, 0) as attempts, coalesce(reserved, 0) as reserved, coalesce(observed, 0) as observed, coalesce(charged, 0) as charged, coalesce(conflicts, 0) as conflicts, coalesce(uncertain, 0) as uncertain, coalesce(unresolved, 0) as unresolved, coalesce(repeated, 0) as repeated from t left join s using (task))
    select task, events, cast(allocation as bigint) as allocation, attempts, cast(reserved as bigint) as reserved, cast(observed as bigint) as observed, cast(charged as bigint) as charged, conflicts, uncertain, unresolved, repeated, unanswered, coalesce(charged > allocation, false) as over,
    case when conflicts > 0 or end_kind = 'finished' and (unresolved > 0 or uncertain > 0 or unanswered <> 0) then 'FAILED' when end_kind = 'finished' then 'COMPLETED' when end_kind is null then 'UNFINISHED' when why = 'view' then 'CENSORED' when why = 'click' then 'INTERRUPTED' else 'FAILED' end as status,
    case when conflicts > 0 then 'usage_observation_mismatch' when end_kind = 'finished' then case when unresolved > 0 then 'unsettled_attempts' when uncertain > 0 then 'usage_unknown_or_inconsistent' when unanswered <> 0 then 'unanswered_request' else 'task_finished' end
      when end_kind = 'stopped' then case why when 'view' then 'token_limit' when 'click' then 'execution_interrupted' else why end end as reason from j"""


def _account_events(e):
    kinds = F.array(*map(F.lit, ("started", "request", "reserved", "observed", "metadata", "settled", "unknown", "response", "stopped", "finished")))
    rows = e.select("event_id", "event_type", "value", F.expr("user_id * 1000000 + event_id div 1000").alias("task"), F.get(kinds, F.expr("cast((event_id div 7 + user_id) % 10 as int)")).alias("kind"))
    attempt = F.when(F.col("kind").isin("reserved", *accounting.USAGE, "unknown"), (F.col("event_id") % 2 + 1).cast("int"))
    told = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 11 == 0, 9).otherwise(5)
    tokens = F.when(F.col("kind") == "started", 40).when(F.col("kind") == "reserved", F.floor("value") % 30).otherwise(told)
    why = F.when(F.col("event_type") == "view", "token_limit").when(F.col("event_type") == "click", "execution_interrupted").otherwise(F.col("event_type"))
    return rows.select("task", attempt.alias("attempt"), F.col("event_id").alias("sequence"), "kind", tokens.cast("long").alias("tokens"), why.alias("reason"), (F.col("event_id") % 13 != 0).alias("consistent"), (F.col("event_id") % 17 != 0).alias("complete"))


@query(_ACCOUNTS)
def accounts(spark, d):
    return accounting.accounts(_account_events(read(spark, d, "events")))


@query(_ACCOUNTS)
def accounts_stream(spark, d):
    """The same as a stream whose state is an attempt's; of each attempt the last row stands, and a task's account is that of its attempts."""
    source = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    told = windows.run_available(spark, source, lambda e: accounting.attempts_stream(_account_events(e)), "update")
    return accounting.accounts_of(accounting.latest(told, "task", "attempt"))
