"""Every operator as a query over the driver's tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.functions import text as T
from delve.operators import graph, history, journal, mapping, metrics, search, search_index, selection, verify
from delve.plans.registry import QUERIES, SQL, query, read
from delve.streaming import ledger, windows

# text ---------------------------------------------------------------------------------------------------------------------------------

_TERMS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))"


@query(f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS.format('text')}) as term from documents) group by doc_id, term")
def tokenize_terms(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("terms"))
    return search_index.term_counts(docs, "terms", "counts").select("doc_id", F.inline("counts")).withColumn("tf", F.col("tf").cast("long"))


def _bm25_sql(by: str = "") -> str:
    on = f" and c.{by} = s.{by}" if by else ""
    grp, own, using = (f"{by}, ", f"c.{by}, ", f", {by}") if by else ("", "", "")
    return f"""
    with toks as (select doc_id, {grp}{_TERMS.format('text')} as terms from documents),
    q as (select term, count(*) as times from (select unnest({_TERMS.format('text')}) as term from benchmark where item_id = (select min(item_id) from benchmark)) group by term),
    stats as (select {grp}count(*) as n, avg(len(terms)) as ml from toks group by {by or 'true'}),
    tf as (select doc_id, {grp}len, term, count(*) as tf from (select doc_id, {grp}len(terms) as len, unnest(terms) as term from toks) where term in (select term from q) group by doc_id, {grp}len, term),
    df as (select {grp}term, count(*) as df from tf group by {grp}term),
    scored as (select c.doc_id, {own}sum(q.times * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * c.tf * 2.5 / (c.tf + 1.5 * (1 - 0.75 + 0.75 * c.len / s.ml)) order by term) as score
      from tf c join q using (term) join df using (term{using}) join stats s on true{on} group by c.doc_id, {own[:-2] or 'true'})"""


def _query_text(spark, d) -> str:
    return read(spark, d, "benchmark").orderBy("item_id").first().text


@query(_bm25_sql() + " select doc_id, round(score, 6) as score, (select count(*) from scored) > 100 as truncated from scored order by scored.score desc, doc_id limit 100")
def bm25_search(spark, d):
    return search.top(search.bm25_scores(read(spark, d, "documents"), _query_text(spark, d)), 100, F.col("doc_id"))


@query(_bm25_sql("lang") + " select lang, doc_id, round(score, 6) as score from scored")
def bm25_by_kind(spark, d):
    scored = search.bm25_scores(read(spark, d, "documents"), _query_text(spark, d), by=["lang"])
    return scored.select("lang", "doc_id", F.round("score", 6).alias("score"))


@query(r"select doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) as snippet, length(text) as original_length, least(length(text), 2000) as used_length, length(text) > 2000 as truncated from documents")
def snippets(spark, d):
    cut = T.truncated(F.col("text"))
    return read(spark, d, "documents").select("doc_id", T.one_line(F.col("text")).alias("snippet"), cut["original_length"].alias("original_length"), cut["used_length"].alias("used_length"), cut["truncated"].alias("truncated"))


@query()
def sanitized_pages(spark, d):
    return read(spark, d, "pages").select("page_id", T.sanitized(F.concat_ws(" ", "url", "html")).alias("text"))


@query(
    r"""select page_id, path, case when ignored then 'ignored' when python and test then 'test_python' when python then 'source_python' else 'other' end as gold_group, test as is_test from
    (select page_id, path, path like '%.py' as python, list_contains(list_slice(parts, 1, len(parts) - 1), 'tests') or name like 'test\_%' escape '\' or name like '%\_test.py' escape '\' as test,
      list_has_any(list_slice(parts, 1, len(parts) - 1), ['doc', 'docs', 'documentation']) or lower(name) like 'readme%' or path like '%.md' as ignored from
    (select page_id, path, string_split(path, '/') as parts, list_extract(string_split(path, '/'), -1) as name from
    (select page_id, (case page_id % 5 when 0 then 'src/' when 1 then 'tests/' when 2 then 'docs/' else '' end) || regexp_extract(url, 'https?://[^/]+/([^?#]*)', 1) ||
      (case page_id % 4 when 0 then '.py' when 1 then '/test_page.py' when 2 then '/readme.md' else '' end) as path from pages)))"""
)
def gold_taxonomy(spark, d):
    folder = F.when(F.col("page_id") % 5 == 0, "src/").when(F.col("page_id") % 5 == 1, "tests/").when(F.col("page_id") % 5 == 2, "docs/").otherwise("")
    end = F.when(F.col("page_id") % 4 == 0, ".py").when(F.col("page_id") % 4 == 1, "/test_page.py").when(F.col("page_id") % 4 == 2, "/readme.md").otherwise("")
    path = F.concat(folder, F.regexp_extract("url", "https?://[^/]+/([^?#]*)", 1), end)
    return read(spark, d, "pages").select("page_id", path.alias("path"), T.gold_group(path).alias("gold_group"), T.is_test_path(path).alias("is_test"))


@query(
    r"""select conv_id, turn, case when regexp_matches(t, '429|rate limit|too many requests') then 'rate_limit' when regexp_matches(t, 'timeout|timed out') then 'timeout'
    when regexp_matches(t, 'context length|maximum context|too many tokens') then 'context_length' when regexp_matches(t, '401|403|unauthorized|api key') then 'authentication'
    when regexp_matches(t, 'json|schema|validation|malformed') then 'malformed_output' when regexp_matches(t, '5\d\d|provider|connection') then 'provider' else 'other' end as kind
    from (select conv_id, turn, lower(text || ' ' || cast(conv_id * 37 % 1000 as varchar)) as t from conversations)"""
)
def failure_kinds(spark, d):
    message = F.concat_ws(" ", "text", (F.col("conv_id") * 37 % 1000).cast("string"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.failure_kind(message).alias("kind"))


@query(
    r"""select page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
    len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as n_links, list_extract(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) as first_link from pages where contains(lower(html), 'article')"""
)
def html_facts(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    pages = read(spark, d, "pages").where(F.contains(F.lower("html"), F.lit("article")))
    return pages.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.get(links, F.lit(0)).alias("first_link"))


# history and graphs --------------------------------------------------------------------------------------------------------------------


def _commits(spark, d) -> DataFrame:
    orders, items = read(spark, d, "orders"), read(spark, d, "lineitem")
    newest = orders.select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("seq")).orderBy(F.desc("seq")).limit(500)
    return items.join(F.broadcast(newest), items["l_orderkey"] == F.col("o_orderkey")).select("seq", F.col("l_partkey").alias("path"))


@query(
    """with commits as (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 500),
    paths as (select distinct l_orderkey as seq, l_partkey as path from lineitem where l_orderkey in (select o_orderkey from commits)),
    each as (select path, count(*) as commits from paths group by path),
    pairs as (select a.path, b.path as partner, count(*) as cnt from paths a join paths b on a.seq = b.seq and a.path <> b.path group by a.path, b.path),
    ranked as (select *, row_number() over (partition by path order by cnt desc, partner) as rnk, count(*) over (partition by path) as partners from pairs)
    select r.path, r.partner, r.cnt as "count", round(r.cnt / e.commits, 6) as support, r.rnk as rank, r.partners > 10 as truncated from ranked r join each e using (path) where r.rnk <= 10"""
)
def co_change(spark, d):
    return history.co_change(_commits(spark, d))


_EVENT_EDGES = """with steps as (select event_type || ':' || cast(cast(regexp_extract(props, '(\\d+)', 1) as bigint) % 10 as varchar) as node, value, user_id, ts, event_id from events),
    moves as (select node as src, lead(node) over (partition by user_id order by ts, event_id) as dst, value >= 50 as type_only from steps),
    edges as (select src, dst, case when min(type_only::int) = 1 then 'type_only' else 'runtime' end as kind from moves where dst is not null and src <> dst group by src, dst)"""


def _event_edges(spark, d) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long") % 10
    steps = read(spark, d, "events").select("user_id", "ts", "event_id", "value", F.concat_ws(":", "event_type", k.cast("string")).alias("src"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return graph.dependency_edges(steps.select("src", F.lead("src").over(own).alias("dst"), (F.col("value") >= 50).alias("type_only")))


@query(_EVENT_EDGES + " select * from edges")
def dependency_edges(spark, d):
    return _event_edges(spark, d)


@query(_EVENT_EDGES + " select dst, count(distinct src) as fan_in from edges where kind = 'runtime' group by dst")
def fan_in(spark, d):
    return graph.fan_in(_event_edges(spark, d))


@query(
    """with e as (select distinct 's' || l_suppkey as s, 'p' || l_partkey as p from lineitem),
    b as (select s as a, p as b from e union select p, s from e), st as (select distinct s as start from e),
    d1 as (select distinct st.start, b.b as node, 1 as depth from st join b on b.a = st.start),
    d2 as (select distinct d1.start, b.b as node, 2 as depth from d1 join b on b.a = d1.node)
    select start, node, min(depth) as depth from (select * from d1 union all select * from d2) where node <> start group by start, node"""
)
def neighbours(spark, d):
    items = read(spark, d, "lineitem")
    edges = items.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.neighbours(both, edges.select(F.col("src").alias("start")).distinct(), 2)


def _keys(spark, d) -> DataFrame:
    """order -> customer -> nation -> region."""
    def edge(df, a, x, b, y):
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))

    orders = edge(read(spark, d, "orders"), "o", "o_orderkey", "c", "o_custkey")
    return orders.unionByName(edge(read(spark, d, "customer"), "c", "c_custkey", "n", "c_nationkey")).unionByName(edge(read(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey"))


@query(
    """with e as (select 'o' || o_orderkey as src, 'c' || o_custkey as dst from orders union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
    r as (select distinct dst as node, 0 as level from e where dst like 'r%'),
    n as (select src as node, max(level) + 1 as level from e join r on e.dst = r.node group by src),
    c as (select src as node, max(level) + 1 as level from e join n on e.dst = n.node where src like 'c%' group by src),
    o as (select src as node, max(level) + 1 as level from e join c on e.dst = c.node where src like 'o%' group by src)
    select * from r union all select * from n union all select * from c union all select * from o"""
)
def topological_levels(spark, d):
    return graph.levels(_keys(spark, d), most=8)


@query()
def dependency_order(spark, d):
    edges = _event_edges(spark, d).select("src", "dst")
    nodes = edges.select(F.substring_index("src", ":", 1).alias("group"), F.col("src").alias("node")).union(edges.select(F.substring_index("dst", ":", 1), "dst")).distinct()
    return graph.dependency_order(nodes, edges)


# evidence ------------------------------------------------------------------------------------------------------------------------------


@query(
    """with ev as (select distinct 'o' || o_orderkey as test_path, 'c' || o_custkey as source_path, 'imports' as reason from orders
    union select distinct 'o' || l_orderkey, 'c' || l_suppkey, 'references' from lineitem
    union select distinct 'o' || event_id, 'c' || user_id, 'naming' from events)
    select test_path, source_path, array_to_string(list_filter(['imports', 'references', 'naming'], lambda x: list_contains(l, x)), ',') as reasons from (select test_path, source_path, list(reason) as l from ev group by test_path, source_path)"""
)
def evidence_mapping(spark, d):
    def pairs(table, a, b, reason):
        return read(spark, d, table).select(F.concat(F.lit("o"), F.col(a).cast("string")).alias("test_path"), F.concat(F.lit("c"), F.col(b).cast("string")).alias("source_path"), F.lit(reason).alias("reason"))

    rows = pairs("orders", "o_orderkey", "o_custkey", "imports").unionByName(pairs("lineitem", "l_orderkey", "l_suppkey", "references")).unionByName(pairs("events", "event_id", "user_id", "naming"))
    return mapping.evidence_mapping(rows)


_LINES_SQL = f"""with lines as (select doc_id as path, unnest(string_split(text, chr(10))) as line from documents),
    hits as (select path, 'line' as kind, len(list_filter({_TERMS.format('line')}, lambda x: x = 'the' or x = 'und')) as n from lines),
    agg as (select path, count(*) as hits, sum(round(n / (n + 1.5), 6)) as score from hits where n > 0 group by path),
    b0 as (select d.doc_id as path, round(coalesce(a.score, 0), 6) as score, coalesce('bm25:line:' || a.hits, '') as reasons from documents d left join agg a on a.path = d.doc_id)"""


def _file_scores(spark, d) -> DataFrame:
    docs = read(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    n = F.size(F.filter(T.tokenize(F.col("line")), lambda t: t.isin("the", "und")))
    scored = lines.select("path", F.lit("line").alias("kind"), (n / (n + 1.5)).alias("score")).where("score > 0")
    return search.file_ranking(scored, docs.select(F.col("doc_id").alias("path")))


@query(_LINES_SQL + " select * from b0")
def file_ranking(spark, d):
    return _file_scores(spark, d).withColumn("reasons", F.array_join("reasons", ","))


_DOC_EDGES = """, edges as (select src, dst from (select doc_id as src, lead(doc_id) over (partition by source order by doc_id) as dst from documents) where dst is not null),
    best as (select max(score) as best from b0), top5 as (select path from b0 where score > 0 order by score desc, path limit 5),
    near as (select dst as path from edges where src in (select path from top5) union select src from edges where dst in (select path from top5)),
    fan as (select dst as path, count(distinct src) as f from edges group by dst)"""


def _doc_edges(spark, d) -> DataFrame:
    own = Window.partitionBy("source").orderBy("doc_id")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("src"), F.lead("doc_id").over(own).alias("dst"), F.lit(False).alias("type_only"))
    return graph.dependency_edges(rows)


@query(_LINES_SQL + _DOC_EDGES + " select b.path, round(b.score + 0.25 * best * (case when n.path is null then 0 else 1 end) + 0.01 * best * least(coalesce(f.f, 0), 10) / 10, 6) as score from b0 b cross join best left join near n on n.path = b.path left join fan f on f.path = b.path")
def structural_ranking(spark, d):
    return graph.structural_boost(_file_scores(spark, d).select("path", "score"), _doc_edges(spark, d))


@query(
    _LINES_SQL
    + """, best as (select max(score) as best from b0), top3 as (select path from b0 where score > 0 order by score desc, path limit 3),
    pairs as (select a.doc_id as path, b.doc_id as partner, round(1.0 / (1 + abs(a.doc_id - b.doc_id)), 6) as support from documents a join documents b on a.source = b.source and a.doc_id <> b.doc_id where abs(a.doc_id - b.doc_id) <= 100),
    gain as (select partner as path, max(support) as s from pairs where path in (select path from top3) group by partner)
    select b.path, round(b.score + best * coalesce(g.s, 0), 6) as score from b0 b cross join best left join gain g on g.path = b.path"""
)
def history_ranking(spark, d):
    ranking = _file_scores(spark, d).select("path", "score")
    # neighbours of one source within 100 ids: pairs meet by source and hundred, so a source's size does not square
    docs = read(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 100).alias("cell"))
    left = docs.select("source", F.col("doc_id").alias("path"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    seeds = ranking.where("score > 0").orderBy(F.desc("score"), "path").limit(3).select("path")
    left = left.join(F.broadcast(seeds), "path", "left_semi")  # three rows
    pairs = left.join(docs.select("source", "cell", F.col("doc_id").alias("partner")), ["source", "cell"])
    gap = F.abs(F.col("path") - F.col("partner"))
    partners = pairs.where((gap > 0) & (gap <= 100)).select("path", "partner", F.round(1.0 / (1 + gap), 6).alias("support"))
    return graph.history_boost(ranking, partners)


# metrics -------------------------------------------------------------------------------------------------------------------------------


def _rankings(spark, d) -> tuple[DataFrame, DataFrame]:
    """ranking: the first ten of each source, as far as the largest cut-off looks; first: the rank of its first labelled document, among all."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    best = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = docs.select("source", "n_chars", "doc_id").withColumn("n", F.row_number().over(best)).where("n <= 10")
    ranking = rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("doc_id").cast("string").alias("id")))), lambda x: x.id).alias("ranking"))
    # counted, not numbered, so no source is sorted whole: the rank is one more than the documents before it
    placed = docs.select("source", "doc_id", F.struct(F.col("n_chars").isNull().alias("none"), (-F.col("n_chars")).alias("size"), "doc_id").alias("place"))
    hit = placed.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.min("place").alias("hit"))
    first = placed.join(hit, "source").groupBy("source").agg((F.count_if(F.col("place") < F.col("hit")) + 1).alias("first"))
    ranking = ranking.join(first, "source", "left")
    gold = docs.join(labels, "doc_id").where("quality = 1").groupBy("source").agg(F.collect_set(F.col("doc_id").cast("string")).alias("gold"))
    return ranking, gold


_RANK_SQL = """with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents), k as (select source, {k} as k from documents group by source),
    g as (select d.source, d.doc_id from documents d join labels l using (doc_id) where l.quality = 1), gn as (select source, count(*) as gold from g group by source),
    h as (select r.source, k.k, count(*) filter (where r.n <= k.k) as predicted, count(g.doc_id) filter (where r.n <= k.k) as hit, count(g.doc_id) filter (where r.n <= 5) as h5, count(g.doc_id) filter (where r.n <= 10) as h10, min(r.n) filter (where g.doc_id is not null) as first
      from r join k using (source) left join g on g.doc_id = r.doc_id group by r.source, k.k),
    m as (select h.*, coalesce(hit / nullif(predicted, 0), 0) as p, coalesce(hit / nullif(gold, 0), 0) as rc, gold from h left join gn using (source))
    select source, round(p, 6) as precision, round(rc, 6) as recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) as f1, round(coalesce(h5 / nullif(gold, 0), 0), 6) as recall_at_5, round(coalesce(h10 / nullif(gold, 0), 0), 6) as recall_at_10,
    round(coalesce(1 / first, 0), 6) as mrr, predicted - hit as false_positives"""


def _scores(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(m, 6).alias(m) for m in metrics.METRICS), F.col("false_positives").cast("long").alias("false_positives"))


@query(_RANK_SQL.format(k="5") + " from m")
def ranking_metrics(spark, d):
    ranking, gold = _rankings(spark, d)
    return _scores(metrics.score_rankings(ranking, gold, ["source"], 5, "first"), "source")


@query(_RANK_SQL.format(k="min(doc_id) % 4") + ", k from m")
def matched_k(spark, d):
    ranking, gold = _rankings(spark, d)
    size = (F.min("doc_id") % 4).cast("int")
    lead = read(spark, d, "documents").groupBy("source").agg(F.when(size > 0, F.sequence(F.lit(1), F.when(size > 0, size).otherwise(1))).otherwise(F.array().cast("array<int>")).alias("ranking"))
    out = metrics.score_rankings(metrics.matched_k(ranking, lead, ["source"]), gold, ["source"], F.col("k"), "first")
    return _scores(out, "source", "k").withColumn("k", F.col("k").cast("long"))


def _runs(spark, d) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.round(F.col("value") * 100).cast("long"))
    return read(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("system"), (F.col("user_id") % 10).cast("string").alias("repository"), (F.dayofyear("ts") % 3).alias("seed"), value.alias("value"))


_RUNS = "runs as (select user_id as task_id, event_type as system, user_id % 10 as repository, case when event_id % 7 = 0 then null else cast(round(value * 100) as bigint) end as value from events), means as (select task_id, system, min(repository) as repository, count(*) as seed_runs, avg(value) as value from runs group by task_id, system)"


@query(f"with {_RUNS} select task_id, system, cast(repository as varchar) as repository, seed_runs, round(value, 6) as value from means")
def seed_means(spark, d):
    return metrics.seed_means(_runs(spark, d), ["value"]).withColumn("value", F.round("value", 6))


@query(f"with {_RUNS} select system, count(*) as tasks, round(avg(value), 6) as value from means group by system")
def system_means(spark, d):
    return metrics.system_means(metrics.seed_means(_runs(spark, d), ["value"]), ["value"]).withColumn("value", F.round("value", 6))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by o_orderpriority")
def status_mix(spark, d):
    return metrics.status_mix(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def _draws_sql(samples: int, seed: int) -> str:
    return f"""names as (select cluster, row_number() over (order by cluster) - 1 as i from (select distinct cluster from sums)), k as (select count(*) as k from names),
    draws as (select s.sample, ('0x' || substr(md5('{seed}:' || s.sample || ':' || d.draw), 1, 8))::bigint % k.k as pick from (select unnest(range({samples})) as sample) s cross join k cross join (select unnest(range(1000)) as draw) d where d.draw < k.k),
    each as (select sample, sum(total) / sum(n) as mean from draws join names on names.i = draws.pick join sums using (cluster) group by sample)"""


@query(
    "with sums as (select c_nationkey as cluster, sum(cast(round(o_totalprice) as bigint)) as total, count(*) as n from orders join customer on o_custkey = c_custkey group by c_nationkey), "
    + _draws_sql(200, 1729)
    + " select (select sum(n) from sums)::bigint as n, round((select sum(total) / sum(n) from sums), 4) as mean, round(quantile_cont(mean, 0.025), 4) as ci_low, round(quantile_cont(mean, 0.975), 4) as ci_high from each"
)
def cluster_bootstrap(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cluster"), F.round("o_totalprice").cast("long").alias("value"))
    out = metrics.cluster_bootstrap(rows, "value", samples=200)
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")))


@query(
    "with means as (select c_custkey as task_id, c_nationkey as cluster, o_orderpriority as system, sum(cast(round(o_totalprice) as bigint)) as value from orders join customer on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '5-LOW') group by 1, 2, 3), "
    "pairs as (select a.cluster, a.value - b.value as diff from means a join means b using (task_id) where a.system = '1-URGENT' and b.system = '5-LOW'), sums as (select cluster, sum(diff) as total, count(*) as n from pairs group by cluster), "
    + _draws_sql(200, 7)
    + ", ci as (select quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from each) select (select sum(n) from sums)::bigint as task_count, round((select sum(total) / sum(n) from sums), 4) as mean_difference, round(lo, 4) as ci_low, round(hi, 4) as ci_high, lo > 0 or hi < 0 as ci_excludes_zero from ci"
)
def paired_bootstrap(spark, d):
    rows = read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    means = rows.groupBy(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("cluster"), F.col("o_orderpriority").alias("system")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("value"))
    out = metrics.paired_bootstrap(means, "1-URGENT", "5-LOW", "value", samples=200, seed=7)
    return out.select("task_count", *(F.round(c, 4).alias(c) for c in ("mean_difference", "ci_low", "ci_high")), "ci_excludes_zero")


@query("select event_type as variant, count(*) filter (where user_id % 5 <> 0) as applicable, count(*) filter (where user_id % 5 = 0) as inapplicable, round(count(*) filter (where user_id % 5 <> 0 and value > 20) / nullif(count(*) filter (where user_id % 5 <> 0), 0), 6) as rate from events group by event_type")
def anomaly_rates(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("variant"), (F.col("user_id") % 5 != 0).alias("applicable"), (F.col("value") > 20).alias("detected"))
    return metrics.detection_rates(rows).withColumn("rate", F.round("rate", 6))


@query(
    """select source as task_id, case when count(*) filter (where not hit and label = '') > 0 then null else round(count(*) filter (where hit or label = 'plausible') / count(*), 6) end as precision
    from (select d.source, l.quality = 1 as hit, case when d.doc_id % 97 = 0 then '' when d.doc_id % 3 = 0 then 'plausible' else 'wrong' end as label from documents d join labels l using (doc_id)) group by source"""
)
def adjudicated_precision(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    label = F.when(F.col("doc_id") % 97 == 0, "").when(F.col("doc_id") % 3 == 0, "plausible").otherwise("wrong")
    found = rows.select(F.col("source").alias("task_id"), (F.col("quality") == 1).alias("hit"), label.alias("label"))
    return metrics.adjudicated_precision(found).withColumn("precision", F.round("precision", 6))


# snapshots -----------------------------------------------------------------------------------------------------------------------------


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    content = F.concat_ws("|", "o_custkey", "o_orderpriority")
    base = orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("path"), F.md5(content).alias("content_hash"))
    head = orders.where("o_orderkey % 10 <> 4").select(
        F.when(F.col("o_orderkey") % 10 == 5, F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey")).alias("path"),
        F.md5(F.concat_ws("|", F.col("o_custkey") + (F.col("o_orderkey") % 10 == 6).cast("int"), "o_orderpriority")).alias("content_hash"),
    )
    return base, head


_SNAP = """with base as (select o_orderkey as path, md5(o_custkey || '|' || o_orderpriority) as h from orders where o_orderkey % 10 <> 3),
    head as (select case when o_orderkey % 10 = 5 then o_orderkey + 1000000000 else o_orderkey end as path, md5((o_custkey + (case when o_orderkey % 10 = 6 then 1 else 0 end)) || '|' || o_orderpriority) as h from orders where o_orderkey % 10 <> 4),
    ch as (select coalesce(b.path, h.path) as path, coalesce(b.h, h.h) as content, case when b.path is null then 'A' when h.path is null then 'D' when b.h <> h.h then 'M' end as status from base b full join head h on b.path = h.path),
    mv as (select *, row_number() over (partition by content, status order by path) as n from ch where status in ('A', 'D')),
    pr as (select d.path as src, a.path as dst from mv d join mv a on d.content = a.content and d.n = a.n where d.status = 'D' and a.status = 'A')"""


@query(
    _SNAP
    + """ select status, path, case when status <> 'A' then path end as old_path from ch where status is not null and path not in (select src from pr) and path not in (select dst from pr) union all select 'R', dst, src from pr"""
)
def snapshot_diff(spark, d):
    return verify.snapshot_diff(*_snapshots(spark, d))


@query(
    """with changed as (select distinct l_partkey as path from lineitem where l_orderkey % 50 = 0), pred as (select distinct l_partkey as path from lineitem where l_orderkey % 101 = 0),
    e as (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber) as dst from lineitem),
    near as (select dst as path from e where src in (select path from pred) and dst is not null union select src from e where dst in (select path from pred))
    select path, case when path in (select path from pred) then 'expected' when path in (select path from near) then 'adjacent' else 'unexpected' end as category,
    case when path in (select path from pred) then 'expected' when path in (select path from near) then 'base_graph' end as reason from changed"""
)
def classify_changes(spark, d):
    items = read(spark, d, "lineitem")
    part = lambda c: items.where(c).select(F.col("l_partkey").alias("path")).distinct()
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")  # lines of one number are many; their order must not hang on that of the rows
    edges = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(own).alias("dst")).where("dst is not null")
    return verify.classify_changes(part("l_orderkey % 50 = 0"), part("l_orderkey % 101 = 0"), edges)


@query(
    """with pred as (select o_orderkey as path, case o_orderstatus when 'F' then 'high' when 'O' then 'low' else 'medium' end as confidence from orders where o_orderkey % 7 = 0), ch as (select distinct l_orderkey as path from lineitem where l_quantity > 45)
    select path, confidence from pred where confidence in ('high', 'medium') and path not in (select path from ch)"""
)
def missing_predictions(spark, d):
    confidence = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("medium")
    predictions = read(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("path"), confidence.alias("confidence"))
    return verify.missing_predictions(predictions, read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("path")).distinct())


@query(
    """with ch as (select c_custkey as path from customer where c_acctbal < 2000), m as (select distinct o_orderkey + 10000000 as test_path, o_custkey as source_path from orders where o_custkey in (select path from ch)),
    done as (select distinct source_path from m where (test_path - 10000000) % 3 = 0)
    select source_path, count(*) as tests from m where source_path not in (select source_path from done) group by source_path"""
)
def missing_tests(spark, d):
    changed = read(spark, d, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("path"))
    orders = read(spark, d, "orders")
    tests = orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 10_000_000).alias("path"))
    owned = orders.select((F.col("o_orderkey") + 10_000_000).alias("test_path"), F.col("o_custkey").alias("source_path"))
    own = owned.join(changed.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    out = verify.missing_tests(changed.unionByName(tests), own)
    return out.select("source_path", F.size("tests").cast("long").alias("tests"))


@query(
    """with broken as (select c_custkey as symbol, c_nationkey as path from customer where c_acctbal < 0), refs as (select o_orderkey % 25 as caller, o_custkey as symbol from orders)
    select distinct r.caller, r.symbol from refs r join broken b using (symbol) where r.caller <> b.path and r.caller not in (select n_nationkey from nation where n_regionkey = 1)"""
)
def stale_callers(spark, d):
    broken = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").cast("long").alias("path"))
    refs = read(spark, d, "orders").select((F.col("o_orderkey") % 25).alias("caller"), F.col("o_custkey").alias("symbol"))
    changed = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("path"))
    return verify.stale_callers(broken, refs, changed)


# selections ----------------------------------------------------------------------------------------------------------------------------


@query("select p_partkey, p_brand, turn from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as turn from part) order by turn, p_brand, p_partkey limit 40")
def round_robin(spark, d):
    return selection.round_robin(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], limit=40).withColumn("turn", F.col("turn").cast("long"))


@query()
def capped_round_robin(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repository"), F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large").alias("bucket"))
    return selection.capped_round_robin(rows, ["small", "middle", "large"], target=40, cap=5)


@query(
    """with t as (select n_name as task_id, row_number() over (order by n_name) - 1 as place from nation), s as (select unnest(range(2)) as j), i as (select unnest(range(3)) as i), k as (select ['x', 'y', 'z'] as names),
    llm as (select t.place * 8 + 2 + s.j * 3 + i.i as position, task_id, list_extract(names, cast((i.i + t.place + s.j) % 3 + 1 as int)) as system, case s.j when 0 then 17 else 42 end as seed from t cross join s cross join i cross join k)
    select position, task_id, system, seed from llm union all select place * 8, task_id, 'a', null from t union all select place * 8 + 1, task_id, 'b', null from t"""
)
def rotated_schedule(spark, d):
    return selection.rotated_schedule(read(spark, d, "nation").select(F.col("n_name").alias("task_id")), ["a", "b"], ["x", "y", "z"], [17, 42])


# logs ----------------------------------------------------------------------------------------------------------------------------------


@query(
    """with recursive r as (select user_id as journal, row_number() over (partition by user_id order by event_id) - 1 as sequence, props as payload from events),
    c as (select journal, sequence, payload, repeat('0', 64) as previous, sha256(repeat('0', 64) || chr(10) || payload) as sha256 from r where sequence = 0
      union all select r.journal, r.sequence, r.payload, c.sha256, sha256(c.sha256 || chr(10) || r.payload) from c join r on r.journal = c.journal and r.sequence = c.sequence + 1),
    k as (select journal, sequence, previous, sha256, case when (journal + sequence) % 50 = 1 then 'changed' else payload end as payload from c)
    select journal, sequence, case when sha256 <> sha256(previous || chr(10) || payload) then 'altered_event' end as problem from k"""
)
def journal_checks(spark, d):
    """The whole chain of each user's events, hashed and checked; some payloads are altered in between."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, d, "events").select(F.col("user_id").alias("journal"), (F.row_number().over(own) - 1).alias("sequence"), F.col("props").alias("payload"))
    altered = F.pmod(F.col("journal") + F.col("sequence"), F.lit(50)) == 1
    chain = journal.chained(rows).withColumn("payload", F.when(altered, "changed").otherwise(F.col("payload")))
    return journal.check_chain(chain).select("journal", "sequence", "problem")


@query("select event_id, count(*) over w as window_count, sum(cast(round(value * 100) as bigint)) over w as window_sum from events window w as (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row)")
def rate_window(spark, d):
    rows = read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return journal.trailing_window(rows, "user_id", "ts", 3600, "cents").select("event_id", "window_count", "window_sum")


_ENDS = "case o_orderpriority when '1-URGENT' then 'token_limit' when '2-HIGH' then 'execution_interrupted' else 'provider_error' end"


@query(
    f"""with a as (select l_orderkey as task, l_linenumber as attempt, max(cast(l_quantity as bigint)) as reserved, max(case when l_discount > 0.005 then cast(l_quantity as bigint) - 1 end) as o1,
      max(case when l_tax > 0.075 and l_discount > 0.085 then cast(l_quantity as bigint) + 5 end) as o2, count(distinct o) as n, bool_or(l_returnflag <> 'R' or l_quantity > 10) as settled, bool_and(case when o is not null then l_quantity < 50 end) as fits
      from (select *, unnest([case when l_discount > 0.005 then cast(l_quantity as bigint) - 1 end, case when l_tax > 0.075 and l_discount > 0.085 then cast(l_quantity as bigint) + 5 end]) as o from lineitem) group by 1, 2),
    s as (select task, count(*) as attempts, sum(reserved)::bigint as reserved, sum(coalesce(greatest(o1, o2), 0))::bigint as observed, sum(coalesce(greatest(o1, o2), reserved))::bigint as charged,
      count(*) filter (where n > 1) as conflicts, count(*) filter (where n = 0) as unknown, bool_and(settled) as settled, bool_and(coalesce(fits, true) and n > 0) as known from a group by task),
    e as (select s.*, case o_orderstatus when 'F' then 'completed' when 'O' then 'stopped' end as kind, {_ENDS} as why from s left join orders on o_orderkey = task)
    select task, attempts, reserved, observed, charged, conflicts, unknown,
    case when conflicts > 0 then 'FAILED' when kind = 'completed' then case when settled and known then 'COMPLETED' else 'FAILED' end when kind is null then 'UNFINISHED' when why = 'token_limit' then 'CENSORED' when why = 'execution_interrupted' then 'INTERRUPTED' else 'FAILED' end as status,
    case when conflicts > 0 then 'usage_observation_mismatch' when kind = 'completed' then case when not settled then 'unsettled_attempts' when not known then 'usage_unknown_or_inconsistent' else 'task_finished' end when kind = 'stopped' then why end as reason from e"""
)
def accounting(spark, d):
    """Orders are tasks and their lines attempts; usage that is unknown, conflicts or does not add up, and ends of each kind."""
    lines, n = read(spark, d, "lineitem"), F.col("l_quantity").cast("long")
    own = [F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("attempt")]

    def event(kind, tokens, where=None):
        made = F.struct(F.lit(kind).alias("kind"), tokens.cast("long").alias("tokens"))
        return F.when(F.expr(where), made) if where else made

    told = F.array_compact(F.array(event("reserved", n), event("observed", n - 1, "l_discount > 0.005"), event("observed", n + 5, "l_tax > 0.075 and l_discount > 0.085"), event("settled", F.lit(None), "l_returnflag <> 'R' or l_quantity > 10")))
    events = lines.select(*own, F.lit(0).alias("sequence"), F.explode(told).alias("e"), (F.col("l_quantity") < 50).alias("consistent"))
    events = events.select("task", "attempt", "sequence", "e.kind", "e.tokens", F.lit(None).cast("string").alias("reason"), "consistent")
    why = F.when(F.col("o_orderpriority") == "1-URGENT", "token_limit").when(F.col("o_orderpriority") == "2-HIGH", "execution_interrupted").otherwise("provider_error")
    ends = read(spark, d, "orders").where("o_orderstatus in ('F', 'O')").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    ends = ends.select(F.col("o_orderkey").alias("task"), F.lit(None).cast("int").alias("attempt"), F.lit(1).alias("sequence"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("stopped").alias("kind"), F.lit(None).cast("long").alias("tokens"), F.when(F.col("o_orderstatus") == "O", why).alias("reason"), F.lit(None).cast("boolean").alias("consistent"))
    return journal.accounting(events.unionByName(ends))


@query("select event_id, min(event_id) over (partition by user_id, event_type order by event_id rows between unbounded preceding and 1 preceding) as served_by from events")
def repeated_calls(spark, d):
    return journal.first_calls(read(spark, d, "events"), "user_id", "event_type", "event_id").select("event_id", "served_by")


@query(
    """select conv_id, turn, last_value(case when role <> 'user' then role end ignore nulls) over w as phase, last_value(case when length(text) % 5 = 0 then 'e' || turn end ignore nulls) over w as last_error from conversations
    window w as (partition by conv_id order by turn rows between unbounded preceding and current row)"""
)
def timeline(spark, d):
    rows = read(spark, d, "conversations")
    event = F.when(F.col("role") == "assistant", "explore").when(F.col("role") == "system", "seed").otherwise("other")
    error = F.when(F.length("text") % 5 == 0, F.concat(F.lit("e"), F.col("turn").cast("string")))
    out = journal.timeline(rows.select("conv_id", F.col("turn").alias("seq"), event.alias("event"), error.alias("error")), "conv_id")
    return out.select("conv_id", F.col("seq").alias("turn"), F.replace(F.replace("phase", F.lit("explore"), F.lit("assistant")), F.lit("seed"), F.lit("system")).alias("phase"), "last_error")


@query()
def ledger_replay(spark, d):
    e = read(spark, d, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "suspected").when(F.col("event_type") == "error", "rejected").otherwise("confirmed")
    rows = e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("seq"), F.regexp_extract("props", r"(\d)\}", 1).alias("target"), status.alias("status"), F.lit(True).alias("ok"), (F.col("event_id") % 11 != 0).alias("touches"), (F.col("value") > 2).alias("strong"), F.lit(True).alias("latest"))
    return ledger.replay(rows)


# windows -------------------------------------------------------------------------------------------------------------------------------


def _stream(spark, d) -> DataFrame:
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern: a stream's plain path must be a folder


@query("select epoch_us(time_bucket(interval '1 hour', ts)) as window_start, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents from events group by 1, 2")
def tumbling_windows(spark, d):
    return windows.tumbling(read(spark, d, "events"))


@query("select epoch_us(time_bucket(interval '30 minutes', ts)) - o * 1800000000 as window_start, event_type, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents from events cross join (select unnest([0, 1]) as o) group by 1, 2")
def sliding_windows(spark, d):
    return windows.tumbling(read(spark, d, "events"), "1 hour", "30 minutes")


@query(
    """with g as (select user_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as new from events),
    s as (select user_id, t, sum(new) over (partition by user_id order by t rows unbounded preceding) as id from g)
    select user_id, min(t) as session_start, max(t) + 1800000000 as session_end, count(*) as n from s group by user_id, id"""
)
def session_windows(spark, d):
    return windows.sessions(read(spark, d, "events"))


@query(SQL["tumbling_windows"])
def tumbling_stream(spark, d):
    return windows.run_available(spark, _stream(spark, d), windows.tumbling)


from delve.plans import code_queries, corpus_queries, record_queries, tool_queries  # noqa: E402, F401  (they add theirs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
