"""Operators on code bases as queries: parsing, imports, references, test mapping, changes of snapshots, text functions.

A code base is made of the part table: each part is a Python file of two symbols that imports one shared file; its SQL says what is in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delve.functions import text as T
from delve.operators import extract, graph, mapping, records, table_functions, verify
from delve.plans.registry import query, read
from delve.sources import files as sources
from delve.sources.stage import cut

# The files' texts; {p} stands for the part.
COMMON, COMMON_TEXT = "src/shop/common.py", "def helper(x):\n    return x\n"
BODY = """import os
from shop.common import helper

class C{p}(Base):
    def run(self, x):
        return helper(x)

def f{p}(a, b=1):
    return C{p}()
"""
SETTINGS = """
KEY = os.getenv("KEY{p}", "x")

@app.get("/parts/{p}")
def show{p}():
    return KEY
"""


def _code(spark, d, tasks: int | None = None) -> DataFrame:
    """path, content: a file for each part, in a folder of its size; large parts have a route and a setting; and the shared file.
    tasks: parts are first dealt to so many, as a table of few bytes is a scan of few tasks, and its files are many to parse."""
    p = F.col("p_partkey").cast("string")
    content = F.replace(F.concat(F.lit(BODY), F.when(F.col("p_size") > 25, F.lit(SETTINGS)).otherwise("")), F.lit("{p}"), p)
    path = F.concat(F.lit("src/pkg"), F.col("p_size").cast("string"), F.lit("/m"), p, F.lit(".py"))
    part = read(spark, d, "part").select("p_partkey", "p_size")
    part = part.repartition(tasks, "p_partkey") if tasks else part
    return part.select(path.alias("path"), content.alias("content")).unionByName(spark.createDataFrame([(COMMON, COMMON_TEXT)], "path string, content string"))


_FILES = f"f as (select p_partkey as p, p_size > 25 as large, 'src/pkg' || p_size || '/m' || p_partkey || '.py' as path from part), c as (select '{COMMON}' as path)"


@query(f"with {_FILES} select path, replace(replace(substr(path, 5), '.py', ''), '/', '.') as module, false as is_test from (select path from f union all select path from c)")
def file_records(spark, d):
    files = _code(spark, d)
    return extract.file_records(files, extract.extract_files(files)).where("parse_error is null").select("path", "module", "is_test")


@query(
    f"""with {_FILES} select path || '::' || qualname as id, kind, first, last from (select path, 'C' || p as qualname, 'class' as kind, 4 as first, 6 as last from f union all select path, 'C' || p || '.run', 'method', 5, 6 from f
    union all select path, 'f' || p, 'function', 8, 9 from f union all select path, 'show' || p, 'function', 14, 15 from f where large union all select path, 'helper', 'function', 1, 2 from c)"""
)
def code_symbols(spark, d):
    return extract.symbols(extract.extract_files(_code(spark, d))).select("id", "kind", "first", "last")


@query(
    f"""with {_FILES} select path || '::' || qualname as id, kind, first, last from (select path, 'C' || p as qualname, 'class' as kind, 4 as first, 6 as last from f union all select path, 'C' || p || '.run', 'method', 5, 6 from f
    union all select path, 'f' || p, 'function', 8, 9 from f union all select path, 'show' || p, 'function', 14, 15 from f where large union all select path, 'helper', 'function', 1, 2 from c)"""
)
def code_symbols_sql(spark, d):
    """The same from SQL text, by a table function."""
    table_functions.register(spark)
    _code(spark, d).createOrReplaceTempView("code_files")
    return spark.sql("SELECT s.id, s.kind, s.first, s.last FROM code_files f, LATERAL python_source(f.path, f.content, 'symbols') s")


@query(f"with {_FILES} select path as src, null as dst, 'os' as module, 1 as line from f union all select path, '{COMMON}', 'shop.common', 2 from f")
def code_imports(spark, d):
    files = _code(spark, d)
    return extract.resolve_imports(extract.extract_files(files), files).select("src", "dst", "module", "line")


@query(
    f"""with {_FILES} select path, name, kind, enclosing, target, case when target is null then 'low' else 'high' end as confidence from (
    select path, 'helper' as name, 'call' as kind, 'C' || p || '.run' as enclosing, '{COMMON}::helper' as target from f union all select path, 'C' || p, 'call', 'f' || p, path || '::C' || p from f
    union all select path, 'Base', 'subclass', null, null from f)"""
)
def code_references(spark, d):
    files = _code(spark, d)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = set(extract.REFERENCES) - {"name", "attribute", "decorator"}  # not asked for
    rows = cut(extract.extract_files(_code(spark, d, tasks), kinds))  # read many times, parsed once
    found = extract.resolve_references(rows, files)
    return found.where("kind in ('call', 'subclass') and name not in ('os.getenv', 'app.get')").select("path", "name", "kind", "enclosing", "target", "confidence")


@query(
    f"""with {_FILES} select path, 'route' as kind, '/parts/' || p as name, 'show' || p as detail from f where large union all select path, 'setting', 'KEY' || p, '[REDACTED]' from f where large"""
)
def code_facts(spark, d):
    rows = extract.extract_files(_code(spark, d))
    return extract.facts(rows, "route", "/PARTS/").unionByName(extract.facts(rows, "setting")).select("path", "kind", "name", "detail")


@query(f"with {_FILES} select path, p <> 0 and p < 100 as cosmetic from f where p < 100 union all select path, false from f where p >= 100")
def cosmetic_changes(spark, d):
    """A comment and blanks for some files, another default for the others; the first does not parse."""
    files = _code(spark, d).where(F.col("path") != COMMON)
    p = F.regexp_extract("path", r"m(\d+)\.py$", 1).cast("long")
    new = F.when(p == 0, F.lit("def (")).when(p < 100, F.concat(F.lit("# a comment\n\n"), F.replace("content", F.lit("b=1"), F.lit("b = 1")))).otherwise(F.replace("content", F.lit("b=1"), F.lit("b=2")))
    return extract.cosmetic_changes(files.select("path", F.col("content").alias("old"), new.alias("new")))


@query(f"with {_FILES} select path, 'C' || p || '.run' as qualname, null as problem from f union all select path, 'f' || p, 'required positional parameter added or made mandatory' from f")
def signature_problems(spark, d):
    """Every file's function gets a default less."""
    files = _code(spark, d).where(F.col("path") != COMMON)
    new = files.withColumn("content", F.replace("content", F.lit("b=1"), F.lit("b")))
    both = extract.signatures(files).withColumnRenamed("sig", "old").join(extract.signatures(new).withColumnRenamed("sig", "new"), ["path", "qualname"])
    return both.where("qualname not like 'show%'").select("path", "qualname", verify.signature_problem(F.col("old"), F.col("new")).alias("problem"))


# paths and texts

_PATHS = "p as (select page_id, regexp_extract(url, 'https?://[^/]+/([^?#]*)', 1) || '/m.py' as path from pages)"


def _paths(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"https?://[^/]+/([^?#]*)", 1), F.lit("/m.py")).alias("path"))


@query(
    f"""with {_PATHS} select page_id, replace(replace(regexp_replace(path, '^src/', ''), '.py', ''), '/', '.') as module, 'm.py' as name, path not like '/%' and not list_contains(string_split(path, '/'), '..') and length(path) > 0 as safe,
    path as target_path, 'C.run' as target_name from p"""
)
def path_functions(spark, d):
    path = F.col("path")
    target = T.target_parts(F.concat(path, F.lit("::C.run")))
    return _paths(spark, d).select("page_id", T.module_name(path).alias("module"), T.file_name(path).alias("name"), T.is_safe_path(path).alias("safe"), target["path"].alias("target_path"), target["qualname"].alias("target_name"))


@query(
    r"""select event_id, 'Bearer [REDACTED] api_key=[REDACTED], token: [REDACTED]; user ' || user_id as text from events"""
)
def redacted(spark, d):
    text = F.format_string("bearer abc.%s api_key=k%s, token: sk-%s00000000; user %s", "user_id", "event_id", "event_id", "user_id")
    return read(spark, d, "events").select("event_id", T.redacted(text).alias("text"))


@query(
    """with t as (select distinct lower(w) as term from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark))
    select term, case when term like '%ies' and length(term) > 4 then regexp_replace(term, 'ies$', 'y') when regexp_matches(term, '(ss|x|ch|sh)es$') then regexp_replace(term, 'es$', '')
    when regexp_matches(term, '[^s]s$') and length(term) > 3 then regexp_replace(term, 's$', '') else term end as stem from t"""
)
def stems(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    return words.select(F.lower("w").alias("term")).distinct().select("term", T.stem(F.col("term")).alias("stem"))


@query(
    """with e as (select event_id, case user_id % 3 when 0 then 429 when 1 then 503 else 500 end as status, user_id % 4 as attempt, case when value > 60 then value end as after from events)
    select event_id, case when status <> 500 and attempt < 3 and coalesce(after, pow(2, attempt - 1)) <= 59 then coalesce(after, pow(2, attempt - 1)) end as delay from e"""
)
def retry_delays(spark, d):
    user = F.col("user_id")
    status = F.when(user % 3 == 0, 429).when(user % 3 == 1, 503).otherwise(500)
    return read(spark, d, "events").select("event_id", T.retry_delay(status, user % 4, F.when(F.col("value") > 60, F.col("value"))).alias("delay"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 'n/a' else format('{:.3f}', o_custkey / 8) end as metric from orders")
def metric_texts(spark, d):
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") / 8)
    return read(spark, d, "orders").select("o_orderkey", F.replace(T.metric_text(value), F.lit(","), F.lit("")).alias("metric"))


@query("select conv_id, turn, contains(text, 'the') and contains(text, 'an') as cited from conversations")
def citations(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.cited(F.col("text"), F.array(F.lit("the"), F.lit("an"))).alias("cited"))


# changes


@query(
    """with o as (select l_orderkey as path, l_partkey as symbol, min(l_linenumber) * 10 as first, min(l_linenumber) * 10 + 8 as last from lineitem where l_quantity > 10 group by 1, 2),
    n as (select l_orderkey as path, l_partkey as symbol, min(l_linenumber) * 10 as first, min(l_linenumber) * 10 + 8 as last from lineitem where l_quantity > 12 group by 1, 2),
    h as (select o_orderkey as path, 25 as a, o_custkey % 5 as n from orders),
    t as (select o.path, o.symbol from o join h using (path) where n > 0 and a <= last and a + n - 1 >= first union select n.path, n.symbol from n join h on h.path = n.path where h.n > 0 and a <= last and a + h.n - 1 >= first)
    select path, symbol from o where (path, symbol) not in (select path, symbol from n) union select path, symbol from n where (path, symbol) not in (select path, symbol from o) union select * from t"""
)
def changed_symbols(spark, d):
    def side(least):
        return read(spark, d, "lineitem").where(F.col("l_quantity") > least).groupBy(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("symbol")).agg((F.min("l_linenumber") * 10).alias("first"), (F.min("l_linenumber") * 10 + 8).alias("last"))

    n = F.col("o_custkey") % 5
    hunks = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(25).alias("old_start"), n.alias("old_count"), F.lit(25).alias("new_start"), n.alias("new_count"))
    return verify.changed_symbols(side(10), side(12), hunks)


@query(
    """with f as (select 'app/' || p_brand || '/migrations/' || p_partkey || '.py' as file, p_brand, p_partkey from part where p_size > 10), p as (select distinct p_brand from part)
    select 'app/' || p.p_brand || '/migrations/' as path, arg_min(f.file, f.p_partkey) as file from p join f on f.p_brand = p.p_brand group by p.p_brand"""
)
def migration_match(spark, d):
    part = read(spark, d, "part")
    folder = F.concat(F.lit("app/"), "p_brand", F.lit("/migrations/"))
    changes = part.select(F.concat(folder, F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.when(F.col("p_size") > 10, "A").otherwise("M").alias("status"), F.col("p_partkey").alias("position"))
    return verify.migration_match(part.select(folder.alias("path")).distinct(), changes)


@query(
    """with f as (select case when p_size <= 10 then 'app/' || p_brand || '/migrations' when p_size <= 20 then 'alembic/' || p_brand || '/versions' end as folder, case when p_size <= 10 then 'django' else 'alembic' end as framework, p_partkey from part)
    select framework, folder, string_agg(folder || '/' || p_partkey || '.py', ',' order by folder || '/' || p_partkey || '.py') as files from f where folder is not null group by framework, folder"""
)
def migration_groups(spark, d):
    folder = F.when(F.col("p_size") <= 10, F.concat(F.lit("app/"), "p_brand", F.lit("/migrations/"))).when(F.col("p_size") <= 20, F.concat(F.lit("alembic/"), "p_brand", F.lit("/versions/"))).otherwise("src/")
    files = read(spark, d, "part").select(F.concat(folder, F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return records.migration_groups(files).withColumn("files", F.array_join("files", ","))


@query(
    """with f as (select lower(p_type) || '/' || p_brand || '/m' || p_partkey || '.py' as path, p_size = 1 as bad from part), s as (select l_suppkey as name, count(distinct l_orderkey) as n from lineitem group by l_suppkey),
    o as (select lower(c_mktsegment) as name, count(*) as n from customer group by 1)
    select 'folders' as section, row_number() over (order by name) as place, name, n from (select regexp_extract(path, '^([^/]+/[^/]+)/', 1) as name, count(*) as n from f group by 1)
    union all select * from (select 'hubs', row_number() over (order by n desc, cast(name as varchar) desc) as place, cast(name as varchar), n from s) where place <= 10
    union all select * from (select 'outside', row_number() over (order by n desc, name) as place, name, n from o) where place <= 10
    union all select * from (select 'broken', row_number() over (order by path) as place, path, 1 from f where bad) where place <= 20"""
)
def repository_map(spark, d):
    path = F.concat_ws("/", F.lower("p_type"), "p_brand", F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")))
    files = read(spark, d, "part").select(path.alias("path"), F.when(F.col("p_size") == 1, "bad").alias("parse_error"))
    edges = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.lit("runtime").alias("kind")).distinct()
    imports = read(spark, d, "customer").select(F.lit(None).cast("string").alias("dst"), F.concat(F.lower("c_mktsegment"), F.lit(".x")).alias("module"))
    return records.repository_map(files, graph.fan_in(edges), imports)


@query(
    f"""with {_PATHS}, w as (select page_id, path, len(path) as n, contains(path, '/') and path like '%1%' as two from p)
    select page_id as task_id, path, 0 as position from w union all select page_id, 'old/' || path, 5 from w where two"""
)
def patch_paths(spark, d):
    """A patch of each page's path; some have a second file, then the first again, and a quoted name."""
    path = F.col("path")
    head = lambda x: F.concat(F.lit("diff --git a/"), x, F.lit(" b/"), x, F.lit("\n--- a/"), x, F.lit("\n+++ b/"), x, F.lit("\n@@ -1 +1 @@\n-a"))
    more = F.concat(F.lit("\n"), head(F.concat(F.lit("old/"), path)), F.lit("\n"), head(path), F.lit('\ndiff --git "a/q" "b/q"'))
    both = F.concat(head(path), F.when(F.contains(path, F.lit("/")) & F.contains(path, F.lit("1")), more).otherwise(""))
    return sources.changed_files(_paths(spark, d).select(F.col("page_id").alias("task_id"), both.alias("patch")))


# tests


@query(
    """with s as (select 'src/p' || (p_partkey % 7) || '/m' || p_partkey || '.py' as path, p_partkey as p from part), t as (select 'tests/test_m' || p || '.py' as test_path, path as source_path from s where p % 2 = 0),
    i as (select 'tests/test_m' || a.p_partkey || '.py' as test_path, s.path as source_path, 'imports' as reason from part a join s on s.p = a.p_size),
    r as (select 'tests/test_m' || a.p_partkey || '.py' as test_path, s.path as source_path, 'references' as reason from part a join s on s.p = a.p_partkey where a.p_size > 25),
    e as (select * from i union select * from r union select test_path, source_path, 'naming' from t)
    select test_path, source_path, array_to_string(list_filter(['imports', 'references', 'naming'], lambda x: list_contains(l, x)), ',') as reasons from (select test_path, source_path, list(reason) as l from e group by 1, 2)"""
)
def test_mapping(spark, d):
    part = read(spark, d, "part")
    p = F.col("p_partkey")
    source = lambda k: F.concat(F.lit("src/p"), (k % 7).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py"))
    test = F.concat(F.lit("tests/test_m"), p.cast("string"), F.lit(".py"))
    files = part.select(source(p).alias("path")).unionByName(part.where(p % 2 == 0).select(test.alias("path")))
    known = part.select(p.alias("k"))
    imports = part.join(known, F.col("p_size") == F.col("k")).select(test.alias("src"), source(F.col("k")).alias("dst"))
    return mapping.test_mapping(files, imports, part.where("p_size > 25").select(test.alias("src"), source(p).alias("dst")))


test_mapping.__test__ = False


@query(
    """with e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem where l_quantity > 40), w as (select a, b from e union select b, a from e)
    select w.a as node, count(*) as near from w group by w.a"""
)
def two_way_neighbours(spark, d):
    """One step over edges taken both ways, from every node."""
    edges = read(spark, d, "lineitem").where("l_quantity > 40").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = graph.neighbours(both, both.select(F.col("src").alias("start")).distinct(), 1)
    return found.groupBy(F.col("start").alias("node")).agg(F.count("*").alias("near"))
