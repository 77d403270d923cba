"""The query tools over an indexed repository: checked arguments, numbered evidence, structured errors.

Arguments are checked before a plan is built; results are small by their limits and come back as rows, with whether more were left out.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delve.functions.text import one_line
from delve.operators import extract, graph, history, mapping, records, search_index, verify
from delve.sources.files import IndexCache
from delve.sources.stage import cut

LIMITS = {"search_code": 15, "find_references": 40, "get_dependencies": 100, "find_tests": 50, "repo_facts": 200, "co_changed": 10}
FACTS = ("route", "model", "setting", "entry_point", "migration")
#: Lines and characters of source that inspect_symbol shows.
SOURCE_LINES, SOURCE_CHARACTERS = 120, 12_000


@dataclass(frozen=True)
class Result:
    ok: bool
    data: list[dict] = field(default_factory=list)
    error: dict | None = None
    evidence_id: str = ""
    truncated: bool = False


class ToolError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None):
        super().__init__(message)
        self.error = {"code": code, "message": message, "hint": hint}


class Tools:
    """Tools over files (path, content), commits (seq, path) and the difference of two commits (as git_diff gives it).

    The index's tables are written once: into index, an IndexCache with the commit (and digest of a dirty tree) they belong to, or else into the
    session's shared folder.
    """

    def __init__(self, files: DataFrame, commits: DataFrame | None = None, diff: DataFrame | None = None, index: IndexCache | None = None, commit: str = "", dirty: str = ""):
        self.files, self.commits, self.diff = files, commits, diff
        self._keep = (lambda name, build: index.get(name, commit, build, dirty)) if index else (lambda name, build: cut(build()))
        self.rows = self._keep("rows", lambda: extract.extract_files(files))
        self.records = self._keep("records", lambda: extract.file_records(files, self.rows))
        self.symbols = extract.symbols(self.rows)
        self.imports = self._keep("imports", lambda: extract.resolve_imports(self.rows, files))
        self.edges = self._keep("edges", lambda: graph.dependency_edges(self.imports, files))
        self.calls = 0

    @cached_property
    def references(self) -> DataFrame:
        return self._keep("references", lambda: extract.resolve_references(self.rows, self.files))

    @cached_property
    def search_index(self) -> search_index.SearchIndex:
        """Files, symbols and string literals by their terms, built when something is first searched."""
        key = F.concat_ws("|", "kind", "path", F.coalesce("symbol", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("")), F.col("n").cast("string"))
        return search_index.build(self.documents().withColumn("key", key), "key", by="kind", keep=("path", "symbol", "line", "kind", "n", "snippet"))

    def _answer(self, name: str, args: dict[str, Any]) -> tuple[DataFrame, int]:
        tool = getattr(self, f"_{name}", None)
        if tool is None or name not in (*LIMITS, "inspect_symbol", "file_diff"):
            raise ToolError("unknown_tool", f"no tool {name}", ", ".join(LIMITS))
        limit = args.get("limit", LIMITS.get(name, 1))
        if not isinstance(limit, int) or not 1 <= limit <= LIMITS.get(name, limit):
            raise ToolError("invalid_arguments", f"limit must be 1 to {LIMITS.get(name)}")
        try:
            return tool(**args)
        except TypeError as e:
            raise ToolError("invalid_arguments", str(e)) from None

    def frame(self, name: str, **args: Any) -> DataFrame:
        """A tool's rows, at most its limit, as a DataFrame to go on with; what invoke() tells as an error is raised."""
        df, limit = self._answer(name, args)
        return df.limit(limit)

    def invoke(self, name: str, **args: Any) -> Result:
        self.calls += 1
        evidence = f"e{self.calls}"
        try:
            df, limit = self._answer(name, args)
            rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
            was_cut = any(r.pop("cut", False) for r in rows)
            return Result(True, rows[:limit], None, evidence, len(rows) > limit or was_cut)
        except ToolError as e:
            return Result(False, [], e.error, evidence)

    def _closest(self, wanted: str, column: str, table: DataFrame) -> str | None:
        near = difflib.get_close_matches(wanted, [r[0] for r in table.select(column).orderBy(F.levenshtein(F.col(column), F.lit(wanted))).limit(50).collect()], n=3, cutoff=0.3)
        return ", ".join(near) or None

    def _checked(self, path: str) -> str:
        if path.startswith("/") or ".." in path.split("/"):
            raise ToolError("path_outside_repo", path)
        if self.records.where(F.col("path") == path).isEmpty():
            raise ToolError("not_found", path, self._closest(path, "path", self.records))
        return path

    def _symbol(self, name: str) -> dict:
        found = self.symbols.where((F.col("id") == name) | (F.col("name") == name) | (F.col("qualname") == name)).orderBy("id").limit(5).collect()
        exact = [r for r in found if r.id == name]
        if not found:
            raise ToolError("not_found", name, self._closest(name, "name", self.symbols))
        if len(found) > 1 and not exact:
            raise ToolError("ambiguous_name", name, ", ".join(r.id for r in found))
        return (exact or found)[0].asDict()

    def documents(self, kind: str = "any") -> DataFrame:
        """path, symbol, line, kind, n, text, snippet of what is searched: files, symbols and string literals; n tells apart those of one line."""
        none = F.lit(None).cast("string")
        files = self.records.select("path", none.alias("symbol"), F.lit(None).cast("int").alias("line"), F.lit("file").alias("kind"), F.lit(0).alias("n"), F.concat_ws(" ", "path", "module").alias("text"), F.col("path").alias("snippet"))
        snippet, own = F.get("names", F.lit(0)).alias("snippet"), F.concat_ws("::", "path", "qualname")
        symbols = self.rows.where("kind = 'described'").select("path", own.alias("symbol"), "line", F.lit("symbol").alias("kind"), F.col("seq").alias("n"), F.concat_ws(" ", own, "detail").alias("text"), snippet)
        strings = self.rows.where("kind = 'string'").join(self.records.select("path", "module"), "path")
        strings = strings.select("path", none.alias("symbol"), "line", "kind", F.col("seq").alias("n"), F.concat_ws(" ", "path", "module", "detail").alias("text"), snippet)
        both = files.unionByName(symbols).unionByName(strings)
        return both if kind == "any" else both.where(F.col("kind") == kind)

    def _search_code(self, query: str, kind: str = "any", limit: int = 10):
        if kind not in ("any", "file", "symbol", "string"):
            raise ToolError("unsupported_kind", kind)
        if not query.strip():
            raise ToolError("empty_query", "no terms")
        found = search_index.search(self.search_index, self.files.sparkSession.createDataFrame([(0, query)], "q int, text string"), limit, None if kind == "any" else kind, ("path", "symbol", "line", "kind", "n"))
        hits = cut(found.hits)
        if hits.isEmpty():
            raise ToolError("no_results", query)
        shown = hits.orderBy("rank").select("path", "symbol", "line", "kind", "score", one_line(F.col("snippet")).alias("snippet"), F.col("truncated").alias("cut"))
        return shown, limit

    def _inspect_symbol(self, target: str):
        """One symbol with its signature and source, or the outline of a file."""
        described = self.rows.where("kind = 'described'").select(F.concat_ws("::", "path", "qualname").alias("id"), F.get("names", F.lit(0)).alias("signature")).dropDuplicates(["id"])
        known = self.symbols.join(described, "id", "left")
        if "::" in target:
            own = self._symbol(target)
            content = self.files.where(F.col("path") == own["path"]).select("path", F.col("content").cast("string").alias("text"))
            lines = F.split("text", "\r\n|\r|\n")
            found = known.where(F.col("id") == own["id"]).join(content, "path").withColumn("lines", F.slice(lines, F.col("first"), F.col("last") - F.col("first") + 1))
            source = F.array_join(F.slice("lines", 1, SOURCE_LINES), "\n")
            found = found.withColumns({"source": F.substring(source, 1, SOURCE_CHARACTERS), "cut": (F.size("lines") > SOURCE_LINES) | (F.length(source) > SOURCE_CHARACTERS)})
            return found.drop("text", "lines"), 1
        self._checked(target)
        error = self.records.where(F.col("path") == target).first().parse_error
        if error:
            raise ToolError("parse_error", error)
        return known.where(F.col("path") == target).orderBy("first", "id"), 100

    def _file_diff(self, path: str):
        """What a file's change is: status, old path, changed lines on both sides, symbols they touch, and the first hunks as text."""
        if path.startswith("/") or ".." in path.split("/"):
            raise ToolError("invalid_arguments", "file_diff takes a path inside the repository")
        if self.diff is None:
            raise ToolError("not_in_diff", "there is no difference to look into")
        own = self.diff.where((F.col("path") == path) | (F.col("old_path") == path))
        found = own.select("path", "old_path", "status", "binary").limit(1).collect()
        if not found:
            raise ToolError("not_found" if self.records.where(F.col("path") == path).isEmpty() else "not_in_diff", path)
        if found[0].binary:
            raise ToolError("binary_file", path)
        new = self.symbols.select("path", F.col("qualname").alias("symbol"), "first", "last")
        flat = own.select("path", F.explode("hunks").alias("h")).select("path", "h.*")
        touched = new.join(flat, "path").where(verify.overlaps(F.col("new_start"), F.col("new_count"), F.col("first"), F.col("last")))
        changed = touched.groupBy("path").agg(F.array_sort(F.collect_set("symbol")).alias("changed_symbols"))
        ranges = lambda side: F.transform("hunks", lambda h: F.struct(h[f"{side}_start"].alias("start"), h[f"{side}_count"].alias("count")))
        rows = own.select("path", "old_path", "status", ranges("old").alias("old_ranges"), ranges("new").alias("new_ranges"), "snippets", F.col("truncated").alias("cut"))
        return rows.join(changed, "path", "left").withColumn("changed_symbols", F.coalesce("changed_symbols", F.array().cast("array<string>"))), 1

    def _find_references(self, symbol: str, limit: int = 40):
        own = self._symbol(symbol)
        uses = self.references.where(F.col("target") == own["id"]).select("path", "line", "kind", "enclosing", "confidence")
        named = self.imports.where((F.col("dst") == own["path"]) & F.exists("names", lambda n: F.substring_index(n, "=", 1) == own["name"]))
        named = named.select(F.col("src").alias("path"), "line", F.lit("import").alias("kind"), F.lit(None).cast("string").alias("enclosing"), F.lit("high").alias("confidence"))
        both = uses.withColumn("n", F.lit(0)).unionByName(named.withColumn("n", F.lit(1)))
        # of several on one line, in one place and of one kind, the last stands
        last = records.last_wins(both.withColumn("n", F.struct("n", "confidence")), ["path", "line", "enclosing", "kind"], "n")
        return last.select("path", "line", "kind", "enclosing", "confidence").orderBy("path", "line", "kind", F.coalesce("enclosing", F.lit(""))), limit

    def _get_dependencies(self, path: str, direction: str = "imports", depth: int = 1, limit: int = 100):
        if direction not in ("imports", "imported_by") or depth not in (1, 2):
            raise ToolError("invalid_arguments", "direction is imports or imported_by, depth 1 or 2")
        if self.records.where(F.col("module") == path).isEmpty() and not self.imports.where((F.col("module") == path) & F.col("dst").isNull()).isEmpty():
            raise ToolError("external_module", path)
        self._checked(path)
        start = self.records.where(F.col("path") == path).select(F.col("path").alias("start"))
        ways = ("src", "dst") if direction == "imports" else ("dst", "src")
        near = graph.neighbours(self.edges.where("kind = 'runtime'"), start, depth, *ways)
        return near.orderBy("depth", F.split("node", "/")).select("node", "depth"), limit

    def _find_tests(self, target: str, limit: int = 50):
        path = target.partition("::")[0]
        self._checked(path)
        links = self.references.where("target is not null").select(F.col("path").alias("src"), F.substring_index("target", "::", 1).alias("dst"))
        found = mapping.test_mapping(self.files, self.imports.where("dst is not null").select("src", "dst"), links).where(F.col("source_path") == path)
        return found.orderBy("test_path").select("test_path", "reasons"), limit

    def _repo_facts(self, kind: str, contains: str | None = None, limit: int = 200):
        kind = kind.removesuffix("s")
        if kind not in FACTS:
            raise ToolError("unsupported_kind", kind, ", ".join(FACTS))
        if kind == "migration":
            found = records.migration_groups(self.files).select(F.col("folder").alias("path"), F.lit(kind).alias("kind"), F.col("framework").alias("name"), F.lit(None).cast("string").alias("detail"), F.col("files").alias("names"), F.lit(1).alias("line"))
            if contains:
                found = found.where(F.contains(F.lower(F.to_json(F.struct("path", "name", "names"))), F.lit(contains.lower())))
        else:
            found = extract.facts(self.rows, kind, contains)
        if found.isEmpty():
            raise ToolError("none_detected", kind)
        return found.orderBy("path", "line", "name"), limit

    def _co_changed(self, path: str, limit: int = 10):
        self._checked(path)
        if self.commits is None or self.commits.where(F.col("path") == path).isEmpty():
            raise ToolError("no_history", path)
        newest = self.commits.withColumn("seq", -F.col("seq"))  # 0 is the newest
        found = history.co_change(newest, limit=LIMITS["co_changed"] + 1).where(F.col("path") == path)
        if found.isEmpty():
            raise ToolError("no_history", path)
        return found.orderBy("rank").select("partner", "count", "support"), limit
