"""Column functions over text and paths.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Lower-cased ASCII terms: acronyms, camel case, snake case, dots and slashes are cut; order and repeats are kept."""
    cut = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    cut = F.regexp_replace(cut, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(cut, F.lit("[A-Za-z0-9]+"), 0), F.lower)


def one_line(text: Column, limit: int = 200) -> Column:
    """White space collapsed to single blanks, ends trimmed, at most limit characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def truncated(text: Column, limit: int = 2000) -> Column:
    """struct(text, original_length, used_length, truncated)."""
    used = F.substring(text, 1, limit)
    return F.struct(used.alias("text"), F.length(text).alias("original_length"), F.length(used).alias("used_length"), (F.length(text) > limit).alias("truncated"))


def sanitized(text: Column) -> Column:
    """Names of files, slashed paths, dotted names of three parts or more, and dotted names after from or import, as [PATH]; URLs stay."""
    file = r"(?<![\w/:.-])(?:[\w.-]+/)*[\w-]+\.(?:py|pyi|toml|cfg|ini|json|ya?ml|md|rst|txt)\b"
    slashed = r"(?<![\w/:.-])(?:[\w.-]+/){1,}[\w.-]+"
    dotted = r"(?<![\w/:.@-])[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){2,}"
    text = F.regexp_replace(text, file, "[PATH]")
    text = F.regexp_replace(text, slashed, "[PATH]")
    text = F.regexp_replace(text, dotted, "[PATH]")
    return F.regexp_replace(text, r"\b(from|import)\s+[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", "$1 [PATH]")


def path_parts(path: Column) -> Column:
    """Sorts as path objects do: part by part, so that a/b.py comes before a-b.py."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_name(path: Column) -> Column:
    """Dotted module of a Python file: a leading src and a final __init__ are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", ""), "/")
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.array_join(parts, ".")


def is_test_path(path: Column) -> Column:
    """A folder named tests, or a file named test_… or …_test.py."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.array_contains(F.slice(parts, 1, F.size(parts) - 1), "tests") | name.startswith("test_") | name.endswith("_test.py")


# What is not judged as source.
DOC_FOLDERS = ("doc", "docs", "documentation")
NAME_STARTS = ("readme", "changelog", "changes", "history", "news", "license", "contributing")
LOCK_NAMES = ("poetry.lock", "uv.lock", "pipfile.lock", "pdm.lock", "package-lock.json", "yarn.lock")
GENERATED_ENDS = ("_pb2.py", "_pb2_grpc.py", ".generated.py", ".min.js")
TEXT_ENDS = (".md", ".rst")


def is_ignored_path(path: Column, texts_too: bool = False) -> Column:
    """Documentation, change logs, lock files, generated code and CI settings; with texts_too every .md and .rst file as well."""
    parts = F.transform(F.split(path, "/"), F.lower)
    name = F.element_at(parts, -1)
    out = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, DOC_FOLDERS))) | name.isin(*LOCK_NAMES) | path.startswith(".github/")
    for x in NAME_STARTS:
        out = out | name.startswith(x)
    for x in (*GENERATED_ENDS, *(TEXT_ENDS if texts_too else ())):
        out = out | name.endswith(x)
    return out


def gold_group(path: Column) -> Column:
    """ignored, test_python, source_python or other; ignored comes first."""
    python = path.endswith(".py")
    return F.when(is_ignored_path(path, texts_too=True), "ignored").when(python & is_test_path(path), "test_python").when(python, "source_python").otherwise("other")


def is_safe_path(path: Column) -> Column:
    """Relative, and without a step up."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & (F.length(path) > 0)


def target_parts(target: Column) -> Column:
    """struct(path, qualname) of path::qualname; qualname is null without the mark."""
    at = F.instr(target, "::")
    return F.struct(
        F.when(at > 0, F.substring_index(target, "::", 1)).otherwise(target).alias("path"),
        F.when(at > 0, F.substr(target, at + 2)).alias("qualname"),
    )


def redacted(text: Column) -> Column:
    """Bearer tokens, sk- keys and values assigned to secret names, as [REDACTED]."""
    text = F.regexp_replace(text, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    text = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]{8,}", "[REDACTED]")
    return F.regexp_replace(text, r"(?i)((?:api_?key|secret|token|password)\s*[=:]\s*)[^\s,;\"']+", "$1[REDACTED]")


def redacted_map(values: Column) -> Column:
    """A string map with the values of secret names masked."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike("key|secret|token|password|authorization"), F.lit("[REDACTED]")).otherwise(redacted(v)))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern the lower-cased text matches."""
    low, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(otherwise)


# Failures, the most specific first.
FAILURES = [
    ("rate_limit", "429|rate limit|too many requests"),
    ("timeout", "timeout|timed out"),
    ("context_length", "context length|maximum context|too many tokens"),
    ("authentication", "401|403|unauthorized|api key"),
    ("malformed_output", "json|schema|validation|malformed"),
    ("provider", "5\\d\\d|provider|connection"),
]


def failure_kind(message: Column) -> Column:
    return first_match(message, FAILURES, "other")


def cited(context: Column, citations: Column) -> Column:
    """Every citation is a part of the context."""
    return F.forall(citations, lambda c: F.contains(context, c))


def metric_text(value: Column) -> Column:
    """Three decimals, or n/a."""
    return F.coalesce(F.format_number(value, 3), F.lit("n/a"))


def stem(term: Column) -> Column:
    """Plural folding of one term."""
    return (
        F.when(term.rlike("ies$") & (F.length(term) > 4), F.regexp_replace(term, "ies$", "y"))
        .when(term.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(term, "es$", ""))
        .when(term.rlike("[^s]s$") & (F.length(term) > 3), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


def retry_delay(status: Column, attempt: Column, retry_after: Column, most: int = 3, longest: int = 59) -> Column:
    """Seconds until the next attempt of a 429 or 503 answer; null when there is none."""
    wait = F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt - 1))
    return F.when(status.isin(429, 503) & (attempt < most) & (wait <= longest), wait)
