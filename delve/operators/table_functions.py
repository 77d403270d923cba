"""Python sources read from SQL text: table functions whose columns follow from what is asked for.

    SELECT s.* FROM files f, LATERAL python_source(f.path, f.content, 'symbols') s
    SELECT * FROM python_files(TABLE(files), 'imports')

python_source takes a file a call, python_files a table with path and content, which it has dealt by path.  what is a constant: symbols, imports or rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from delve.operators.extract import ROWS, extract

#: The columns of each answer, and how a row of extract() makes one; None for rows that are no part of it.
ANSWERS = {
    "symbols": ("id string, kind string, first int, last int", lambda r: (f"{r[0]}::{r[3]}", r[1], r[4], r[5]) if r[1] in ("class", "function", "method") else None),
    "imports": ("path string, module string, level int, line int, names array<string>", lambda r: (r[0], r[2], r[9], r[4], r[8]) if r[1] in ("import", "import_from") else None),
    "rows": (ROWS, lambda r: r),
}


_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}


def _schema(what: AnalyzeArgument) -> StructType:
    if not what.isConstantExpression or what.value not in ANSWERS:
        raise ValueError(f"the last argument must be one of {', '.join(ANSWERS)}")
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split(" ", 1) for x in ANSWERS[what.value][0].split(", "))])


def _answer(path: str | None, content: str | bytes | None, what: str) -> Iterator[tuple]:
    if path is not None and content is not None:
        raw = content.encode("utf-8", "replace") if isinstance(content, str) else bytes(content)
        yield from filter(None, map(ANSWERS[what][1], extract(path, raw)))


@udtf
class PythonSource:
    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_schema(what))

    def eval(self, path, content, what):
        yield from _answer(path, content, what)


@udtf
class PythonFiles:
    @staticmethod
    def analyze(files: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or not {"path", "content"} <= {f.name for f in files.dataType.fields}:
            raise ValueError("the first argument must be a table with path and content")
        return AnalyzeResult(_schema(what), partitionBy=[PartitioningColumn("path")])

    def eval(self, files: Row, what):
        yield from _answer(files["path"], files["content"], what)


def register(spark: SparkSession) -> None:
    spark.udtf.register("python_source", PythonSource)
    spark.udtf.register("python_files", PythonFiles)
