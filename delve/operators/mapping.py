"""Which tests belong to which sources, from three kinds of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delve.functions.text import file_name, is_test_path

REASONS = ("imports", "references", "naming")


def evidence_mapping(evidence: DataFrame, keys: tuple[str, str] = ("test_path", "source_path")) -> DataFrame:
    """One row for each pair of keys of evidence (keys, reason), with its reasons in their fixed order, joined by commas."""
    kept = evidence.groupBy(*keys).agg(F.collect_set("reason").alias("own"))
    fixed = F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains("own", r))
    return kept.select(*keys, F.array_join(fixed, ",").alias("reasons"))


def naming_evidence(files: DataFrame) -> DataFrame:
    """test_path, source_path where test_x.py or x_test.py names the only source of stem x."""
    stem = F.regexp_replace(file_name(F.col("path")), r"\.py$", "")
    rows = files.select("path", is_test_path(F.col("path")).alias("test"), stem.alias("stem"))
    only = rows.where(~F.col("test")).groupBy("stem").agg(F.min("path").alias("source_path"), F.count("*").alias("n")).where("n = 1")
    tests = rows.where("test").select(F.col("path").alias("test_path"), F.regexp_replace(F.regexp_replace("stem", "^test_", ""), "_test$", "").alias("stem"))
    return tests.join(only, "stem").select("test_path", "source_path", F.lit("naming").alias("reason"))


def test_mapping(files: DataFrame, imports: DataFrame, references: DataFrame) -> DataFrame:
    """files (path), imports (src, dst) and references (src, dst): the evidence of all three kinds, merged.  Type-only imports count."""
    test = is_test_path(F.col("test_path")) & ~is_test_path(F.col("source_path"))
    linked = [x.select(F.col("src").alias("test_path"), F.col("dst").alias("source_path"), F.lit(r).alias("reason")).where(test) for x, r in ((imports, "imports"), (references, "references"))]
    return evidence_mapping(linked[0].unionByName(linked[1]).unionByName(naming_evidence(files)))


def tests_of(mapping: DataFrame, target: str, symbol: str | None = None) -> DataFrame:
    """The tests of a source path, one row for each test symbol (or one null), with whether it references the target symbol."""
    rows = mapping.where(F.col("source_path") == target).select("test_path", "reasons", F.explode_outer("test_symbols").alias("test_symbol"), "source_symbols")
    return rows.select("test_path", "test_symbol", "reasons", F.coalesce(F.array_contains("source_symbols", F.lit(symbol)), F.lit(False)).alias("references_target"))
