"""Small results as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def cell(value: object) -> str:
    """One table cell: three decimals for floats, n/a for nothing, pipes and line breaks escaped."""
    text = "n/a" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", "<br>")


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1000) -> str:
    """A Markdown table of a report-sized result; more than `most` rows are an error, not a cut."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = [names, ["---"] * len(names), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def replace_between(text: str, begin: str, end: str, new: str) -> str:
    """text with what stands between two marks replaced; a mark that is missing is an error."""
    a, b = text.find(begin), text.find(end)
    if a < 0 or b < a:
        raise ValueError("the marks are not there")
    return f"{text[: a + len(begin)]}\n{new}\n{text[b:]}"
