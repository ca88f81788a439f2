"""Writing rows, metrics and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import hadoop


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error", mark: bool = False) -> None:
    """CSV with a header; nested values become JSON.  With columns, those only, absent ones empty.

    With ``mark`` each file begins with a byte order mark, for programs that take text without one for a local code.
    """
    cols = columns or df.columns
    got = []
    for c in cols:
        if c not in df.columns:
            got.append(F.lit(None).cast("string").alias(c))
        elif df.schema[c].dataType.typeName() in ("array", "map", "struct"):
            got.append(F.to_json(c).alias(c))
        else:
            got.append(F.col(c))
    out = df.select(*got)
    if mark:
        out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}")
    out.write.mode(mode).csv(path, header=True, escape='"')


def write_json_figures(df: DataFrame, path: str) -> None:
    """A table of figures, which is small by its making (one row a run and beta), as one indented JSON document."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    text = json.dumps(rows[0] if len(rows) == 1 else rows, ensure_ascii=False, indent=2, default=str)
    target, fs = hadoop(df.sparkSession, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_runs(df: DataFrame, path: str, run: str = "run_name", mode: str = "error") -> None:
    """One folder of Parquet files for each run."""
    df.write.mode(mode).partitionBy(run).parquet(path)


def markdown_table(df: DataFrame, rows: int = 50) -> str:
    """A report table of the first rows (the report's own limit)."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    return "\n".join(head + [f"| {' | '.join(map(cell, r))} |" for r in df.limit(rows).collect()])
