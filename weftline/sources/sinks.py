"""Sinks: CSV that is read back and compared, quarantine tables, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> int:
    """Writes a CSV with every field quoted and reads it back; ValueError if rows or columns differ. Returns the number of rows.

    With `bom` the first column's name begins with a byte order mark, as spreadsheets expect. The rows
    are computed once. Every row is compared by a hash of its texts; nulls and empty texts, and kinds
    of line ends, are the same to a CSV.
    """
    if len(set(rows.columns)) < len(rows.columns):
        raise ValueError("column names repeat")
    rows = cut(rows)
    out = rows.withColumnRenamed(rows.columns[0], "﻿" + rows.columns[0]) if bom else rows
    out.write.mode("errorifexists").option("header", "true").option("quoteAll", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    back = rows.sparkSession.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    plain = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r\n?", "\n")
    marks = lambda df: df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(i), plain(F.col(f"`{c}`"))).cast("decimal(38,0)")) for i, c in enumerate(df.columns))).first()
    want, got = marks(rows), marks(back)
    if got != want or [c.lstrip("\ufeff") for c in back.columns] != rows.columns:
        raise ValueError(f"wrote {want[0]} rows of {rows.columns}, read {got[0]} of {back.columns}, or other texts")
    return got[0]


def quarantine(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, skipped with reason, errors with error) of files with a parsed `doc`."""
    status = F.col("doc.status")
    skipped = files.where(status.isin("empty", "not_mapping", "missing_jobs")).select(F.col(path).alias("file"), F.concat_ws(": ", status, F.col("doc.error")).alias("reason"))
    errors = files.where(status.isin("parse_error", "extract_error")).select(F.col(path).alias("file"), F.col("doc.error").alias("error"))
    return files.where(status == "ok"), skipped, errors


def report(title: str, summary: DataFrame, most: int = 1000) -> str:
    """A text table of a small result; more than `most` rows are refused, not cut."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = [list(summary.columns), *([("" if v is None else str(v)) for v in r] for r in rows)]
    widths = [max(len(line[i]) for line in cells) for i in range(len(summary.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip() for line in cells]
    return "\n".join(["=" * len(title), title, "=" * len(title), lines[0], "  ".join("-" * w for w in widths), *lines[1:], ""])
