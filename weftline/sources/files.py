"""Corpora of files: folders, archives, and delimited text that is not quite regular."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.workflow import project_of


def workflow_files(spark: SparkSession, folder: str) -> DataFrame:
    """full_path, workflow_file, repo_path, project_id, language, file_size_bytes, content of every *.yml and *.yaml below a folder.

    The language comes from the folder <language>_yml_files. Content is decoded as UTF-8; bytes that
    are none become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml}").load(folder)
    path = F.col("path")
    return files.select(
        path.alias("full_path"),
        F.element_at(F.split(path, "/"), -1).alias("workflow_file"),
        F.regexp_replace(path, "/[^/]*$", "").alias("repo_path"),
        project_of(path).alias("project_id"),
        F.nullif(F.regexp_extract(path, "/([^/]+)_yml_files/", 1), F.lit("")).alias("language"),
        F.col("length").alias("file_size_bytes"),
        F.expr("try_validate_utf8(cast(content as string))").alias("valid"),
        F.expr("make_valid_utf8(cast(content as string))").alias("content"),
    ).drop("valid")


def zipped_files(spark: SparkSession, archives: str) -> DataFrame:
    """archive, path, content (bytes), error of every file in the ZIP archives of a folder.

    An archive that cannot be opened gives one row with a null path; an entry that cannot be read
    (encrypted, damaged, of an unknown method) a row with its path and no content. Both have an error.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(archive, path, content, error):
            return pd.DataFrame({"archive": [archive], "path": [path], "content": [content], "error": [error]})

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    opened = zipfile.ZipFile(io.BytesIO(content))
                except Exception as error:  # whatever the archive holds, the task goes on
                    yield row(archive, None, None, f"{type(error).__name__}: {error}")
                    continue
                with opened as z:
                    for name in z.namelist():
                        if name.endswith("/"):
                            continue
                        try:
                            yield row(archive, name, z.read(name), None)
                        except Exception as error:
                            yield row(archive, name, None, f"{type(error).__name__}: {error}")

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(archives)
    return found.select("path", "content").mapInPandas(entries, "archive string, path string, content binary, error string")


def extract(spark: SparkSession, archives: str, target: str, force: bool = False) -> DataFrame:
    """The files of zipped_files(), kept as a Parquet table at `target`.

    A complete table that is there already is not written again, unless forced.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if force or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        zipped_files(spark, archives).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def without_content(files: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(files without their contents, contents by key): a narrow table for everything that reads no texts, and a side table to join."""
    return files.drop(content), files.select(key, content)


def robust(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Delimited text read in the strictest of four ways that gives the required columns: tabs with quotes, commas with quotes, tabs without quotes, and lines whose surplus cells join the last column.

    Raises ValueError where none does. A byte order mark before the header is dropped.
    """
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0].lstrip("\ufeff") if header else ""
    for separator, quote in (("\t", '"'), (",", '"'), ("\t", "")):
        names = [c.strip().strip(quote or " ").lstrip("\ufeff") for c in line.split(separator)]
        if all(c in names for c in required):
            rows = spark.read.option("header", "true").option("sep", separator).option("quote", quote).option("multiLine", bool(quote)).option("escape", quote or "\\").option("mode", "DROPMALFORMED").csv(path)
            return rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))
    separator = "\t" if line.count("\t") >= line.count(",") else ","
    if line.count(separator) + 1 < len(required):
        raise ValueError(f"no way of reading {path} gives the columns {', '.join(required)}")
    return ragged(spark.read.text(path).where(F.col("value") != F.lit(line)), required, separator)


def delimited(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV or TSV file with cells of several lines; the delimiter is the one its header holds more often.

    Raises ValueError where a required column is missing. A byte order mark before the header is dropped.
    """
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    separator = "\t" if line.count("\t") > line.count(",") else ","
    rows = spark.read.option("header", "true").option("sep", separator).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def ragged(lines: DataFrame, names: list[str], separator: str = "\t") -> DataFrame:
    """The columns `names` of lines of text (column value): what is too many joins the last column, lines with too few cells are left out."""
    n = len(names)
    cells = F.split("value", separator, -1)
    kept = lines.withColumn("c", cells).where(F.size("c") >= n)
    last = F.concat_ws(separator, F.slice("c", n, F.size("c")))
    return kept.select(*(F.col("c")[i].alias(names[i]) for i in range(n - 1)), last.alias(names[-1]))
