"""Source files that do not parse: YAML streams that are not well-formed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import canonical_language
from weftline.llm.derivatives import Language
from weftline.llm.yaml_tokens import FORBIDDEN, tokens
from weftline.session import spread
from weftline.sources.tables import table


def grammar() -> Language:
    """The language of YAML streams over the tokens of yaml_tokens."""
    g = Language("stream")
    t, n, seq, alt, star, opt, plus = g.token, g.name, g.seq, g.alt, g.star, g.opt, g.plus
    g.rules = {
        # documents: bare, after a marker, after directives and a marker
        "stream": seq(star(t("...")), opt(n("document")), star(alt(seq(plus(t("...")), opt(n("document"))), n("marked")))),
        "document": alt(n("node"), n("marked"), seq(plus(t("%")), n("marked"))),
        "marked": seq(t("---"), opt(n("node"))),
        # nodes
        "marks": alt(seq(t("&"), opt(t("tag"))), seq(t("tag"), opt(t("&")))),
        "node": alt(t("*"), seq(n("marks"), opt(n("content"))), n("content")),
        "content": alt(n("sequence"), n("mapping"), n("flow content")),
        "value": alt(n("node"), n("entries"), seq(n("marks"), n("entries"))),
        # block collections; entries of a sequence may stand as deep as the key they belong to
        "entries": plus(seq(t("-"), opt(n("node")))),
        "sequence": seq(t("seq"), n("entries"), t("end")),
        "pair": alt(seq(t("?"), opt(n("value")), opt(seq(t(":"), opt(n("value"))))), seq(t(":"), opt(n("value")))),
        "mapping": seq(t("map"), plus(n("pair")), t("end")),
        # flow collections
        "flow node": alt(t("*"), seq(n("marks"), opt(n("flow content"))), n("flow content")),
        "flow content": alt(t("text"), n("flow sequence"), n("flow mapping")),
        "flow pair": alt(seq(t("?"), opt(n("flow node")), opt(seq(t(":"), opt(n("flow node"))))), seq(t(":"), opt(n("flow node")))),
        "flow item": alt(n("flow node"), n("flow pair")),
        "flow items": opt(seq(n("flow item"), star(seq(t(","), n("flow item"))), opt(t(",")))),
        "flow sequence": seq(t("["), n("flow items"), t("]")),
        "flow mapping": seq(t("{"), n("flow items"), t("}")),
    }
    return g


_ENDS = re.compile("\r\n?")
_kept: list[Language] = []


def failure(text: str | None) -> tuple[int, str] | None:
    """None for a well-formed YAML stream, null and empty texts; else (line, why).

    why: `character` (one that YAML does not permit), `token` (a text that is no token, or a token
    that cannot stand there), `end` (the text ends too early, as a truncated one does).
    """
    if not text:
        return None
    if not _kept:
        _kept.append(grammar())
    text = _ENDS.sub("\n", text)
    if m := FORBIDDEN.search(text):
        return text.count("\n", 0, m.start()) + 1, "character"
    kinds, places = tokens(text)
    at = _kept[0].failure(kinds)
    if at is None:
        return None
    last = text.rstrip("\n").count("\n") + 1
    if at >= len(kinds) or kinds[at] == "!eof":
        return last, "end"
    return min(last, text.count("\n", 0, places[at]) + 1), "token"


def yaml_failure(text: Column) -> Column:
    """struct<line int, why string>: where and why a text is no YAML stream, or null."""

    @F.pandas_udf("struct<line: int, why: string>")
    def checked(texts: pd.Series) -> pd.DataFrame:
        found = [failure(x) for x in texts]
        return pd.DataFrame({"line": pd.array([f and f[0] for f in found], "Int32"), "why": [f and f[1] for f in found]})

    # not to be evaluated again where a filter on the result is pushed down
    return checked.asNondeterministic()(text)


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, project_id, language, full_path, line, why: the rows of yaml_reference that do not parse."""
    files = spread(table(spark, folder, "yaml_reference").select("workflow_id", "project_id", "language", "full_path", "full_workflow_yaml"))
    rows = files.select("workflow_id", "project_id", canonical_language(F.col("language")).alias("language"), "full_path", yaml_failure(F.col("full_workflow_yaml")).alias("f"))
    return rows.where("f.line is not null").select("workflow_id", "project_id", "language", "full_path", "f.line", "f.why")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id of the files that do not parse."""
    return p4_files(spark, folder).select("workflow_id").distinct()


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """level, project_id, language, files, broken, rate; a file is one workflow_id of a project, null and empty ones included.

    level 0: a language of a project, 1: a project, 2: a language, 3: all files. A column that does not
    belong to the level is null; so is a project_id or language that is not known.
    """
    files = spread(table(spark, folder, "yaml_reference").select("workflow_id", "project_id", "language", "full_workflow_yaml"))
    rows = files.select("workflow_id", "project_id", canonical_language(F.col("language")).alias("language"), yaml_failure(F.col("full_workflow_yaml")).alias("f"))
    files = rows.groupBy("project_id", "language", "workflow_id").agg(F.max(F.expr("cast(f.line is not null as int)")).alias("broken"))
    sums = files.groupingSets([["project_id", "language"], ["project_id"], ["language"], []], "project_id", "language")
    out = sums.agg(F.grouping_id().alias("level"), F.count("*").alias("files"), F.sum("broken").alias("broken"))
    return out.select("level", "project_id", "language", "files", "broken", F.round(F.col("broken") / F.col("files"), 6).alias("rate"))
