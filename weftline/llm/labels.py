"""Step labels of dirty sequences, resolved to the display labels of a catalogue."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import canonical_language
from weftline.sources.tables import table

#: What stands between two labels. Fixed values. Bracketed decorations may hold the same signs, so
#: they are matched first and kept.
SEPARATORS = r"â\x86\x92|â†’|[→⟶➔➜➝⇒⟹»›]|-+>|=+>|>|;"
_SPLIT = re.compile(rf"(\([^()→]*\)|\[[^\[\]→]*\])|(?:{SEPARATORS})")
_BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_NOISE = re.compile(r"^\W*step\s*\d+\s*:|\bv\d+\b|,\s*attempt\s*\d+\s*$")
_NO_LETTER = re.compile(r"[^a-z]")
_BLANK = re.compile(r"[\W_]*", re.UNICODE)
#: Most entries of a catalogue that the driver reads and every task receives.
MAX_CATALOGUE = 20_000


def pieces(sequence: str | None) -> list[str]:
    """The non-blank texts between the separators of `sequence`, in order."""
    if not sequence:
        return []
    found, start = [], 0
    for m in _SPLIT.finditer(sequence):
        if m.group(1) is None:
            found.append(sequence[start : m.start()])
            start = m.end()
    found.append(sequence[start:])
    return [p for p in found if not _BLANK.fullmatch(p)]


def squeeze(label: str) -> str:
    """The letters of a label without width, case, numbering and bracketed decoration."""
    text = unicodedata.normalize("NFKC", label).lower()
    return _NO_LETTER.sub("", _NOISE.sub(" ", _BRACKETED.sub(" ", text)))


def slips(key: str) -> Iterable[str]:
    """`key` with one letter left out, doubled, or swapped with the next."""
    for i in range(len(key)):
        yield key[:i] + key[i + 1 :]
        yield key[:i] + key[i] + key[i:]
        if i + 1 < len(key):
            yield key[:i] + key[i + 1] + key[i] + key[i + 2 :]


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or `most` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


#: Parts of a key; two edits, each of which can touch two neighbouring parts, leave one of them whole.
_PARTS = 5


def _cuts(size: int) -> list[tuple[int, int]]:
    return [(size * i // _PARTS, size * (i + 1) // _PARTS) for i in range(_PARTS)]


class Resolver:
    """Maps spellings to display labels: exact key, then a single slip of one key, then the one nearest key.

    Nearest: within two edits, of a key of fewer than six letters within one. Only keys that share a
    part with the spelling, at about the same place, are measured, so the cost of an unknown spelling
    hardly grows with the catalogue.
    """

    def __init__(self, labels: Iterable[str]):
        self.exact = {squeeze(x): x for x in labels if x}
        self.slip: dict[str, str | None] = {}
        self.parts: dict[tuple[int, int, str], list[str]] = {}
        for key, shown in self.exact.items():
            for s in slips(key):
                self.slip[s] = None if self.slip.get(s, shown) != shown else shown
            for a, b in _cuts(len(key)):
                self.parts.setdefault((len(key), a, key[a:b]), []).append(key)
        self.sizes = {len(key) for key in self.exact}
        self.seen: dict[str, str] = {}

    def __call__(self, label: str) -> str:
        """The display label; a text that resembles none of them stands for itself, trimmed."""
        if (known := self.seen.get(label)) is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[label] = self._find(label)
        return known

    def _near(self, key: str) -> set[str]:
        """The keys that may lie within two edits."""
        found: set[str] = set()
        for size in range(len(key) - 2, len(key) + 3):
            if size in self.sizes:
                for a, b in _cuts(size):
                    for at in range(max(0, a - 2), min(a + 2, len(key) - (b - a)) + 1):
                        found.update(self.parts.get((size, a, key[at : at + b - a]), ()))
        return found

    def _find(self, label: str) -> str:
        key = squeeze(label)
        if found := self.exact.get(key) or self.slip.get(key):
            return found
        most = 2 if len(key) >= 6 else 1
        near = sorted((d, self.exact[k]) for k in self._near(key) if (d := distance(key, k, most)) <= most) if len(key) > 2 else []
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            return near[0][1]
        return unicodedata.normalize("NFKC", label).strip()


def resolve(sequence: Column, labels: list[str]) -> Column:
    """array<string>: the display labels of a sequence; empty for a null or blank one."""
    kept: list[Resolver] = []

    @F.pandas_udf("array<string>")
    def resolved(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Resolver(labels))
        return texts.map(lambda s: [kept[0](p) for p in pieces(s)])

    # not to be evaluated again where a filter on the result is pushed down
    return resolved.asNondeterministic()(sequence)


def catalogue(spark: SparkSession, folder: str) -> list[str]:
    """The display labels of step_labels, in order; refuses a table too large to be a catalogue."""
    rows = table(spark, folder, "step_labels").select("display_label").dropna().distinct().limit(MAX_CATALOGUE + 1).collect()
    if len(rows) > MAX_CATALOGUE:
        raise ValueError(f"step_labels has more than {MAX_CATALOGUE} entries")
    return sorted(r[0] for r in rows)


def latest(rows: DataFrame) -> DataFrame:
    """One row per workflow_id, that with the latest processed_at: workflow_id, language, sequence_id, step_seconds.

    Rows without workflow_id are left out. Ties are broken by the rest of the row, so the result is
    the same however the rows are split. A maximum, so repeated rows of a hot workflow shrink before
    the shuffle.
    """
    rest = ["sequence_id", "language", "step_seconds"]
    return (
        rows.where("workflow_id is not null")
        .groupBy("workflow_id")
        .agg(F.max(F.struct("processed_at", *rest)).alias("last"))
        .select("workflow_id", *(F.col(f"last.{c}").alias(c) for c in rest))
    )


def workflows(spark: SparkSession, folder: str) -> DataFrame:
    """workflow_id, language (canonical or null), labels, step_seconds of every workflow with at least one label."""
    rows = latest(table(spark, folder, "processed_workflows"))
    return rows.select(
        "workflow_id",
        canonical_language(F.col("language")).alias("language"),
        resolve(F.col("sequence_id"), catalogue(spark, folder)).alias("labels"),
        "step_seconds",
    ).where("size(labels) > 0")
