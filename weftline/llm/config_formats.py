"""Values of configuration texts with the paths of their keys and their places: YAML with JSON in it, INI, properties and env files."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from weftline.llm.yaml_tokens import Scalar, scalars

_SECTION = re.compile(r"[ \t]*\[([^\[\]\r\n]+)\][ \t]*(?:[#;][^\r\n]*)?\r?(?:\n|$)")
_ENTRY = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+)?[\"']?([A-Za-z_][\w.\-/]*)[\"']?[ \t]*([=:])[ \t]*")
_REST = re.compile(r"[ \t]*(?:[#;!][^\r\n]*)?\r?(?:\n|$)")
_QUOTED = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'[^'\n]*')[ \t]*(?:[#;][^\r\n]*)?\r?(?:\n|$)", re.S)
#: A line, and those that a backslash at its end adds.
_PLAIN = re.compile(r"(?:[^\\\r\n]+|\\(?!\r?\n)|\\\r?\n|\r(?!\n))*")
_COMMENT = re.compile(r"[ \t]+[#;][^\r\n]*$")
_HERE = re.compile(r"<<-?[ \t]*([\"']?)([A-Za-z_]\w*)\1[^\n]*\n")


def entries(text: str, start: int = 0, end: int | None = None, above: tuple[str, ...] = ()) -> tuple[list[Scalar], bool] | None:
    """The values of text[start:end] if all its lines are sections, keys with values, comments or blank; else None.

    Keys are split at dots, and stand below their section and `above`. A value in quotes may hold line
    ends, a plain one goes on behind a backslash at the end of its line. Places are those in `text`.
    With the values comes whether it begins with a section or all keys have equals signs: else the text
    may as well be YAML.
    """
    end = len(text) if end is None else end
    at, section, found, equal, headed = start, (), [], True, False
    while at < end:
        if m := _REST.match(text, at, end):
            if m.end() == at:
                break
            at = m.end()
        elif m := _SECTION.match(text, at, end):
            headed = headed or not found
            section, at = tuple(m[1].strip(" \"'").split(".")), m.end()
        elif m := _ENTRY.match(text, at, end):
            path, first, equal = above + section + tuple(p for p in m[1].split(".") if p), m.end(), equal and m[2] == "="
            if q := _QUOTED.match(text, first, end):
                found.append(Scalar(first + 1, q.end(1) - 1, text[first], path, False, None))
                at = q.end()
            else:
                p = _PLAIN.match(text, first, end)
                value = _COMMENT.sub("", p[0]).rstrip()
                found.append(Scalar(first, first + len(value), "", path, False, None))
                at = p.end()
        else:
            return None
    return found, bool(found) and (equal or headed)


def _inside(text: str, value: Scalar) -> Iterator[Scalar]:
    """Settings written inside a value of several lines: the whole of it, or the documents that its commands write."""
    if found := entries(text, value.start, value.end, value.path):
        yield from found[0]
        return
    at, missing = value.start, set()
    while m := _HERE.search(text, at, value.end):
        at = m.end()
        stop = None if m[2] in missing else re.compile(rf"^[ \t]*{m[2]}[ \t]*\r?$", re.M).search(text, at, value.end)
        if stop is None:
            missing.add(m[2])
            continue
        if found := entries(text, at, stop.start(), value.path):
            yield from found[0]
        at = stop.end()


def settings(text: str) -> list[Scalar]:
    """The values of a text in order, with the keys above them and their places.

    A text that is an INI, properties or env file throughout is read as such, any other as YAML, which
    holds JSON; broken YAML is read up to its failure. Values of several lines are searched for
    settings of their own, whose paths go on below the key of the value.
    """
    if (found := entries(text)) and found[1]:
        return found[0]
    out = []
    for value in scalars(text):
        out.append(value)
        if text.find("\n", value.start, value.end) >= 0:
            out.extend(_inside(text, value))
    return out


def enclosing(values: list[Scalar]) -> list[int]:
    """Of each of the values, in order, the number of the one it stands in, or -1."""
    out, open_ = [], []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]].end <= v.start:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def holder(values: list[Scalar], around: list[int], place: int) -> Scalar | None:
    """The innermost of the values, in order and with enclosing(), that holds a place."""
    i = bisect_right(values, place, key=lambda s: s.start) - 1
    while i >= 0 and place >= values[i].end:
        i = around[i]
    return values[i] if i >= 0 else None
