"""Tokens of a YAML stream."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

#: Characters that may not stand anywhere in a stream, and those that only quotes may hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff]")
QUOTED_ONLY = re.compile("[\x7f-\x84\x86-\x9f\ufeff\ufffe\uffff]")

_FLOW = r",\[\]{}"
_BLANKS = re.compile(r"[ \t]*")
_GAP = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\n|$)")
_MARK = re.compile(r"(?:---|\.\.\.)(?=[ \t\n]|$)")
_PLAIN = re.compile(r"(?:[^ \t\n#:]|:(?=[^ \t\n]))(?:[^ \t\n:]|:(?=[^ \t\n]))*(?:[ \t]+(?:[^ \t\n#:]|:(?=[^ \t\n]))(?:[^ \t\n:]|:(?=[^ \t\n]))*)*")
_WORD = rf"(?:[^ \t\n#:{_FLOW}]|:(?=[^ \t\n{_FLOW}]))(?:[^ \t\n:{_FLOW}]|:(?=[^ \t\n{_FLOW}]))*"
_PLAIN_FLOW = re.compile(rf"{_WORD}(?:[ \t]+{_WORD})*")
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_ESCAPE = re.compile(r"\\(?:[0abt\tnvfre \"/\\N_LP\n]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4})?")
_HEADER = re.compile(r"[|>](?:([1-9])[+-]?|[+-]([1-9])?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|$)")
_LABEL = re.compile(rf"[^ \t\n{_FLOW}]+")
_URI = r"(?:%[0-9A-Fa-f]{2}|[0-9A-Za-z\-#;/?:@&=+$_.~*'()"
_TAG = re.compile(rf"!<{_URI},!\[\]])+>|!([0-9A-Za-z-]*)!{_URI}])+|!{_URI}])*")
_DIRECTIVE = re.compile(r"%([^ \t\n]+)([^\n]*)")
_VERSION = re.compile(r"[ \t]+(\d+)\.\d+[ \t]*(?:[ \t]#.*)?$")
_HANDLE = re.compile(r"[ \t]+(!(?:[0-9A-Za-z-]*!)?)[ \t]+(?:!|[^ \t,\[\]{}!])[^ \t]*[ \t]*(?:[ \t]#.*)?$")
#: Longest text that can be a key without a question mark.
LONGEST_KEY = 1024


def tokens(text: str, ends: dict[int, int] | None = None) -> tuple[list[str], list[int]]:
    """The kinds and places of the tokens, in the grammar of yaml_check.

    Line ends must be line feeds. Where the text breaks a rule that tokens cannot show, a token "!"
    stands there and the list ends; "!eof" where a quoted text is not closed. ends, if given, gets
    the end of each token "text" by its place.
    """
    kinds: list[str] = []
    at: list[int] = []
    size = len(text)
    indents = [-1]
    flow: list[str] = []
    keys: list = [None]  # possible key per flow level: (index of token, place, column, line)
    anchors: set[str] = set()
    handles = {"", "!"}
    version = False
    fresh = True  # a block collection or its next entry may begin here
    open_document = False
    pos = line = 0
    start = 0  # of the line
    line_indent = 0
    adjacent = -1  # where a ':' may follow a quoted text or flow collection at once
    quotes: list[tuple[int, int]] = []

    def add(kind: str, place: int) -> None:
        kinds.append(kind)
        at.append(place)

    def bad(place: int, kind: str = "!"):
        add(kind, place)
        return kinds, at

    def unroll(column: int) -> None:
        while indents[-1] > column:
            indents.pop()
            add("end", pos)

    def roll(column: int, kind: str, index: int, place: int) -> None:
        if indents[-1] < column:
            indents.append(column)
            kinds.insert(index, kind)
            at.insert(index, place)

    def possible(place: int) -> None:
        if fresh:
            keys[-1] = (len(kinds), place, place - start, line)

    def deep_enough(a: int, b: int) -> int | None:
        """The place of a line in text[a:b], but for the first, that is not indented enough or is a document marker."""
        need = max(0, indents[-1] + 1)
        p = text.find("\n", a, b)
        while p >= 0:
            p += 1
            q = p
            while q < b and text[q] == " ":
                q += 1
            if q - p < need and text[q] != "\n":
                r = _BLANKS.match(text, q).end()
                if r < size and text[r] != "\n":
                    return q
            if _MARK.match(text, p):
                return p
            p = text.find("\n", p, b)
        return None

    if text.startswith("\ufeff"):
        pos = start = 1
    new_line = True
    while True:
        # to the next token
        tabbed = False
        while True:
            if new_line:
                begin = pos
                while pos < size and text[pos] == " ":
                    pos += 1
                line_indent = pos - begin
                if pos < size and text[pos] == "\ufeff" and begin == pos and not flow and (not open_document or text.startswith("---", pos + 1)):
                    pos += 1
                    start = pos
            blanks = pos
            while pos < size and text[pos] in " \t":
                tabbed = tabbed or text[pos] == "\t"
                pos += 1
            if pos >= size:
                break
            c = text[pos]
            if c == "#" and (new_line or pos > blanks or text[pos - 1] in " \t"):
                pos = text.find("\n", pos)
                if pos < 0:
                    pos = size
                    break
                c = "\n"
            if c != "\n":
                break
            pos += 1
            line += 1
            start = pos
            new_line, tabbed = True, False
            if not flow:
                fresh = True
        if pos >= size:
            if flow:
                break
            unroll(-1)
            break
        column = pos - start
        if new_line and column == 0 and c in "-." and (m := _MARK.match(text, pos)):
            if flow:
                return bad(pos)
            unroll(-1)
            keys[-1] = None
            fresh = new_line = False
            if c == "-":
                add("---", pos)
                open_document = True
                anchors = set()
            else:
                add("...", pos)
                if not (m2 := _GAP.match(text, pos + 3)) or (text[pos + 3 : pos + 4] == "#"):
                    return bad(m.end())
                open_document, version = False, False
                anchors, handles = set(), {"", "!"}
            pos = m.end()
            continue
        if new_line and c == "%" and column == 0 and not open_document and not flow:
            m = _DIRECTIVE.match(text, pos)
            if m[1] == "YAML":
                v = _VERSION.match(m[2])
                if version or not v or int(v[1]) != 1:
                    return bad(pos)
                version = True
            elif m[1] == "TAG":
                if not (h := _HANDLE.match(m[2])):
                    return bad(pos)
                handles.add(h[1].strip("!") if h[1] != "!!" else "!")
            add("%", pos)
            pos = m.end()
            continue
        if not flow:
            if new_line:
                unroll(column if not tabbed else line_indent)
            if tabbed:
                fresh = False
        elif new_line and line_indent <= indents[-1]:
            return bad(pos)
        new_line = False
        if not open_document:
            open_document = True
            if not (kinds and kinds[-1] == "---"):
                anchors = set()
        after = text[pos + 1] if pos + 1 < size else "\n"

        if c in "[{":
            possible(pos)
            add(c, pos)
            flow.append(c)
            keys.append(None)
            fresh = True
            pos += 1
            continue
        if c in "]}" and flow:
            keys.pop()
            flow.pop()
            add(c, pos)
            fresh = False
            pos += 1
            adjacent = pos
            continue
        if c == "," and flow:
            keys[-1] = None
            add(c, pos)
            fresh = True
            pos += 1
            continue
        if c == "-" and after in " \t\n" or c == "-" and flow and after in ",[]{}":
            if flow or not fresh:
                return bad(pos)
            roll(column, "seq", len(kinds), pos)
            keys[-1] = None
            add("-", pos)
            pos += 1
            continue
        if c == "?" and (after in " \t\n" or flow and after in ",[]{}"):
            if not flow:
                if not fresh:
                    return bad(pos)
                roll(column, "map", len(kinds), pos)
            keys[-1] = None
            add("?", pos)
            fresh = not flow
            pos += 1
            continue
        if c == ":" and (after in " \t\n" or flow and (after in ",[]{}" or adjacent == pos)):
            key = keys[-1]
            if key and not (flow and flow[-1] == "{") and (key[3] != line or pos - key[1] > LONGEST_KEY):
                key = None
            if key:
                index, place, where, _ = key
                kinds.insert(index, "?")
                at.insert(index, place)
                if not flow:
                    roll(where, "map", index, place)
                fresh = False
            else:
                if not flow:
                    if not fresh:
                        return bad(pos)
                    roll(column, "map", len(kinds), pos)
                fresh = not flow
            keys[-1] = None
            add(":", pos)
            pos += 1
            continue
        if c == "*" or c == "&":
            m = _LABEL.match(text, pos + 1)
            if not m or c == "*" and m[0] not in anchors:
                return bad(pos)
            possible(pos)
            if c == "&":
                anchors.add(m[0])
            add(c, pos)
            fresh = False
            pos = m.end()
            continue
        if c == "!":
            m = _TAG.match(text, pos)
            if m[1] and m[1] not in handles or m.end() < size and text[m.end()] not in (" \t\n,[]{}" if flow else " \t\n"):
                return bad(pos)
            possible(pos)
            add("tag", pos)
            fresh = False
            pos = m.end()
            continue
        if c in "|>" and not flow:
            m = _HEADER.match(text, pos)
            if not m:
                return bad(pos)
            keys[-1] = None
            add("text", pos)
            parent = indents[-1]
            given = m[1] or m[2]
            inside = max(parent, 0) + int(given) if given else None
            most = 0
            pos, line = m.end(), line + 1
            while pos < size:
                q = pos
                while q < size and text[q] == " ":
                    q += 1
                if q < size and text[q] != "\n":
                    if inside is None:
                        if q - pos <= parent:
                            break
                        inside = q - pos
                        if most > inside:
                            return bad(q)
                    if q - pos < inside or q == pos and _MARK.match(text, pos):
                        break
                elif inside is None:
                    most = max(most, q - pos)
                q = text.find("\n", q)
                pos = q + 1 if q >= 0 else size
                line += 1
            start = pos
            new_line = fresh = True
            if ends is not None:
                ends[at[-1]] = pos
            continue
        if c == "'" or c == '"':
            m = (_SINGLE if c == "'" else _DOUBLE).match(text, pos)
            if not m:
                return bad(size, "!eof")
            possible(pos)
            add("text", pos)
            lines = text.count("\n", pos, m.end())
            if lines:
                if (p := deep_enough(pos, m.end())) is not None:
                    return bad(p)
                line += lines
                start = text.rfind("\n", 0, m.end()) + 1
            if c == '"' and "\\" in m[0]:
                for e in _ESCAPE.finditer(m[0]):
                    if len(e[0]) == 1:
                        return bad(pos + e.start())
            quotes.append((pos, m.end()))
            if ends is not None:
                ends[pos] = m.end()
            fresh = False
            pos = adjacent = m.end()
            continue
        # a plain text
        if c in "-?:":
            if after in " \t\n" or flow and after in ",[]{}":
                return bad(pos)
        elif c in ",[]{}#&*!|>'\"%@`":
            return bad(pos)
        possible(pos)
        add("text", pos)
        fresh = False
        place = pos
        plain = _PLAIN_FLOW if flow else _PLAIN
        pos = plain.match(text, pos).end()
        need = indents[-1] + 1
        while True:
            p = _BLANKS.match(text, pos).end()
            if p >= size or text[p] != "\n":
                break
            lines = 0
            while p < size and text[p] == "\n":
                lines += 1
                first = p + 1
                p = first
                while p < size and text[p] == " ":
                    p += 1
                deep = p - first
                p = _BLANKS.match(text, p).end()
            if p >= size or deep < need or text[p] == "#" or _MARK.match(text, first):
                break
            m = plain.match(text, p)
            if not m:
                break
            pos, line, start = m.end(), line + lines, first
        if ends is not None:
            ends[place] = pos
    first = 1 if text.startswith("\ufeff") else 0
    if QUOTED_ONLY.search(text, first):
        opened = [a for a, _ in quotes]
        for m in QUOTED_ONLY.finditer(text, first):
            p = m.start()
            if not ((k := bisect_left(opened, p)) and p < quotes[k - 1][1]) and not (m[0] == "\ufeff" and text[p - 1] == "\n"):
                place = next((i for i, x in enumerate(at) if x > p), len(at))
                return kinds[:place] + ["!"], at[:place] + [p]
    return kinds, at


class Scalar(NamedTuple):
    """text[start:end] is a value: what stands between its quotes, or from the first to the last sign of a block."""

    start: int
    end: int
    style: str  #: | or > of a block, a quote, or empty
    path: tuple[str, ...]  #: the keys above it, the nearest last
    item: bool  #: an item of a sequence below the nearest key
    name: str | None  #: the value of `name` or `key` in the same mapping, of a scalar under `value`


def _content(text: str, place: int, end: int) -> tuple[int, int, str]:
    style = text[place]
    if style in "'\"":
        return place + 1, end - 1, style
    if style not in "|>":
        return place, end, ""
    first = text.find("\n", place, end)
    body = text[first + 1 : end] if first >= 0 else ""
    start = first + 1 + len(body) - len(body.lstrip())
    return (start, first + 1 + len(body.rstrip()), style) if body.strip() else (end, end, style)


def scalars(text: str) -> list[Scalar]:
    """The values of a YAML stream in order, whole and with their keys; up to the first failure of its tokens."""
    removed: list[int] = []
    if "\r" in text:
        removed = [m.start() - i for i, m in enumerate(re.finditer(r"\r(?=\n)", text))]
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    ends: dict[int, int] = {}
    found: list[tuple[int, int, str, tuple[str, ...], bool, list]] = []
    # of each open collection: whether a mapping, the key, whether the key comes next, items under the key, name and value of siblings
    open_: list[list] = []
    for kind, place in zip(*tokens(text, ends)):
        top = open_[-1] if open_ else None
        if kind in ("map", "{"):
            open_.append([True, None, True, False, {}])
        elif kind in ("seq", "["):
            open_.append([False, None, False, False, {}])
        elif kind in ("end", "]", "}"):
            if open_:
                open_.pop()
        elif kind == "---" or kind == "...":
            open_.clear()
        elif kind == "?" and top:
            top[1], top[2], top[3] = None, True, False
        elif kind == ":" and top:
            top[2] = False
        elif kind == "," and top:
            top[1], top[2] = None, top[0]
        elif kind == "-" and top and top[0]:
            top[3] = True
        elif kind == "text" and place in ends:
            start, end, style = _content(text, place, ends[place])
            if top and top[2]:
                top[1] = text[start:end]
                continue
            if top and not top[3] and top[1] in ("name", "key"):
                top[4].setdefault("name", text[start:end])
            siblings = top[4] if top and not top[3] and top[1] == "value" else {}
            item = bool(top) and (top[3] or not top[0] and top[1] is None)
            found.append((start, end, style, tuple(f[1] for f in open_ if f[1] is not None), item, siblings))
    if not removed:
        return [Scalar(*x[:5], x[5].get("name")) for x in found]
    out, before = [], 0
    for start, end, style, path, item, siblings in found:
        while before < len(removed) and removed[before] < start:
            before += 1
        to = before
        while to < len(removed) and removed[to] < end:
            to += 1
        out.append(Scalar(start + before, end + to, style, path, item, siblings.get("name")))
    return out
