"""Parsing with derivatives.

The derivative of a language by a token is what may follow once that token has been read. A stream
belongs to the language if, derived by each of its tokens, the language still holds the empty
stream. Expressions are shared (equal ones are one object) and remember their derivatives, so a token
costs one look-up wherever the parser has been in the same situation before.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Shared expressions remembered; beyond this only those that the parser still holds live on.
MOST = 200_000


class Expression:
    """token(a), name(a), a then b, one of the parts a, any number of a, nothing, or no stream at all.

    Its parts are shared, so it is told from others by their numbers alone, however deep it is.
    """

    __slots__ = ("kind", "a", "b", "number", "after", "empty")

    def __init__(self, kind: str, a, b, number: int):
        self.kind, self.a, self.b, self.number = kind, a, b, number
        self.after: dict[str, Expression] = {}
        self.empty: bool | None = None


class Language:
    """A grammar: rules by name, each an expression of token(), name(), seq(), alt(), star(), opt(), plus().

    No rule may begin with itself, directly or behind parts that can be empty.
    """

    def __init__(self, start: str):
        self.start = start
        self.rules: dict[str, Expression] = {}
        self.shared: dict[tuple, Expression] = {}
        self.made = 0
        self.NONE, self.EMPTY = self._one("none"), self._one("empty")

    def _one(self, kind: str, a=None, b=None) -> Expression:
        key = (kind, *(tuple(x.number for x in p) if isinstance(p, tuple) else p.number if isinstance(p, Expression) else p for p in (a, b)))
        if (known := self.shared.get(key)) is None:
            self.made += 1
            known = self.shared[key] = Expression(kind, a, b, self.made)
        return known

    def token(self, kind: str) -> Expression:
        return self._one("token", kind)

    def name(self, rule: str) -> Expression:
        return self._one("name", rule)

    def seq(self, *parts: Expression) -> Expression:
        out = self.EMPTY
        for p in reversed(parts):
            out = self._then(p, out)
        return out

    def _then(self, a: Expression, b: Expression) -> Expression:
        if a is self.NONE or b is self.NONE:
            return self.NONE
        if a is self.EMPTY:
            return b
        if b is self.EMPTY:
            return a
        if a.kind == "seq":
            return self._then(a.a, self._then(a.b, b))
        return self._one("seq", a, b)

    def alt(self, *parts: Expression) -> Expression:
        flat: dict[int, Expression] = {}
        for p in parts:
            for q in p.a if p.kind == "alt" else (p,):
                if q is not self.NONE:
                    flat[q.number] = q
        if len(flat) < 2:
            return next(iter(flat.values()), self.NONE)
        return self._one("alt", tuple(flat[k] for k in sorted(flat)))

    def star(self, x: Expression) -> Expression:
        return self._one("star", x)

    def opt(self, x: Expression) -> Expression:
        return self.alt(x, self.EMPTY)

    def plus(self, x: Expression) -> Expression:
        return self.seq(x, self.star(x))

    def nullable(self, x: Expression) -> bool:
        """Whether the empty stream belongs to x."""
        chain = []
        while x.empty is None and x.kind == "seq" and self.nullable(x.a):
            chain.append(x)
            x = x.b
        if x.empty is None:
            if x.kind == "alt":
                x.empty = any(map(self.nullable, x.a))
            elif x.kind == "name":
                x.empty = self.nullable(self.rules[x.a])
            else:  # of a sequence the first part is not
                x.empty = x.kind in ("empty", "star")
        for y in chain:
            y.empty = x.empty
        return x.empty

    def derive(self, x: Expression, kind: str) -> Expression:
        """What may follow `kind` in x; NONE if x holds no stream that begins with it."""
        if (known := x.after.get(kind)) is None:
            what = x.kind
            if what == "token":
                known = self.EMPTY if x.a == kind else self.NONE
            elif what == "seq":
                known = self._then(self.derive(x.a, kind), x.b)
                if self.nullable(x.a):
                    known = self.alt(known, self.derive(x.b, kind))
            elif what == "alt":
                known = self.alt(*(self.derive(p, kind) for p in x.a))
            elif what == "star":
                known = self._then(self.derive(x.a, kind), x)
            elif what == "name":
                known = self.derive(self.rules[x.a], kind)
            else:
                known = self.NONE
            x.after[kind] = known
        return known

    def _forget(self) -> None:
        """Starts the memory afresh; what is still in use is kept by its users, and the rules forget what followed them."""
        self.shared = {}
        todo, seen = [*self.rules.values(), self.NONE, self.EMPTY], set()
        while todo:
            x = todo.pop()
            if x.number not in seen:
                seen.add(x.number)
                x.after = {}
                todo.extend(p for part in (x.a, x.b) for p in (part if isinstance(part, tuple) else (part,)) if isinstance(p, Expression))
                key = (x.kind, *(tuple(q.number for q in p) if isinstance(p, tuple) else p.number if isinstance(p, Expression) else p for p in (x.a, x.b)))
                self.shared[key] = x

    def failure(self, kinds: Iterable[str]) -> int | None:
        """None if the stream belongs to the language; else the number of the first token that cannot
        stand where it stands, or the number of tokens if the stream ends too early."""
        state, i = self.rules[self.start], -1
        none = self.NONE
        for i, kind in enumerate(kinds):
            if (after := state.after.get(kind)) is None:
                after = self.derive(state, kind)
                if len(self.shared) > MOST:
                    self._forget()
            if after is none:
                return i
            state = after
        return None if self.nullable(state) else i + 1
