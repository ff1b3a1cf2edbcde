"""What the parsers share: token arrays, faults, panic-mode recovery and precedence climbing.

A lexer fills three arrays: the token's type (keywords and punctuation are their own type; others are ``id``, ``num``,
``str`` and so on), its offset, and whether a line ends before it. A lexical fault is a token of type ``bad``, which no
rule accepts. The last token has the empty type.

Statements are methods; expressions climb a table of precedences. A fault raised anywhere inside a statement ends in
the nearest statement list, which stores it, skips to a token at which a statement can begin or end, and goes on.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from typing import NamedTuple

#: Calls between Python functions use the heap, so depth costs memory only. Nesting beyond this is a fault, as compilers
#: refuse it as well.
RECURSION = 30_000


class Fault(NamedTuple):
    line: int
    message: str


class Broken(Exception):
    """Raised at the token where no rule fits."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Parser:
    """Subclasses give ``lex`` and ``statement``."""

    #: Types that begin a statement; recovery stops at them if they begin a line.
    starters: frozenset[str] = frozenset()
    openers = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, text: str):
        self.text = text
        self.T: list[str] = []
        self.P: list[int] = []
        self.N: list[bool] = []
        self.faults: list[tuple[int, str]] = []
        self.bad: dict[int, str] = {}
        self.refused: set[tuple] = set()
        self.i = 0
        self.lex(text)
        self.T.append("")
        self.P.append(len(text))
        self.N.append(True)

    # -- lexing

    def lex(self, text: str) -> None:
        raise NotImplementedError

    def add(self, kind: str, at: int, newline: bool) -> None:
        self.T.append(kind)
        self.P.append(at)
        self.N.append(newline)

    def add_bad(self, at: int, newline: bool, message: str) -> None:
        self.bad[len(self.T)] = message
        self.add("bad", at, newline)

    def brackets(self) -> dict[int, int]:
        """For each opening bracket its closing one, as far as they nest rightly."""
        pairs, stack = {}, []
        closers = {")": "(", "]": "[", "}": "{"}
        T = self.T
        for i, t in enumerate(T):
            if t in ("(", "[", "{"):
                stack.append(i)
            elif t in closers:
                if stack and T[stack[-1]] == closers[t]:
                    pairs[stack.pop()] = i
                elif stack:
                    stack.pop()
        return pairs

    # -- parsing

    def fail(self, message: str | None = None) -> None:
        t = self.T[self.i]
        raise Broken(self.i, message or self.bad.get(self.i) or (f"unexpected {t!r}" if t else "unexpected end"))

    def expect(self, t: str) -> None:
        if self.T[self.i] != t:
            found = self.T[self.i]
            self.fail(self.bad.get(self.i) or f"expected {t!r}, found {found or 'the end'!r}")
        self.i += 1

    def accept(self, t: str) -> bool:
        if self.T[self.i] == t:
            self.i += 1
            return True
        return False

    def value(self, i: int) -> str:
        """The text of a token that is a word."""
        m = _WORD.match(self.text, self.P[i])
        return m.group() if m else ""

    #: What decides whether a rule fits, besides the place.
    control = False

    def attempt(self, rule) -> bool:
        """Run a rule; where it does not fit, go back. A rule that did not fit at a place is not tried there again, so
        nested attempts cost no more than one each."""
        at, faults = self.i, len(self.faults)
        key = (rule.__qualname__, at, self.control)
        if key in self.refused:
            return False
        try:
            rule()
            if len(self.faults) == faults:
                return True
        except Broken:
            pass
        self.i = at
        del self.faults[faults:]
        self.refused.add(key)
        return False

    def statement(self) -> None:
        raise NotImplementedError

    def statements(self, end: str) -> None:
        """Statements up to the type ``end``, which is not taken; faults are stored here."""
        while True:
            t = self.T[self.i]
            if t == end or not t:
                return
            begin = self.i
            try:
                self.statement()
                if self.i == begin:
                    self.fail()
            except Broken as broken:
                self.store(broken)
                self.recover(max(begin, min(broken.at, len(self.T) - 1)), begin, end)

    def store(self, broken: Broken) -> None:
        self.faults.append((self.P[min(broken.at, len(self.P) - 1)], broken.message))

    def recover(self, at: int, begin: int, end: str) -> None:
        """Panic mode: skip to behind a statement's end, to the end of the list, or to a line that begins a statement."""
        T, N = self.T, self.N
        i = at if at > begin else begin + 1
        if at == begin and T[begin] == ";":
            self.i = begin + 1
            return
        depth = 0
        while T[i]:
            t = T[i]
            if not depth and (t == end or i > begin and N[i] and t in self.starters):
                break
            if t == "{":
                depth += 1
            elif t == "}":
                if not depth:
                    if end != "}":
                        i += 1
                    break
                depth -= 1
                if not depth:
                    i += 1
                    break
            elif t == ";" and not depth:
                i += 1
                break
            i += 1
        self.i = i

    def program(self) -> None:
        self.statements("")

    def check(self) -> list[Fault]:
        """All faults in the order in which they were met."""
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, RECURSION))
        try:
            self.program()
            while self.T[self.i]:
                self.faults.append((self.P[self.i], f"unexpected {self.T[self.i]!r}"))
                self.i += 1
                self.program()
        except Broken as broken:
            self.store(broken)
        except RecursionError:
            self.faults.append((self.P[min(self.i, len(self.P) - 1)], "nested too deeply"))
        finally:
            sys.setrecursionlimit(limit)
        if not self.faults:
            return []
        breaks = [m.start() for m in re.finditer("\n", self.text)]
        return [Fault(1 + bisect_right(breaks, p - 1), message) for p, message in self.faults]


_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
