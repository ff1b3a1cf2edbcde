"""Strict JSON."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Parser

_TOKEN = re.compile(
    r"([ \t\n\r]*)(?:([{}\[\],:])"
    r"|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))"
    r"|((?:true|false|null)(?!\w))|([^ \t\n\r])|\Z)"
)


class Json(Parser):
    def lex(self, text: str) -> None:
        at = 1 if text.startswith("﻿") else 0
        T, P, N = self.T, self.P, self.N
        match = _TOKEN.match
        while True:
            m = match(text, at)
            k, at = m.lastindex, m.end()
            if k == 1:
                return
            if k == 2:
                T.append(m[2])
            elif k == 3:
                T.append("str")
            elif k < 6:
                T.append("value")
            else:
                self.bad[len(T)] = "unterminated string or bad escape" if m[6] == '"' else f"invalid character {m[6]!r}"
                T.append("bad")
                if m[6] == '"':
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end
            P.append(m.end(1))
            N.append("\n" in m[1])

    def program(self) -> None:
        if not self.T[self.i] and not self.faults:
            if self.text.strip(" \t\r\n﻿"):
                self.fail()
            return  # an empty file is no fault
        self.value_()
        if self.T[self.i]:
            self.fail()

    def value_(self) -> None:
        """Iterative, as values nest without bound."""
        T, stack = self.T, []
        i = self.i
        while True:
            t = T[i]
            if t == "{":
                i += 1
                if T[i] == "}":
                    i += 1
                else:
                    i = self.key(i)
                    stack.append("{")
                    continue
            elif t == "[":
                i += 1
                if T[i] == "]":
                    i += 1
                else:
                    stack.append("[")
                    continue
            elif t == "str" or t == "value":
                i += 1
            else:
                self.i = i
                self.fail()
            while stack:  # behind a value
                t = T[i]
                if t == ",":
                    i += 1
                    if stack[-1] == "{":
                        i = self.key(i)
                    break
                if t == ("}" if stack[-1] == "{" else "]"):
                    stack.pop()
                    i += 1
                else:
                    self.i = i
                    self.fail()
            else:
                self.i = i
                return

    def key(self, i: int) -> int:
        if self.T[i] != "str" or self.T[i + 1] != ":":
            self.i = i if self.T[i] != "str" else i + 1
            self.fail("expected a key in double quotes" if self.T[i] != "str" else "expected ':'")
        return i + 2
