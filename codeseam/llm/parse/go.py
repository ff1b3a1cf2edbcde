"""Go."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Broken, Parser

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"((?:[ \t\r\n]+|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*)(?:"
    r"([^\W\d]\w*)"
    r"|((?:0[xX](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*\.?(?:[eE][+-]?\d+)?)i?(?!\w))"
    r"|(\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`)"
    r"|('(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[()\[\]{},;.:=+\-*/%&|^<>!~])"
    r"|([\s\S])|\Z)"
)
_ENDS_LINE = frozenset("id num str break continue fallthrough return ++ -- ) ] }".split())
PRECEDENCE = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_TYPE_START = frozenset("id * [ map chan func struct interface ( <-".split())


class Go(Parser):
    """``control`` is set in the head of a control clause, where no composite literal begins with a bare name."""

    starters = frozenset("func var const type import if for switch select return go defer break continue".split())

    def lex(self, text: str) -> None:
        at = 1 if text.startswith("﻿") else 0
        T, P, N = self.T, self.P, self.N
        match, keywords = _TOKEN.match, KEYWORDS
        while True:
            m = match(text, at)
            k = m.lastindex
            gap = m[1]
            newline = "\n" in gap
            start, at = m.end(1), m.end()
            if T and T[-1] in _ENDS_LINE and (newline or k == 1):
                T.append(";")
                P.append(start)
                N.append(newline)
            if k == 1:
                return
            if k == 2:
                w = m[2]
                T.append(w if w in keywords else "id")
            elif k == 6:
                T.append(m[6])
            elif k == 3:
                T.append("num")
                if m[3][0] == "0" and m[3].replace("_", "").isdigit() and any(c in "89" for c in m[3]):
                    T[-1] = "bad"
                    self.bad[len(T) - 1] = "invalid digit in an octal number"
            elif k in (4, 5):
                T.append("str")
            else:
                c = m[7]
                self.bad[len(T)] = "unterminated literal or bad escape" if c in "\"'`" else f"invalid character {c!r}"
                T.append("bad")
                if c in "\"'":
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end
                elif c == "`":
                    at = len(text)
            P.append(start)
            N.append(newline)

    def skip(self) -> None:
        """A statement's end."""
        if self.T[self.i] == ";":
            self.i += 1
        elif self.T[self.i] not in (")", "}", ""):
            self.fail()

    # -- declarations

    def program(self) -> None:
        if not self.T[0] or self.T == [";", ""]:
            self.i = len(self.T) - 1
            return
        if self.i == 0:
            try:
                self.expect("package")
                self.expect("id")
                self.skip()
            except Broken as broken:
                self.store(broken)
                self.recover(max(self.i, 1), 0, "")
        self.statements("")

    imports = True

    def statement(self) -> None:
        if self.level:
            return self.inner()
        t = self.T[self.i]
        if t == ";":
            self.i += 1
            return None
        if t != "import":
            self.imports = False
        elif not self.imports:
            self.fail("imports come first")
        if t == "func":
            self.i += 1
            if self.T[self.i] == "(":
                self.parameters()
            self.expect("id")
            if self.T[self.i] == "[":
                self.type_parameters()
            self.signature()
            if self.T[self.i] == "{":
                self.block()
            return self.skip()
        if t in ("import", "const", "var", "type"):
            return self.declaration()
        self.fail("a declaration is expected")

    level = 0

    def declaration(self) -> None:
        kind = self.T[self.i]
        self.i += 1
        one = {"import": self.import_, "const": self.const, "var": self.var, "type": self.type_declaration}[kind]
        self.first = True
        if self.accept("("):
            while self.T[self.i] != ")":
                if self.accept(";"):
                    continue
                one()
                self.first = False
                if self.T[self.i] != ")":
                    self.expect(";")
            self.i += 1
        else:
            one()
        self.skip()

    def import_(self) -> None:
        if self.T[self.i] in ("id", "."):
            self.i += 1
        self.expect("str")

    def names(self) -> None:
        self.expect("id")
        while self.accept(","):
            self.expect("id")

    def const(self) -> None:
        self.names()
        typed = self.T[self.i] in _TYPE_START
        if typed:
            self.type()
        if self.accept("="):
            self.expressions()
        elif self.first or typed:
            self.fail("a constant needs a value")

    def var(self) -> None:
        self.names()
        if self.T[self.i] != "=":
            self.type()
            if self.T[self.i] != "=":
                return
        self.i += 1
        self.expressions()

    def type_declaration(self) -> None:
        self.expect("id")
        if self.T[self.i] == "[":
            at = self.i

            def generic() -> None:
                self.type_parameters()
                if self.T[self.i] not in _TYPE_START and self.T[self.i] != "=":
                    self.fail()

            if not (self.T[at + 1] == "id" and self.T[at + 2] != "]" and self.attempt(generic)):
                self.i = at
        self.accept("=")
        self.type()

    def type_parameters(self) -> None:
        self.expect("[")
        while self.T[self.i] != "]":
            self.names()
            self.constraint()
            if self.T[self.i] != "]":
                self.expect(",")
        self.i += 1

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type()
            if not self.accept("|"):
                return

    # -- types

    def type(self) -> None:
        T = self.T
        t = T[self.i]
        self.i += 1
        if t == "id":
            if T[self.i] == ".":
                self.i += 1
                self.expect("id")
            if T[self.i] == "[" and T[self.i + 1] != "]":
                self.i += 1
                while T[self.i] != "]":
                    self.type()
                    if T[self.i] != "]":
                        self.expect(",")
                self.i += 1
        elif t == "*":
            self.type()
        elif t == "(":
            self.type()
            self.expect(")")
        elif t == "[":
            if T[self.i] == "...":
                self.i += 1
            elif T[self.i] != "]":
                self.outside(self.expression)
            self.expect("]")
            self.type()
        elif t == "map":
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif t == "chan":
            self.accept("<-")
            self.type()
        elif t == "<-":
            self.expect("chan")
            self.type()
        elif t == "func":
            self.signature()
        elif t == "struct":
            self.struct()
        elif t == "interface":
            self.interface()
        else:
            self.i -= 1
            self.fail()

    def struct(self) -> None:
        T = self.T
        self.expect("{")
        while T[self.i] != "}":
            if self.accept(";"):
                continue
            if T[self.i] == "*" or T[self.i] == "id" and T[self.i + 1] in (".", ";", "str", "}") or T[self.i] == "(":
                self.type()
            elif T[self.i] == "id" and T[self.i + 1] == "[":

                def field() -> None:
                    self.names()
                    self.type()

                if not self.attempt(field):
                    self.type()
            else:
                self.names()
                self.type()
            self.accept("str")
            if T[self.i] != "}":
                self.expect(";")
        self.i += 1

    def interface(self) -> None:
        T = self.T
        self.expect("{")
        while T[self.i] != "}":
            if self.accept(";"):
                continue
            if T[self.i] == "id" and T[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            if T[self.i] != "}":
                self.expect(";")
        self.i += 1

    def signature(self) -> None:
        self.parameters()
        t = self.T[self.i]
        if t == "(":
            self.parameters()
        elif t in _TYPE_START:
            self.type()

    def parameters(self) -> None:
        """Names with types, or types alone; both look alike at first."""
        T = self.T
        self.expect("(")
        named = bare = False
        while T[self.i] != ")":
            if self.accept("..."):
                self.type()
                bare = True
            else:
                self.type()
                if T[self.i] not in (",", ")"):
                    if T[self.i - 1] not in ("id", "]"):
                        self.fail()
                    self.accept("...")
                    self.type()
                    named = True
                    bare = False
                else:
                    bare = True
            if T[self.i] != ")":
                self.expect(",")
        self.i += 1
        if named and bare:
            self.i -= 1
            self.fail("parameters with and without names")

    # -- statements

    def block(self) -> None:
        self.expect("{")
        control, self.control = self.control, False
        self.level += 1
        self.statements("}")
        self.level -= 1
        self.control = control
        self.expect("}")

    def inner(self) -> None:
        t = self.T[self.i]
        if t == ";":
            self.i += 1
        elif t in ("var", "const", "type"):
            self.declaration()
        elif t == "{":
            self.block()
            self.skip()
        elif t == "if":
            self.if_()
            self.skip()
        elif t == "for":
            self.for_()
            self.skip()
        elif t == "switch":
            self.switch()
            self.skip()
        elif t == "select":
            self.select()
            self.skip()
        elif t == "return":
            self.i += 1
            if self.T[self.i] not in (";", "}"):
                self.expressions()
            self.skip()
        elif t in ("break", "continue", "goto"):
            self.i += 1
            if t == "goto":
                self.expect("id")
            else:
                self.accept("id")
            self.skip()
        elif t == "fallthrough":
            self.i += 1
            self.skip()
        elif t in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.T[self.i - 1] != ")":
                self.fail("a call is expected")
            self.skip()
        elif t == "id" and self.T[self.i + 1] == ":":
            self.i += 2
            if self.T[self.i] != "}":
                self.inner()
        else:
            self.simple()
            self.skip()

    def simple(self, ranged: bool = False) -> str:
        T = self.T
        if ranged and T[self.i] == "range":
            self.i += 1
            self.expression()
            return "range"
        begin = self.i
        kind, number = self.expressions()
        t = T[self.i]
        if t == ":=":
            if any(x != "id" for x in T[begin : self.i : 2]) or self.i - begin != 2 * number - 1:
                self.fail("names are expected before ':='")
            self.i += 1
            if ranged and self.accept("range"):
                self.expression()
                return "range"
            self.type_switch = False
            self.expressions()
            return "define"
        if t in _ASSIGN:
            if t != "=" and number > 1:
                self.fail()
            self.i += 1
            if ranged and t == "=" and self.accept("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if number > 1:
            self.fail()
        if t in ("++", "--"):
            self.i += 1
            return "step"
        if t == "<-":
            self.i += 1
            self.expression()
            return "send"
        return "call" if kind == "call" else "value"

    def header(self, stop: bool = False) -> None:
        """``init; condition`` before a block."""
        self.control = True
        T = self.T
        if T[self.i] != "{":
            if T[self.i] != ";":
                self.simple()
            if self.accept(";") and T[self.i] != "{":
                self.simple()
            elif stop and T[self.i - 1] == ";":
                self.fail("a condition is expected")
        elif stop:
            self.fail("a condition is expected")
        self.control = False

    def if_(self) -> None:
        control = self.control
        self.i += 1
        self.header(True)
        self.block()
        if self.accept("else"):
            if self.T[self.i] == "if":
                self.if_()
            else:
                self.block()
        self.control = control

    def for_(self) -> None:
        control, self.control = self.control, True
        self.i += 1
        T = self.T
        if T[self.i] != "{":
            kind = self.simple(True) if T[self.i] != ";" else ""
            if kind != "range" and T[self.i] == ";":
                self.i += 1
                if T[self.i] != ";":
                    if T[self.i] == "{":
                        self.fail("expected for loop condition")
                    self.simple()
                self.expect(";")
                if T[self.i] != "{":
                    self.simple()
        self.control = False
        self.block()
        self.control = control

    def switch(self) -> None:
        control = self.control
        self.i += 1
        self.header()
        self.expect("{")
        while self.T[self.i] != "}":
            if self.accept("case"):
                self.type_or_expression()
                while self.accept(","):
                    self.type_or_expression()
            else:
                self.expect("default")
            self.expect(":")
            self.clause()
        self.i += 1
        self.control = control

    def select(self) -> None:
        self.i += 1
        self.expect("{")
        while self.T[self.i] != "}":
            if self.accept("case"):
                self.simple()
            else:
                self.expect("default")
            self.expect(":")
            self.clause()
        self.i += 1

    def clause(self) -> None:
        self.level += 1
        while self.T[self.i] not in ("case", "default", "}", ""):
            self.inner()
        self.level -= 1

    def type_or_expression(self) -> None:
        if not self.attempt(self.case_expression):
            self.type()

    def case_expression(self) -> None:
        self.expression()
        if self.T[self.i] not in (",", ":"):
            self.fail()

    # -- expressions

    def expressions(self) -> tuple[str, int]:
        kind, n = self.expression(), 1
        while self.accept(","):
            self.expression()
            n += 1
        return kind, n

    def outside(self, rule) -> None:
        control, self.control = self.control, False
        rule()
        self.control = control

    def expression(self, least: int = 0) -> str:
        kind = self.unary()
        T = self.T
        while True:
            level = PRECEDENCE.get(T[self.i])
            if level is None or level <= least:
                return kind
            self.i += 1
            self.expression(level)
            kind = "value"

    def unary(self) -> str:
        t = self.T[self.i]
        if t in ("+", "-", "!", "^", "*", "&"):
            self.i += 1
            self.unary()
            return "value"
        if t == "<-":
            if self.T[self.i + 1] == "chan":
                return self.primary()
            self.i += 1
            self.unary()
            return "call"
        return self.primary()

    def primary(self) -> str:
        T = self.T
        t = T[self.i]
        literal = False  # whether a composite literal may follow
        if t == "id":
            self.i += 1
            literal = not self.control
        elif t in ("num", "str"):
            self.i += 1
        elif t == "(":
            self.i += 1

            def inside() -> None:
                self.expression()
                if T[self.i] != ")":
                    self.fail()

            control, self.control = self.control, False
            if not self.attempt(inside):
                at = self.i
                if not self.attempt(lambda: (self.type(), T[self.i] == ")" or self.fail())):
                    self.i = at
                    self.expression()
            self.control = control
            self.expect(")")
        elif t == "func":
            self.i += 1
            self.signature()
            if T[self.i] == "{":
                self.outside(self.block)
        elif t in ("[", "map", "chan", "struct", "interface", "<-"):
            self.type()
            literal = True
        else:
            self.fail()
        kind = "value"
        while True:
            t = T[self.i]
            if t == ".":
                self.i += 1
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                else:
                    self.expect("id")
            elif t == "(":
                self.i += 1
                control, self.control = self.control, False
                while T[self.i] != ")":
                    self.argument()
                    self.accept("...")
                    if T[self.i] != ")":
                        self.expect(",")
                self.control = control
                self.i += 1
                kind = "call"
                literal = False
                continue
            elif t == "[":
                self.i += 1
                self.outside(self.index)
            elif t == "{" and literal:
                self.literal()
                literal = False
            else:
                return kind
            kind = "value"

    def argument(self) -> None:
        if self.T[self.i] in ("[", "map", "chan", "struct", "interface", "*", "func", "<-"):
            at = self.i

            def value() -> None:
                self.expression()
                if self.T[self.i] not in (",", ")", "..."):
                    self.fail()

            if self.attempt(value):
                return
            self.i = at
            if self.attempt(self.type):
                return
        self.expression()

    def index(self) -> None:
        T = self.T
        if T[self.i] == "]":
            self.fail()
        n = 0
        if T[self.i] != ":":
            self.argument_index()
            while self.accept(","):
                if T[self.i] == "]":
                    break
                self.argument_index()
        while self.accept(":"):
            n += 1
            if T[self.i] not in ("]", ":"):
                self.expression()
        if n > 2:
            self.fail()
        self.expect("]")

    def argument_index(self) -> None:
        def value() -> None:
            self.expression()
            if self.T[self.i] not in (",", "]", ":"):
                self.fail()

        if not self.attempt(value) and not self.attempt(self.type):
            self.expression()

    def literal(self) -> None:
        T = self.T
        self.expect("{")
        control, self.control = self.control, False
        while T[self.i] != "}":
            self.element()
            if self.accept(":"):
                self.element()
            if T[self.i] != "}":
                self.expect(",")
        self.control = control
        self.i += 1

    def element(self) -> None:
        if self.T[self.i] == "{":
            self.literal()
        else:
            self.expression()
