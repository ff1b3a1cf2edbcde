"""Java."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Broken, Parser

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient "
    "try void volatile while true false null _".split()
)
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_TOKEN = re.compile(
    r"((?:[ \t\n\r\f]+|//[^\n\r]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*)(?:"
    r"((?:[^\W\d]|[$])[\w$]*)"
    r"|((?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+[fFdD]?)?|0[bB][01](?:_*[01])*|(?:\d(?:_*\d)*)?\.\d(?:_*\d)*(?:[eE][+-]?\d+)?[fFdD]?|\d(?:_*\d)*(?:\.(?!\.))?(?:[eE][+-]?\d+)?[fFdD]?)[lL]?(?![\w$]))"
    r"|(\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\")"
    r"|('(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    r"|(\.\.\.|->|::|\+\+|--|==|!=|<=|&&|\|\||<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[()\[\]{},;.@:=+\-*/%&|^<>!~?])"
    r"|([\s\S])|\Z)"
)
PRECEDENCE = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
_AFTER_CAST = frozenset("id str num ( ! ~ this super new true false null switch".split()) | PRIMITIVE
_ENDS = frozenset("; ) , ]".split())


class Java(Parser):
    starters = frozenset("if for while do switch try return throw break continue public private protected static final class interface enum abstract synchronized assert import void @".split())

    def lex(self, text: str) -> None:
        at = 1 if text.startswith("﻿") else 0
        if text.endswith("\x1a"):
            text = text[:-1]
        T, P, N = self.T, self.P, self.N
        match, keywords = _TOKEN.match, KEYWORDS
        while True:
            m = match(text, at)
            k = m.lastindex
            if k == 1:
                return
            start, at = m.end(1), m.end()
            if k == 2:
                w = m[2]
                T.append(w if w in keywords else "id")
            elif k == 6:
                T.append(m[6])
            elif k == 3:
                T.append("num")
            elif k in (4, 5):
                T.append("str")
            else:
                c = m[7]
                self.bad[len(T)] = "unterminated literal or bad escape" if c in "\"'" else f"invalid character {c!r}"
                T.append("bad")
                if c in "\"'":
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end
            P.append(start)
            N.append("\n" in m[1])

    def word(self) -> str:
        return self.value(self.i) if self.T[self.i] == "id" else ""

    # -- declarations

    def program(self) -> None:
        T = self.T
        if self.i == 0:
            self.clause = "package"
        self.statements("")

    level = 0
    clause = ""

    def statement(self) -> None:
        if self.level:
            return self.inner()
        T = self.T
        t = T[self.i]
        if t == ";":
            self.i += 1
        elif t == "import":
            if self.clause == "types":
                self.fail("imports come first")
            self.clause = "imports"
            self.i += 1
            self.accept("static")
            self.expect("id")
            while self.accept("."):
                if self.accept("*"):
                    break
                self.expect("id")
            self.expect(";")
        else:
            at = self.i
            self.modifiers()
            if T[self.i] == "package":
                if self.clause != "package":
                    self.fail("the package comes first")
                self.clause = "imports"
                self.i += 1
                self.expect("id")
                while self.accept("."):
                    self.expect("id")
                self.expect(";")
            elif T[self.i] == "id" and self.word() in ("module", "open") and at == self.i and T[self.i + 1] == "id":
                self.module()
            else:
                self.clause = "types"
                if not self.type_declaration():
                    self.fail("a class, interface, enum or record is expected")

    def module(self) -> None:
        while self.T[self.i] in ("id", "."):
            self.i += 1
        self.expect("{")
        while self.T[self.i] not in ("}", ""):
            self.i += 1
        self.expect("}")

    def modifiers(self) -> bool:
        T, begin = self.T, self.i
        while True:
            t = T[self.i]
            if t == "@" and T[self.i + 1] != "interface":
                self.annotation()
            elif t in MODIFIERS and not (t == "default" and T[self.i + 1] in (":", "->")) and not (t == "synchronized" and T[self.i + 1] == "("):
                self.i += 1
            elif t == "id" and (w := self.value(self.i)) in ("sealed", "non") and (w == "sealed" and T[self.i + 1] in ("id", "class", "interface", "abstract", "static", "public") or w == "non" and T[self.i + 1] == "-"):
                self.i += 1 if w == "sealed" else 3
            else:
                return self.i > begin

    def annotation(self) -> None:
        self.expect("@")
        self.qualified()
        if self.T[self.i] == "(":
            self.i += 1
            while self.T[self.i] != ")":
                if self.T[self.i] == "id" and self.T[self.i + 1] == "=":
                    self.i += 2
                self.element_value()
                if self.T[self.i] != ")":
                    self.expect(",")
            self.i += 1

    def element_value(self) -> None:
        if self.T[self.i] == "@":
            self.annotation()
        elif self.T[self.i] == "{":
            self.i += 1
            while self.T[self.i] != "}":
                self.element_value()
                if self.T[self.i] != "}":
                    self.expect(",")
            self.i += 1
        else:
            self.ternary()

    def qualified(self) -> None:
        self.expect("id")
        while self.T[self.i] == "." and self.T[self.i + 1] == "id":
            self.i += 2

    def type_declaration(self) -> bool:
        """Behind the modifiers; False if none begins here."""
        T = self.T
        t = T[self.i]
        if t == "class":
            self.i += 1
            self.expect("id")
            self.type_parameters_if()
            if self.accept("extends"):
                self.type()
            self.supers("implements")
            self.permits()
            self.class_body()
        elif t == "interface":
            self.i += 1
            self.expect("id")
            self.type_parameters_if()
            self.supers("extends")
            self.permits()
            self.class_body()
        elif t == "enum":
            self.i += 1
            self.expect("id")
            self.supers("implements")
            self.expect("{")
            while T[self.i] not in (";", "}"):
                while T[self.i] == "@":
                    self.annotation()
                self.expect("id")
                if T[self.i] == "(":
                    self.arguments()
                if T[self.i] == "{":
                    self.class_body()
                if T[self.i] not in (";", "}"):
                    self.expect(",")
            if self.accept(";"):
                self.members()
            self.expect("}")
        elif t == "@" and T[self.i + 1] == "interface":
            self.i += 2
            self.expect("id")
            self.class_body()
        elif t == "id" and T[self.i + 1] == "id" and T[self.i + 2] in ("(", "<") and self.word() == "record":
            self.i += 2
            self.type_parameters_if()
            self.parameters()
            self.supers("implements")
            self.class_body()
        else:
            return False
        return True

    def supers(self, word: str) -> None:
        if self.accept(word):
            self.type()
            while self.accept(","):
                self.type()

    def permits(self) -> None:
        if self.word() == "permits":
            self.i += 1
            self.type()
            while self.accept(","):
                self.type()

    def class_body(self) -> None:
        self.expect("{")
        self.members()
        self.expect("}")

    def members(self) -> None:
        level, self.level = self.level, 0
        while self.T[self.i] != "}":
            begin = self.i
            if not self.T[begin]:
                self.fail()
            try:
                self.member()
            except Broken as broken:
                self.store(broken)
                self.recover(max(begin, broken.at), begin, "}")
        self.level = level

    def member(self) -> None:
        T = self.T
        if self.accept(";"):
            return
        if T[self.i] == "{" or T[self.i] == "static" and T[self.i + 1] == "{":
            self.accept("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters_if()
        while T[self.i] == "@":
            self.annotation()
        if T[self.i] == "id" and T[self.i + 1] in ("(", "{"):  # a constructor
            self.i += 1
            if T[self.i] == "(":
                self.parameters()
                self.throws()
            return self.block()
        if not self.accept("void"):
            self.type()
        self.expect("id")
        if T[self.i] == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.accept("default"):
                self.element_value()
            if T[self.i] == "{":
                return self.block()
            self.expect(";")
            return
        self.declarators()
        self.expect(";")

    def throws(self) -> None:
        if self.accept("throws"):
            self.type()
            while self.accept(","):
                self.type()

    def parameters(self) -> None:
        T = self.T
        self.expect("(")
        while T[self.i] != ")":
            self.modifiers()
            self.type()
            while T[self.i] == "@":
                self.annotation()
            self.accept("...")
            if T[self.i] == "id" and T[self.i + 1] == "." and T[self.i + 2] == "this":
                self.i += 2
            if not self.accept("this"):
                self.name()
            self.dimensions()
            if T[self.i] != ")":
                self.expect(",")
                if T[self.i] == ")":
                    self.fail()
        self.i += 1

    def name(self) -> None:
        if not self.accept("_"):
            self.expect("id")

    def dimensions(self) -> None:
        while self.T[self.i] == "[" and self.T[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """Behind the first name."""
        while True:
            self.dimensions()
            if self.accept("="):
                self.initializer()
            if not self.accept(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.T[self.i] == "{":
            self.i += 1
            while self.T[self.i] != "}":
                self.initializer()
                if self.T[self.i] != "}":
                    self.expect(",")
            self.i += 1
        else:
            self.expression()

    # -- types

    def type_parameters_if(self) -> None:
        if self.T[self.i] != "<":
            return
        self.i += 1
        while True:
            while self.T[self.i] == "@":
                self.annotation()
            self.expect("id")
            if self.accept("extends"):
                self.type()
                while self.accept("&"):
                    self.type()
            if not self.accept(","):
                break
        self.expect(">")

    def type(self) -> None:
        T = self.T
        while T[self.i] == "@":
            self.annotation()
        t = T[self.i]
        if t in PRIMITIVE:
            self.i += 1
        else:
            self.expect("id")
            while True:
                if T[self.i] == "<":
                    self.type_arguments()
                if T[self.i] == "." and T[self.i + 1] in ("id", "@"):
                    self.i += 1
                    while T[self.i] == "@":
                        self.annotation()
                    self.expect("id")
                else:
                    break
        while T[self.i] == "@" and T[self.i + 1] != "interface":
            self.annotation()
        self.dimensions()

    def type_arguments(self) -> None:
        self.expect("<")
        if self.accept(">"):
            return
        while True:
            while self.T[self.i] == "@":
                self.annotation()
            if self.accept("?"):
                if self.T[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            if not self.accept(","):
                break
        self.expect(">")

    # -- statements

    def block(self) -> None:
        self.expect("{")
        self.level += 1
        self.statements("}")
        self.level -= 1
        self.expect("}")

    def inner(self) -> None:
        T = self.T
        t = T[self.i]
        rule = _STATEMENTS.get(t)
        if rule:
            return rule(self)
        if t == "id":
            following = T[self.i + 1]
            if following == "id":
                w = self.value(self.i)
                if w == "yield":
                    self.i += 1
                    self.expression()
                    self.expect(";")
                    return
                if w == "record" and T[self.i + 2] in ("(", "<") and self.attempt(lambda: self.type_declaration() or self.fail()):
                    return
                self.i += 2  # a type's name and a variable
                self.declarators()
                self.expect(";")
                return
            if following == ":":
                self.i += 2
                return self.body()
            if following in ("(", "=", "++", "--"):
                if self.value(self.i) == "yield" and following == "(":
                    self.i += 1
                self.expression()
                self.expect(";")
                return
            if self.value(self.i) == "yield" and following in ("str", "num", "new", "this", "true", "false", "null", "switch", "-", "!", "+"):
                self.i += 1
                self.expression()
                self.expect(";")
                return
        if self.modifiers():
            if self.type_declaration():
                return
            self.type()
            self.name()
            self.declarators()
            self.expect(";")
            return
        if t in ("class", "interface", "enum"):
            self.type_declaration()
            return
        if (t in PRIMITIVE or t == "id") and self.attempt(self.local):
            self.declarators()
            self.expect(";")
            return
        begin = self.i
        kind = self.expression()
        if kind not in ("call", "assign") and not self.faults:
            self.i = begin
            self.fail("not a statement")
        self.expect(";")

    def body(self) -> None:
        """A statement that is no declaration."""
        t = self.T[self.i]
        if t in PRIMITIVE and self.T[self.i + 1] == "id" or t == "id" and self.T[self.i + 1] == "id" and self.value(self.i) != "yield" or t in ("class", "interface", "enum"):
            self.fail("a declaration is not allowed here")
        self.inner()

    def local(self) -> None:
        self.type()
        self.name()
        if self.T[self.i] not in ("=", ";", ",", "[", ":", ")"):
            self.fail()

    def parenthesized(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def if_(self) -> None:
        self.i += 1
        self.parenthesized()
        self.body()
        if self.accept("else"):
            self.body()

    def while_(self) -> None:
        self.i += 1
        self.parenthesized()
        self.body()

    def do_(self) -> None:
        self.i += 1
        self.body()
        self.expect("while")
        self.parenthesized()
        self.expect(";")

    def for_(self) -> None:
        T = self.T
        self.i += 1
        self.expect("(")

        def declared() -> None:
            self.modifiers()
            self.local()

        if T[self.i] != ";":
            if (T[self.i] in ("id", "final", "@") or T[self.i] in PRIMITIVE) and self.attempt(declared):
                if self.accept(":"):
                    self.expression()
                    self.expect(")")
                    return self.body()
                self.declarators()
            else:
                self.expression()
                while self.accept(","):
                    self.expression()
        self.expect(";")
        if T[self.i] != ";":
            self.expression()
        self.expect(";")
        if T[self.i] != ")":
            self.expression()
            while self.accept(","):
                self.expression()
        self.expect(")")
        self.body()

    def try_(self) -> None:
        T = self.T
        self.i += 1
        resources = False
        if self.accept("("):
            resources = True
            while T[self.i] != ")":

                def resource() -> None:
                    self.modifiers()
                    self.local()
                    self.expect("=")

                self.attempt(resource)
                self.expression()
                if T[self.i] != ")":
                    self.expect(";")
            self.i += 1
        self.block()
        caught = False
        while self.accept("catch"):
            caught = True
            self.expect("(")
            self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.expect(")")
            self.block()
        if self.accept("finally"):
            self.block()
        elif not caught and not resources:
            self.fail("'try' without 'catch' or 'finally'")

    def switch_statement(self) -> None:
        self.switch()
        if self.T[self.i] == ".":  # the expression goes on
            self.fail("not a statement")

    def switch(self) -> None:
        T = self.T
        self.expect("switch")
        self.parenthesized()
        self.expect("{")
        self.level += 1
        while T[self.i] != "}":
            if self.accept("case"):
                self.label()
                while self.accept(","):
                    self.label()
                if self.word() == "when":
                    self.i += 1
                    self.ternary()
            else:
                self.expect("default")
            if self.accept("->"):
                if T[self.i] == "{":
                    self.block()
                elif T[self.i] == "throw":
                    self.inner()
                else:
                    self.expression()
                    self.expect(";")
            else:
                self.expect(":")
                while T[self.i] not in ("case", "default", "}", ""):
                    self.inner()
        self.level -= 1
        self.i += 1

    def label(self) -> None:
        if self.accept("default"):
            return

        def pattern() -> None:
            self.pattern()
            if self.T[self.i] not in (":", "->", ",") and self.word() != "when":
                self.fail()

        if not self.attempt(pattern):
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        if self.accept("_"):
            return
        self.type()
        if self.accept("("):
            while self.T[self.i] != ")":
                self.pattern()
                if self.T[self.i] != ")":
                    self.expect(",")
            self.i += 1
            self.accept("id")
        else:
            self.name()

    def return_(self) -> None:
        self.i += 1
        if self.T[self.i] != ";":
            self.expression()
        self.expect(";")

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.expect(";")

    def jump(self) -> None:
        self.i += 1
        self.accept("id")
        self.expect(";")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.accept(":"):
            self.expression()
        self.expect(";")

    def synchronized(self) -> None:
        self.i += 1
        self.parenthesized()
        self.block()

    def empty(self) -> None:
        self.i += 1

    # -- expressions

    def expression(self) -> str:
        T = self.T
        i = self.i
        t = T[i]
        if t == "id":
            if T[i + 1] in _ENDS:
                self.i += 1
                return "target"
            if T[i + 1] == "->":
                self.i += 2
                return self.lambda_body()
        elif t == "_" and T[i + 1] == "->":
            self.i += 2
            return self.lambda_body()
        elif t == "(" and self.lambda_ahead():
            return self.lambda_body()
        kind = self.ternary()
        op = T[self.i]
        if op in _ASSIGN or op == ">" and self.shift_assign():
            if kind != "target":
                self.fail("cannot assign here")
            self.i += 1
            self.expression()
            return "assign"
        return kind

    def shift_assign(self) -> bool:
        k = self.i
        while self.T[k] == ">" and self.P[k + 1] == self.P[k] + 1:
            k += 1
        if self.T[k] == "=" and 2 <= k - self.i <= 3:
            self.i = k
            return True
        return False

    pairs_ = None

    def lambda_ahead(self) -> bool:
        if self.pairs_ is None:
            self.pairs_ = self.brackets()
        close = self.pairs_.get(self.i)
        if close is None or self.T[close + 1] != "->":
            return False
        if self.T[self.i + 1] in ("id", "_") and self.T[self.i + 2] in (",", ")"):
            self.i += 1
            while True:
                self.name()
                if not self.accept(","):
                    break
            self.expect(")")
        else:
            self.parameters()
        self.expect("->")
        return True

    def lambda_body(self) -> str:
        if self.T[self.i] == "{":
            self.block()
        else:
            self.expression()
        return "value"

    def ternary(self) -> str:
        kind = self.binary(0)
        if self.accept("?"):
            self.expression()
            self.expect(":")
            if self.T[self.i] in ("id", "(", "_"):
                self.expression_no_assign()
            else:
                self.ternary()
            return "value"
        return kind

    def expression_no_assign(self) -> None:
        if self.T[self.i + 1] == "->" or self.T[self.i] == "(" and self.lambda_ahead_peek():
            self.expression()
        else:
            self.ternary()

    def lambda_ahead_peek(self) -> bool:
        if self.pairs_ is None:
            self.pairs_ = self.brackets()
        close = self.pairs_.get(self.i)
        return close is not None and self.T[close + 1] == "->"

    def binary(self, least: int) -> str:
        kind = self.unary()
        T = self.T
        while True:
            t, size = T[self.i], 1
            if t == ">":
                run = 1
                while run < 3 and T[self.i + run] == ">" and self.P[self.i + run] == self.P[self.i] + run:
                    run += 1
                if self.P[self.i + run] == self.P[self.i] + run and T[self.i + run] == "=":
                    if run > 1:
                        return kind
                    t, size = ">=", 2
                elif self.P[self.i + run] == self.P[self.i] + run and T[self.i + run] == "==":
                    return kind
                else:
                    t, size = ">" * run, run
            level = PRECEDENCE.get(t)
            if level is None or level <= least:
                return kind
            self.i += size
            if t == "instanceof":

                def pattern() -> None:
                    self.pattern()

                if not self.attempt(pattern):
                    self.accept("final")
                    self.type()
            else:
                self.binary(level)
            kind = "value"

    def unary(self) -> str:
        T = self.T
        t = T[self.i]
        if t in ("++", "--"):
            self.i += 1
            if self.unary() != "target":
                self.fail()
            return "assign"
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if t == "(":
            if T[self.i + 1] in PRIMITIVE:
                at = self.i

                def primitive_cast() -> None:
                    self.i += 1
                    self.type()
                    while self.accept("&"):
                        self.type()
                    self.expect(")")

                if self.attempt(primitive_cast):
                    self.cast_operand()
                    return "value"
                self.i = at
            elif T[self.i + 1] in ("id", "@"):

                def cast() -> None:
                    self.i += 1
                    self.type()
                    while self.accept("&"):
                        self.type()
                    self.expect(")")
                    if T[self.i] not in _AFTER_CAST:
                        self.fail()

                if self.attempt(cast):
                    self.cast_operand()
                    return "value"
        kind = self.primary()
        if T[self.i] in ("++", "--"):
            if kind != "target":
                self.fail()
            self.i += 1
            return "assign"
        return kind

    def cast_operand(self) -> None:
        t = self.T[self.i]
        if t == "id" and self.T[self.i + 1] == "->" or t == "(" and self.lambda_ahead_peek():
            self.expression()
        else:
            self.unary()

    def primary(self) -> str:
        T = self.T
        t = T[self.i]
        kind = "value"
        if t == "id":
            self.i += 1
            kind = "target"
            if T[self.i] == "(":
                self.arguments()
                kind = "call"
            elif T[self.i] == "<" and self.attempt(self.generic_reference):
                return "value"
            elif T[self.i] == "[" and T[self.i + 1] == "]":
                self.dimensions()
                if T[self.i] not in (".", "::"):
                    self.fail()
        elif t in ("num", "str", "true", "false", "null"):
            self.i += 1
        elif t == "this":
            self.i += 1
            if T[self.i] == "(":
                self.arguments()
                kind = "call"
        elif t == "super":
            self.i += 1
            if T[self.i] == "(":
                self.arguments()
                kind = "call"
            elif T[self.i] not in (".", "::"):
                self.fail()
        elif t == "(":
            self.i += 1
            kind = self.expression()
            self.expect(")")
            if kind != "target":
                kind = "value"
        elif t == "new":
            self.new()
            kind = "call"
        elif t == "switch":
            self.switch()
        elif t in PRIMITIVE or t == "void":
            if t == "void":
                self.i += 1
            else:
                self.type()
            if T[self.i] not in (".", "::"):
                self.fail()
        elif t == "<":
            self.fail()
        else:
            self.fail()
        while True:
            t = T[self.i]
            if t == ".":
                self.i += 1
                u = T[self.i]
                if u == "id":
                    self.i += 1
                    kind = "target"
                    if T[self.i] == "(":
                        self.arguments()
                        kind = "call"
                    elif T[self.i] == "<" and self.attempt(self.generic_reference):
                        return "value"
                    elif T[self.i] == "[" and T[self.i + 1] == "]":
                        self.dimensions()
                        if T[self.i] not in (".", "::"):
                            self.fail()
                elif u == "<":
                    self.type_arguments()
                    if not self.accept("super"):
                        self.expect("id")
                    self.arguments()
                    kind = "call"
                elif u == "new":
                    self.new()
                    kind = "call"
                elif u in ("this", "class", "super"):
                    self.i += 1
                    kind = "value"
                    if u == "super" and T[self.i] == "(":
                        self.arguments()
                        kind = "call"
                else:
                    self.fail()
            elif t == "[":
                self.i += 1
                self.expression()
                self.expect("]")
                kind = "target"
            elif t == "::":
                self.i += 1
                if T[self.i] == "<":
                    self.type_arguments()
                if not self.accept("new"):
                    self.expect("id")
                kind = "value"
            else:
                return kind

    def generic_reference(self) -> None:
        self.type_arguments()
        while self.accept("."):
            self.expect("id")
            if self.T[self.i] == "<":
                self.type_arguments()
        self.dimensions()
        self.expect("::")
        if not self.accept("new"):
            self.expect("id")

    def arguments(self) -> None:
        T = self.T
        self.expect("(")
        if self.accept(")"):
            return
        while True:
            self.expression()
            if T[self.i] == ")":
                self.i += 1
                return
            self.expect(",")

    def new(self) -> None:
        T = self.T
        self.expect("new")
        if T[self.i] == "<":
            self.type_arguments()
        while T[self.i] == "@":
            self.annotation()
        if T[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.expect("id")
            while True:
                if T[self.i] == "<":
                    self.type_arguments()
                if not self.accept("."):
                    break
                self.expect("id")
        if T[self.i] == "(":
            self.arguments()
            if T[self.i] == "{":
                self.class_body()
        elif T[self.i] == "[":
            if T[self.i + 1] == "]":
                self.dimensions()
                if T[self.i] != "{":
                    self.fail()
                self.initializer()
            else:
                while T[self.i] == "[" and T[self.i + 1] != "]":
                    self.i += 1
                    self.expression()
                    self.expect("]")
                self.dimensions()
        else:
            self.fail("expected '(' or '['")


_STATEMENTS = {
    "{": Java.block, "if": Java.if_, "for": Java.for_, "while": Java.while_, "do": Java.do_, "try": Java.try_, "switch": Java.switch_statement, "return": Java.return_,
    "throw": Java.throw, "break": Java.jump, "continue": Java.jump, "assert": Java.assert_, "synchronized": Java.synchronized, ";": Java.empty,
}
