"""JavaScript (as a module, with JSX) and TypeScript."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Broken, Parser

_SPACE = r"(?:[ \t\n\r\v\f   -     　﻿]+|//[^\n\r  ]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*"
_TOKEN = re.compile(
    rf"({_SPACE})(?:"
    r"((?:[^\W\d]|[$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$‌‍]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*)"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|((?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*)n?(?![\w$])|(?:0|[1-9](?:_?\d)*)n(?![\w$])"
    r"|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$]))"
    r"|(\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<<|<=|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
    r"|(`)|(\#(?:[^\W\d]|[$])[\w$]*)|([\s\S])|\Z)"
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*(?![\w$])")

# The reserved words of a module.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield await".split())
_BEFORE_OPERAND = frozenset(
    "( [ { , ; : ? = == === != !== < > <= + - * / % ** & | ^ ! ~ && || ?? => ... += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= << return typeof case delete do else in instanceof new throw void await yield of } tpl{".split()
)
PRECEDENCE = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_UNARY = frozenset("! ~ + - typeof void delete ++ --".split())
_ENDS_EXPRESSION = frozenset(") ] } , ; :".split()) | {"", "tpl}"}
_MODIFIERS = frozenset("public private protected static abstract readonly override declare async accessor".split())


class Script(Parser):
    typed = False
    jsx = True
    starters = frozenset("var let const function class if for while do switch try return throw import export break continue async interface type enum".split())

    # -- lexing

    def lex(self, text: str) -> None:
        at = 1 if text.startswith("﻿") else 0
        if text.startswith("#!", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        self.lex_from(at)
        self.in_function = 0
        self.in_loop = 0

    def lex_from(self, at: int) -> None:
        text, T, P, N = self.text, self.T, self.P, self.N
        match, reserved = _TOKEN.match, RESERVED
        braces: list[bool] = []  # for each open brace whether it is a template's
        n = len(text)
        while at < n:
            m = match(text, at)
            k = m.lastindex
            if k == 1:
                break
            newline = "\n" in m[1] or not T
            start, at = m.end(1), m.end()
            if k == 2:
                word = m[2]
                if word in reserved and not (T and T[-1] in (".", "?.")):
                    T.append(word)
                else:
                    T.append("id")
            elif k == 5:
                p = m[5]
                if p == "{":
                    braces.append(False)
                elif p == "}" and braces and braces.pop():
                    t = _TEMPLATE.match(text, at)
                    at = t.end()
                    if text.startswith("${", at):
                        at += 2
                        braces.append(True)
                        T.append("tpl|")
                    elif text.startswith("`", at):
                        at += 1
                        T.append("tpl}")
                    else:
                        self.add_bad(start, newline, "unterminated template")
                        return
                    P.append(start)
                    N.append(newline)
                    continue
                elif p[0] == "/" and (not T or T[-1] in _BEFORE_OPERAND or T[-1] in ("tpl|",)):
                    r = _REGEX.match(text, start)
                    if r:
                        at = r.end()
                        p = "regex"
                T.append(p)
            elif k == 3:
                T.append("str")
            elif k == 4:
                T.append("num")
            elif k == 6:
                t = _TEMPLATE.match(text, at)
                at = t.end()
                if text.startswith("${", at):
                    at += 2
                    braces.append(True)
                    T.append("tpl{")
                elif text.startswith("`", at):
                    at += 1
                    T.append("tpl")
                else:
                    self.add_bad(start, newline, "unterminated template")
                    return
            elif k == 7:
                T.append("private")
            else:
                c = m[8]
                self.bad[len(T)] = "unterminated string" if c in "\"'" else "invalid number" if c.isdigit() else f"invalid character {c!r}"
                T.append("bad")
                if c in "\"'":
                    end = text.find("\n", at)
                    at = n if end < 0 else end
            P.append(start)
            N.append(newline)

    def relex(self, i: int, at: int) -> None:
        """Token ``i`` and all later ones anew from an offset: what follows a JSX element."""
        del self.T[i:], self.P[i:], self.N[i:]
        self.bad = {k: v for k, v in self.bad.items() if k < i}
        self.refused.clear()
        self.lex_from(at)
        self.T.append("")
        self.P.append(len(self.text))
        self.N.append(True)
        self.pairs_ = None

    # -- helpers

    pairs_ = None

    def closing(self, i: int) -> int | None:
        if self.pairs_ is None:
            self.pairs_ = self.brackets()
        return self.pairs_.get(i)

    def word(self, i: int) -> str:
        return self.value(i) if self.T[i] == "id" else ""

    def is_word(self, name: str) -> bool:
        return self.T[self.i] == "id" and self.text.startswith(name, self.P[self.i]) and self.value(self.i) == name

    def semicolon(self) -> None:
        t = self.T[self.i]
        if t == ";":
            self.i += 1
        elif t != "}" and t and not self.N[self.i]:
            self.fail()

    def name(self) -> None:
        """A binding identifier."""
        if self.T[self.i] != "id" or self.value(self.i) in STRICT and not (self.typed and self.value(self.i) not in ("yield", "await", "let")):
            self.fail()
        self.i += 1

    def property_word(self) -> None:
        t = self.T[self.i]
        if t == "id" or t in RESERVED or t == "private":
            self.i += 1
        else:
            self.fail()

    def adjacent(self, i: int) -> bool:
        return self.P[i + 1] == self.P[i] + 1

    # -- statements

    def program(self) -> None:
        self.top = True
        self.statements("")

    def statements(self, end: str) -> None:
        super().statements(end)

    def statement(self) -> None:
        i = self.i
        t = self.T[i]
        rule = _STATEMENTS.get(t)
        if rule:
            return rule(self)
        if t == "id":
            following = self.T[i + 1]
            if following == ":":
                self.i += 2
                return self.inner()
            w = self.value(i)
            if w == "let" and following in ("id", "[", "{"):
                return self.variables()
            if w == "async" and following == "function" and not self.N[i + 1]:
                self.i += 1
                return self.function_declaration()
            if self.typed and self.typed_statement(w, following):
                return None
        self.expression()
        self.semicolon()

    def inner(self) -> None:
        """A statement that is the body of another: no declaration of its own scope."""
        if self.T[self.i] in ("class", "const", "import", "export"):
            self.fail()
        self.statement()

    def block(self) -> None:
        self.expect("{")
        top, self.top = self.top, False
        self.statements("}")
        self.top = top
        self.expect("}")

    def variables(self, in_for: bool = False) -> None:
        constant = self.T[self.i] == "const"
        self.i += 1
        if constant and self.typed and self.T[self.i] == "enum":
            return self.enum()
        while True:
            pattern = self.T[self.i] in ("[", "{")
            self.target()
            if self.typed:
                if self.T[self.i] == "!":
                    self.i += 1
                if self.accept(":"):
                    self.type()
            if self.accept("="):
                self.assignment(not in_for)
            elif (pattern or constant and not self.typed) and not (in_for and (self.T[self.i] == "in" or self.is_word("of"))):
                if not self.declared:
                    self.fail("missing initializer")
            if not self.accept(","):
                break
        if not in_for:
            self.semicolon()

    declared = 0

    def target(self) -> None:
        """A binding: a name or a pattern of names."""
        t = self.T[self.i]
        if t == "[":
            self.i += 1
            while self.T[self.i] != "]":
                if self.accept(","):
                    continue
                self.accept("...")
                self.target()
                if self.accept("="):
                    self.assignment()
                if self.T[self.i] != "]":
                    self.expect(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while self.T[self.i] != "}":
                if self.accept("..."):
                    self.target()
                else:
                    plain = self.T[self.i] == "id"
                    self.property_name()
                    if self.accept(":"):
                        self.target()
                    elif not plain:
                        self.fail()
                    if self.accept("="):
                        self.assignment()
                if self.T[self.i] != "}":
                    self.expect(",")
            self.i += 1
        else:
            self.name()

    def if_(self) -> None:
        self.i += 1
        self.expect("(")
        self.expression()
        self.expect(")")
        self.inner()
        if self.accept("else"):
            self.inner()

    def for_(self) -> None:
        self.i += 1
        if self.is_word("await"):
            self.i += 1
        self.expect("(")
        t = self.T[self.i]
        kind = ""
        if t in ("var", "const") or t == "id" and self.value(self.i) == "let" and self.T[self.i + 1] in ("id", "[", "{"):
            self.variables(True)
            kind = "target"
        elif t != ";":
            kind = self.expression(False)
        if self.T[self.i] == "in" or self.is_word("of"):
            if kind not in ("target", "pattern"):
                self.fail()
            of = self.T[self.i] == "id"
            self.i += 1
            if of:
                self.assignment()
            else:
                self.expression()
        else:
            self.expect(";")
            if self.T[self.i] != ";":
                self.expression()
            self.expect(";")
            if self.T[self.i] != ")":
                self.expression()
        self.expect(")")
        self.loop()

    def loop(self) -> None:
        self.in_loop += 1
        self.inner()
        self.in_loop -= 1

    def while_(self) -> None:
        self.i += 1
        self.expect("(")
        self.expression()
        self.expect(")")
        self.loop()

    def do_(self) -> None:
        self.i += 1
        self.loop()
        self.expect("while")
        self.expect("(")
        self.expression()
        self.expect(")")
        self.accept(";")

    def jump(self) -> None:
        self.i += 1
        if self.T[self.i] == "id" and not self.N[self.i]:
            self.i += 1
        self.semicolon()

    def return_(self) -> None:
        if not self.in_function:
            self.fail("return outside a function")
        self.i += 1
        if self.T[self.i] not in (";", "}", "") and not self.N[self.i]:
            self.expression()
        self.semicolon()

    def throw(self) -> None:
        self.i += 1
        if self.N[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def switch(self) -> None:
        self.i += 1
        self.expect("(")
        self.expression()
        self.expect(")")
        self.expect("{")
        self.in_loop += 1
        while self.T[self.i] != "}":
            if self.accept("case"):
                self.expression()
            else:
                self.expect("default")
            self.expect(":")
            while self.T[self.i] not in ("case", "default", "}", ""):
                self.statement()
        self.in_loop -= 1
        self.i += 1

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = False
        if self.accept("catch"):
            caught = True
            if self.accept("("):
                self.target()
                if self.typed and self.accept(":"):
                    self.type()
                self.expect(")")
            self.block()
        if self.accept("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'catch'")

    def debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def empty(self) -> None:
        self.i += 1

    def decorated(self) -> None:
        self.decorators()
        if self.T[self.i] == "export":
            return self.export()
        if self.is_word("abstract"):
            self.i += 1
        self.class_(True)

    def decorators(self) -> None:
        while self.accept("@"):
            if self.T[self.i] == "(":
                self.primary()
            else:
                self.property_word()
                while self.accept("."):
                    self.property_word()
                if self.T[self.i] == "<" and self.typed:
                    self.type_arguments()
                if self.T[self.i] == "(":
                    self.arguments()

    def import_(self) -> None:
        if self.T[self.i + 1] in ("(", "."):
            self.expression()
            return self.semicolon()
        if not self.top:
            self.fail("import inside a block")
        self.i += 1
        if self.T[self.i] == "str":
            self.i += 1
        else:
            if self.typed and self.is_word("type") and (self.T[self.i + 1] in ("{", "*") or self.T[self.i + 1] == "id" and not (self.word(self.i + 1) == "from" and self.T[self.i + 2] == "str")):
                self.i += 1
            if self.T[self.i] == "id":
                self.name()
                if self.typed and self.accept("="):
                    if self.is_word("require") and self.T[self.i + 1] == "(":
                        self.i += 2
                        self.expect("str")
                        self.expect(")")
                    else:
                        self.qualified()
                    return self.semicolon()
                if self.T[self.i] == ",":
                    self.i += 1
                    if self.T[self.i] not in ("{", "*"):
                        self.fail()
            if self.T[self.i] == "*":
                self.i += 1
                self.words("as")
                self.name()
            elif self.T[self.i] == "{":
                self.specifiers(True)
            self.words("from")
            self.expect("str")
        if (self.T[self.i] == "with" or self.is_word("assert")) and self.T[self.i + 1] == "{":
            self.i += 1
            self.object()
        return self.semicolon()

    def words(self, name: str) -> None:
        if not self.is_word(name):
            self.fail()
        self.i += 1

    def specifiers(self, importing: bool) -> None:
        self.expect("{")
        while self.T[self.i] != "}":
            if self.typed and self.is_word("type") and self.T[self.i + 1] not in (",", "}") and not (self.word(self.i + 1) == "as" and self.T[self.i + 2] not in ("id",)):
                self.i += 1
            plain = self.T[self.i] == "id"
            if self.T[self.i] == "str":
                self.i += 1
            else:
                self.property_word()
            if self.is_word("as"):
                self.i += 1
                if importing:
                    self.name()
                elif self.T[self.i] == "str":
                    self.i += 1
                else:
                    self.property_word()
            elif importing and not plain:
                self.fail()
            if self.T[self.i] != "}":
                self.expect(",")
        self.i += 1

    def export(self) -> None:
        if not self.top:
            self.fail("export inside a block")
        self.i += 1
        t = self.T[self.i]
        if t == "default":
            self.i += 1
            t = self.T[self.i]
            if t == "function" or t == "id" and self.value(self.i) == "async" and self.T[self.i + 1] == "function" and not self.N[self.i + 1]:
                if t == "id":
                    self.i += 1
                self.function_declaration(False)
            elif t == "class" or t == "@":
                self.decorators()
                self.class_(False)
            elif self.typed and t == "id" and self.value(self.i) == "abstract" and self.T[self.i + 1] == "class":
                self.i += 1
                self.class_(False)
            elif self.typed and t == "id" and self.value(self.i) == "interface":
                self.interface()
            else:
                self.assignment()
                self.semicolon()
            return
        if self.typed and t == "id" and self.value(self.i) == "type" and self.T[self.i + 1] in ("{", "*"):
            self.i += 1
            t = self.T[self.i]
        if t == "*":
            self.i += 1
            if self.is_word("as"):
                self.i += 1
                if self.T[self.i] == "str":
                    self.i += 1
                else:
                    self.property_word()
            self.words("from")
            self.expect("str")
            self.semicolon()
        elif t == "{":
            self.specifiers(False)
            if self.is_word("from"):
                self.i += 1
                self.expect("str")
            self.semicolon()
        elif self.typed and t == "=":
            self.i += 1
            self.expression()
            self.semicolon()
        elif self.typed and t == "import":
            self.i += 1
            self.name()
            self.expect("=")
            self.qualified()
            self.semicolon()
        elif t in ("var", "const", "function", "class", "@", "enum") or t == "id" and self.value(self.i) in ("let", "async", "interface", "type", "namespace", "module", "declare", "abstract", "as"):
            if t == "id" and not self.typed and self.value(self.i) not in ("let", "async"):
                self.fail()
            at = self.i
            self.statement()
            if t == "id" and self.value(at) == "async" and self.T[at + 1] != "function":
                self.i = at
                self.fail()
        else:
            self.fail()

    # -- functions and classes

    def function_declaration(self, named: bool = True) -> None:
        self.i += 1
        self.accept("*")
        if named or self.T[self.i] == "id":
            self.name()
        self.function_rest(True)

    def function_rest(self, declaration: bool = False) -> None:
        if self.typed and self.T[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.typed and self.accept(":"):
            self.return_type()
        if self.typed and declaration and self.T[self.i] != "{":
            return self.semicolon()  # an overload
        self.body()

    def parameters(self) -> None:
        self.expect("(")
        while self.T[self.i] != ")":
            if self.T[self.i] == "@":
                self.decorators()
            if self.typed:
                while self.T[self.i] == "id" and self.value(self.i) in _MODIFIERS and self.T[self.i + 1] in ("id", "{", "["):
                    self.i += 1
                if self.T[self.i] == "this":
                    self.i += 1
                    self.expect(":")
                    self.type()
                    if self.T[self.i] != ")":
                        self.expect(",")
                    continue
            rest = self.accept("...")
            self.target()
            if self.typed:
                self.accept("?")
                if self.accept(":"):
                    self.type()
            if self.T[self.i] == "=" and not rest:
                self.i += 1
                self.assignment()
            if self.T[self.i] != ")":
                if rest:
                    self.fail()
                self.expect(",")
        self.i += 1

    def body(self) -> None:
        loop, self.in_loop = self.in_loop, 0
        self.in_function += 1
        self.block()
        self.in_function -= 1
        self.in_loop = loop

    def class_(self, named: bool = True) -> None:
        self.expect("class")
        if self.T[self.i] == "id" and not (self.typed and self.value(self.i) == "implements"):
            self.name()
        elif named:
            self.fail()
        if self.typed and self.T[self.i] == "<":
            self.type_parameters()
        if self.accept("extends"):
            self.left_hand()
            if self.typed and self.T[self.i] == "<":
                self.type_arguments()
        if self.typed and self.is_word("implements"):
            self.i += 1
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        top, self.top = self.top, False
        while self.T[self.i] != "}":
            begin = self.i
            if not self.T[begin]:
                self.fail()
            try:
                self.member()
            except Broken as broken:
                self.store(broken)
                self.recover(max(begin, broken.at), begin, "}")
        self.top = top
        self.i += 1

    def member(self) -> None:
        if self.accept(";"):
            return
        self.decorators()
        T = self.T
        after_name = ("(", "=", ";", "}", "?", "!", ":", "<", "")
        while T[self.i] == "id" and T[self.i + 1] not in after_name:
            w = self.value(self.i)
            if w == "static" and T[self.i + 1] == "{":
                self.i += 1
                return self.body()
            if w in ("get", "set") and not self.N[self.i + 1] and T[self.i + 1] != "*":
                self.i += 1
                break
            if w in ("static", "async", "accessor") or self.typed and w in _MODIFIERS:
                if self.N[self.i + 1] and w != "static":
                    break
                self.i += 1
            else:
                break
        self.accept("*")
        if self.typed and T[self.i] == "[" and T[self.i + 1] == "id" and T[self.i + 2] == ":":
            self.i += 2
            self.i += 1
            self.type()
            self.expect("]")
            if self.accept(":"):
                self.type()
            return self.semicolon()
        self.property_name()
        if self.typed:
            if T[self.i] in ("?", "!"):
                self.i += 1
        if T[self.i] in ("(", "<"):
            return self.function_rest(True)
        if self.typed and self.accept(":"):
            self.type()
        if self.accept("="):
            function, self.in_function = self.in_function, 0
            self.assignment()
            self.in_function = function
        self.semicolon()

    def property_name(self) -> None:
        t = self.T[self.i]
        if t == "id" or t in ("str", "num", "private") or t in RESERVED:
            self.i += 1
        elif t == "[":
            self.i += 1
            self.assignment()
            self.expect("]")
        else:
            self.fail()

    # -- expressions: each rule tells whether it was a "target", a "pattern" or another value

    def expression(self, allow_in: bool = True) -> str:
        kind = self.assignment(allow_in)
        while self.T[self.i] == ",":
            self.i += 1
            self.assignment(allow_in)
            kind = "value"
        return kind

    def assignment(self, allow_in: bool = True) -> str:
        i = self.i
        T = self.T
        t = T[i]
        if t == "id":
            following = T[i + 1]
            if following in _ENDS_EXPRESSION and self.value(i) != "yield":  # a name alone
                w = self.value(i)
                if w in STRICT:
                    self.strict(w)
                self.i = i + 1
                return "target"
            if following == "=>":
                if self.N[i + 1]:
                    self.fail()
                self.name()
                self.i += 1
                return self.arrow_body(allow_in)
            w = self.value(i)
            if w == "async" and not self.N[i + 1]:
                if following == "id" and T[i + 2] == "=>":
                    self.i = i + 3
                    return self.arrow_body(allow_in)
                if following == "(" and self.arrow_ahead(i + 1) or following == "<" and self.typed:
                    at = self.i
                    self.i += 1
                    if self.arrow(allow_in):
                        return "value"
                    self.i = at
            elif w == "yield" and self.in_function:
                self.i += 1
                if not self.N[self.i] and T[self.i] not in _ENDS_EXPRESSION:
                    self.accept("*")
                    self.assignment(allow_in)
                return "value"
        elif t == "(":
            if self.arrow_ahead(i) and self.arrow(allow_in):
                return "value"
        elif t == "<" and self.typed and self.arrow(allow_in):
            return "value"
        kind = self.conditional(allow_in)
        op = T[self.i]
        if op == ">" and self.shift_assign():
            op = "+="
        if op in ASSIGN:
            if kind != "target" and not (op == "=" and kind == "pattern"):
                self.fail("invalid assignment target")
            self.i += 1
            self.assignment(allow_in)
            return "value"
        return kind

    def strict(self, w: str) -> None:
        if not self.typed or w in ("await",):
            self.fail(f"reserved word {w!r}")

    def shift_assign(self) -> bool:
        """``>>=`` and ``>>>=`` come as single characters; stop before the last."""
        i, T = self.i, self.T
        k = i
        while T[k] == ">" and self.adjacent(k):
            k += 1
        if T[k] == "=" and k - i >= 2 and k - i <= 3:
            self.i = k
            return True
        return False

    def arrow_ahead(self, i: int) -> bool:
        """Whether a parenthesis can be the parameters of an arrow function."""
        close = self.closing(i)
        if close is None:
            return False
        following = self.T[close + 1]
        return following == "=>" or following == ":" and self.typed

    def arrow(self, allow_in: bool) -> bool:
        def head() -> None:
            if self.T[self.i] == "<":
                self.type_parameters()
            self.parameters()
            if self.typed and self.accept(":"):
                self.return_type()
            if self.T[self.i] != "=>" or self.N[self.i]:
                self.fail()

        if self.typed:
            if not self.attempt(head):
                return False
        else:
            head()
        self.i += 1
        self.arrow_body(allow_in)
        return True

    def arrow_body(self, allow_in: bool) -> str:
        if self.T[self.i] == "{":
            self.body()
        else:
            self.in_function += 1
            self.assignment(allow_in)
            self.in_function -= 1
        return "value"

    def conditional(self, allow_in: bool) -> str:
        kind = self.binary(0, allow_in)
        if self.T[self.i] == "?":
            self.i += 1
            self.assignment()
            self.expect(":")
            self.assignment(allow_in)
            return "value"
        return kind

    def operator(self) -> tuple[str, int]:
        """The operator at hand and its number of tokens; ``>`` is put together here."""
        i, T = self.i, self.T
        t = T[i]
        if t != ">":
            return t, 1
        if not self.adjacent(i):
            return ">", 1
        if T[i + 1] == "=":
            return ">=", 2
        if T[i + 1] == "==":  # of a badly cut ">==", which is none
            return "", 1
        if T[i + 1] == ">":
            if self.adjacent(i + 1) and T[i + 2] == ">":
                return (">>>", 3) if not (self.adjacent(i + 2) and T[i + 3] == "=") else ("", 1)
            return (">>", 2) if not (self.adjacent(i + 1) and T[i + 2] == "=") else ("", 1)
        return ">", 1

    def binary(self, least: int, allow_in: bool = True) -> str:
        kind = self.unary()
        T = self.T
        while True:
            t = T[self.i]
            if t in (";", ")", ",", "]"):
                return kind
            if t == "id":
                if self.typed and not self.N[self.i] and self.value(self.i) in ("as", "satisfies"):
                    if least > 8:
                        return kind
                    self.i += 1
                    if T[self.i] == "const":
                        self.i += 1
                    else:
                        self.type()
                    continue
                return kind
            size = 1
            if t == ">":
                t, size = self.operator()
            level = PRECEDENCE.get(t)
            if level is None or level <= least or t == "in" and not allow_in:
                return kind
            if t == "**" and self.was_unary:
                self.fail("a unary operator before '**'")
            self.i += size
            self.binary(level - 1 if t == "**" else level, allow_in)
            kind = "value"

    was_unary = False

    def unary(self) -> str:
        t = self.T[self.i]
        if t in _UNARY:
            self.i += 1
            kind = self.unary()
            if t in ("++", "--"):
                if kind != "target":
                    self.fail("invalid update target")
                self.was_unary = False
            else:
                self.was_unary = True
            return "value"
        if t == "id" and self.T[self.i + 1] not in (".", "(", ";", ",", ")", "[", "=") and self.value(self.i) == "await" and (self.in_function or self.top):
            self.i += 1
            self.unary()
            self.was_unary = True
            return "value"
        if t == "<" and self.typed and not self.jsx:
            self.i += 1
            self.type()
            self.expect(">")
            self.unary()
            return "value"
        self.was_unary = False
        kind = self.left_hand()
        t = self.T[self.i]
        if t in ("++", "--") and not self.N[self.i]:
            if kind != "target":
                self.fail("invalid update target")
            self.i += 1
            return "value"
        return kind

    def left_hand(self) -> str:
        T = self.T
        if T[self.i] == "new":
            kind = self.new()
        else:
            kind = self.primary()
        while True:
            t = T[self.i]
            if t == ".":
                self.i += 1
                self.property_word()
                kind = "target"
            elif t == "(":
                self.arguments()
                kind = "value"
            elif t == "[":
                self.i += 1
                self.expression()
                self.expect("]")
                kind = "target"
            elif t == "?.":
                self.i += 1
                if T[self.i] == "(":
                    self.arguments()
                elif T[self.i] == "[":
                    self.i += 1
                    self.expression()
                    self.expect("]")
                elif self.typed and T[self.i] == "<":
                    self.type_arguments()
                    self.arguments()
                else:
                    self.property_word()
                kind = "value"
            elif t == "tpl" or t == "tpl{":
                self.template()
                kind = "value"
            elif t == "!" and self.typed and not self.N[self.i]:
                self.i += 1
            elif t == "<" and self.typed:
                def call() -> None:
                    self.type_arguments()
                    if T[self.i] not in ("(", "tpl", "tpl{") and not (T[self.i] in _ENDS_EXPRESSION or T[self.i] in (".", "?.", "=", "==", "===")):
                        self.fail()

                if not self.attempt(call):
                    return kind
            else:
                return kind

    def new(self) -> str:
        self.i += 1
        if self.accept("."):
            self.words("target")
            return "value"
        if self.T[self.i] == "new":
            self.new()
        else:
            self.primary()
        while True:
            t = self.T[self.i]
            if t == ".":
                self.i += 1
                self.property_word()
            elif t == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif t == "!" and self.typed:
                self.i += 1
            else:
                break
        if self.typed and self.T[self.i] == "<":
            self.attempt(self.type_arguments)
        if self.T[self.i] == "(":
            self.arguments()
        return "value"

    def arguments(self) -> None:
        T = self.T
        self.i += 1
        while T[self.i] != ")":
            if T[self.i] == "...":
                self.i += 1
            self.assignment()
            if T[self.i] != ")":
                self.expect(",")
        self.i += 1

    def template(self) -> None:
        T = self.T
        if T[self.i] == "tpl":
            self.i += 1
            return
        self.i += 1
        while True:
            self.expression()
            if self.accept("tpl}"):
                return
            self.expect("tpl|")

    def primary(self) -> str:
        i = self.i
        t = self.T[i]
        if t == "id":
            w = self.value(i)
            if w == "async" and self.T[i + 1] == "function" and not self.N[i + 1]:
                self.i += 1
                return self.function_expression()
            if w in STRICT:
                self.strict(w)
            self.i += 1
            return "target"
        if t in ("str", "num", "this", "null", "true", "false", "regex"):
            self.i += 1
            return "value"
        if t == "(":
            self.i += 1
            kind = self.expression()
            self.expect(")")
            return kind if kind == "target" else "value"
        if t == "[":
            self.i += 1
            while self.T[self.i] != "]":
                if self.accept(","):
                    continue
                self.accept("...")
                self.assignment()
                if self.T[self.i] != "]":
                    self.expect(",")
            self.i += 1
            return "pattern"
        if t == "{":
            return self.object()
        if t == "function":
            return self.function_expression()
        if t == "class":
            self.class_(False)
            return "value"
        if t == "@":
            self.decorators()
            self.class_(False)
            return "value"
        if t in ("tpl", "tpl{"):
            self.template()
            return "value"
        if t == "super":
            self.i += 1
            if self.T[self.i] not in ("(", ".", "["):
                self.fail()
            return "value"
        if t == "import":
            self.i += 1
            if self.accept("."):
                self.property_word()
            else:
                if self.T[self.i] != "(":
                    self.fail()
                self.arguments()
            return "value"
        if t == "private" and self.T[i + 1] == "in":
            self.i += 1
            return "value"
        if t == "<" and self.jsx:
            end = self.element(self.P[i])
            self.relex(i + 1, end)
            self.i = i + 1
            return "value"
        self.fail()

    def function_expression(self) -> str:
        self.i += 1
        self.accept("*")
        if self.T[self.i] == "id":
            self.i += 1
        self.function_rest()
        return "value"

    def object(self) -> str:
        self.expect("{")
        T = self.T
        while T[self.i] != "}":
            if self.accept("..."):
                self.assignment()
            else:
                i = self.i
                t, following = T[i], T[i + 1]
                if t == "id" and following in (",", "}"):
                    if self.value(i) in STRICT:
                        self.strict(self.value(i))
                    self.i += 1
                elif t == "id" and following == "=":
                    self.i += 2
                    self.assignment()
                else:
                    if t == "id" and following not in (":", "("):
                        w = self.value(i)
                        if w in ("get", "set") or w == "async" and not self.N[i + 1]:
                            if not (following == "<" and self.typed):
                                self.i += 1
                    star = self.accept("*")
                    moved = self.i > i
                    self.property_name()
                    if T[self.i] in ("(", "<"):
                        self.function_rest()
                    elif moved or star:
                        self.fail()
                    else:
                        self.expect(":")
                        self.assignment()
            if T[self.i] != "}":
                self.expect(",")
        self.i += 1
        return "pattern"

    # -- JSX, on the text itself

    _NAME = re.compile(r"[^\W\d][\w$.:-]*|[$][\w$.:-]*")
    _GAP = re.compile(_SPACE)
    _QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")

    def element(self, at: int) -> int:
        """The offset behind the element that begins at ``at``."""
        text = self.text
        at = self._GAP.match(text, at + 1).end()
        m = self._NAME.match(text, at)
        name = m.group() if m else ""
        at = m.end() if m else at
        while True:
            at = self._GAP.match(text, at).end()
            if text.startswith("/>", at) and name:
                return at + 2
            if text.startswith(">", at):
                at += 1
                break
            if text.startswith("{", at):
                at = self.embedded(at)
                continue
            m = self._NAME.match(text, at) if name else None
            if m is None:
                self.fail("invalid JSX")
            at = self._GAP.match(text, m.end()).end()
            if text.startswith("=", at):
                at = self._GAP.match(text, at + 1).end()
                q = self._QUOTED.match(text, at)
                if q:
                    at = q.end()
                elif text.startswith("{", at):
                    at = self.embedded(at)
                elif text.startswith("<", at):
                    at = self.element(at)
                else:
                    self.fail("invalid JSX attribute")
        while True:
            k = re.compile(r"[<{>}]").search(text, at)
            if k is None:
                self.fail("unclosed JSX element")
            at = k.start()
            c = text[at]
            if c == "{":
                at = self.embedded(at)
            elif c in ">}":
                self.fail("invalid JSX text")
            elif re.compile(r"<\s*/").match(text, at):
                m = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(text, at)
                if m is None or m[1] != name:
                    self.fail("JSX tags do not match")
                return m.end()
            else:
                at = self.element(at)

    def embedded(self, at: int) -> int:
        """The offset behind a braced expression in JSX."""
        sub = type(self).__new__(type(self))
        sub.text, sub.T, sub.P, sub.N, sub.faults, sub.bad, sub.refused, sub.i = self.text, [], [], [], [], {}, set(), 0
        sub.in_function, sub.in_loop, sub.top = self.in_function, 0, False
        sub.lex_from(at + 1)
        sub.T.append("")
        sub.P.append(len(self.text))
        sub.N.append(True)
        try:
            if sub.T[0] != "}":
                sub.accept("...")
                sub.expression()
            if sub.T[sub.i] != "}":
                sub.fail()
        except Broken as broken:
            self.fail(broken.message)
        self.faults += sub.faults
        return sub.P[sub.i] + 1


class TypeScript(Script):
    typed = True
    jsx = False

    def typed_statement(self, w: str, following: str) -> bool:
        i = self.i
        same_line = not self.N[i + 1]
        if w == "interface" and following == "id" and same_line:
            self.interface()
        elif w == "type" and following == "id" and same_line:
            self.i += 1
            self.i += 1
            if self.T[self.i] == "<":
                self.type_parameters()
            self.expect("=")
            self.type()
            self.semicolon()
        elif w in ("namespace", "module") and following in ("id", "str") and same_line:
            self.i += 1
            if not self.accept("str"):
                self.qualified()
            if self.T[self.i] == "{":
                top = self.top
                self.expect("{")
                self.top = True
                self.statements("}")
                self.top = top
                self.expect("}")
            else:
                self.semicolon()
        elif w == "global" and following == "{":
            self.i += 1
            self.block()
        elif w == "declare" and same_line and (following in ("var", "const", "function", "class", "enum") or following == "id"):
            self.i += 1
            self.declared += 1
            try:
                self.statement()
            finally:
                self.declared -= 1
        elif w == "abstract" and following == "class":
            self.i += 1
            self.class_()
        else:
            return False
        return True

    def interface(self) -> None:
        self.i += 1
        self.name()
        if self.T[self.i] == "<":
            self.type_parameters()
        if self.accept("extends"):
            self.type()
            while self.accept(","):
                self.type()
        self.object_type()

    def enum(self) -> None:
        self.i += 1
        self.name()
        self.expect("{")
        while self.T[self.i] != "}":
            self.property_name()
            if self.accept("="):
                self.assignment()
            if self.T[self.i] != "}":
                self.expect(",")
        self.i += 1

    def qualified(self) -> None:
        self.property_word()
        while self.T[self.i] == ".":
            self.i += 1
            self.property_word()

    # -- types

    def type_parameters(self) -> None:
        self.expect("<")
        while True:
            while self.T[self.i] in ("const", "in") or self.T[self.i] == "id" and self.value(self.i) in ("out", "const") and self.T[self.i + 1] == "id":
                self.i += 1
            self.name()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
            if self.T[self.i] == ">":
                break
        self.expect(">")

    def type_arguments(self) -> None:
        self.expect("<")
        self.type()
        while self.accept(","):
            self.type()
        self.expect(">")

    def return_type(self) -> None:
        if self.is_word("asserts") and (self.T[self.i + 1] in ("id", "this")) and not self.N[self.i + 1]:
            self.i += 2
            if self.is_word("is"):
                self.i += 1
                self.type()
            return
        if self.T[self.i] in ("id", "this") and self.word(self.i + 1) == "is" and not self.N[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        T = self.T
        t = T[self.i]
        if t == "id" and T[self.i + 1] in (",", ")", ";", "=", "{", ">"):  # a name alone
            self.i += 1
            return
        if t == "(" and self.function_type_ahead() or t == "<" or t == "new" or t == "id" and T[self.i + 1] == "new" and self.value(self.i) == "abstract":
            if t == "id":
                self.i += 1
            self.accept("new")
            if T[self.i] == "<":
                self.type_parameters()
            self.parameters()
            self.expect("=>")
            self.return_type()
            return
        self.union()
        if T[self.i] == "extends" and not self.N[self.i] and not self.no_conditional:
            self.i += 1
            self.no_conditional += 1
            try:
                self.union()
            finally:
                self.no_conditional -= 1
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    no_conditional = 0

    def function_type_ahead(self) -> bool:
        close = self.closing(self.i)
        return close is not None and self.T[close + 1] == "=>"

    def union(self) -> None:
        self.accept("|")
        self.intersection()
        while self.accept("|"):
            self.intersection()

    def intersection(self) -> None:
        self.accept("&")
        self.type_unary()
        while self.accept("&"):
            self.type_unary()

    def type_unary(self) -> None:
        if self.T[self.i] == "id" and self.value(self.i) in ("keyof", "unique", "readonly", "infer") and self.T[self.i + 1] not in (",", ")", ";", "=", ">", "|", "&", "]", "}", ".", ""):
            infer = self.value(self.i) == "infer"
            self.i += 1
            self.type_unary()
            if infer and self.T[self.i] == "extends":
                self.attempt(self.infer_constraint)
            return
        self.type_primary()
        while self.T[self.i] == "[" and not self.N[self.i]:
            self.i += 1
            if self.T[self.i] != "]":
                self.type()
            self.expect("]")

    def infer_constraint(self) -> None:
        self.i += 1
        self.union()
        if self.T[self.i] == "?":
            self.fail()

    def type_primary(self) -> None:
        t = self.T[self.i]
        if t == "id":
            self.i += 1
            while self.T[self.i] == ".":
                self.i += 1
                self.property_word()
            if self.T[self.i] == "<" and not self.N[self.i]:
                self.type_arguments()
        elif t in ("str", "num", "null", "void", "this", "true", "false", "tpl"):
            self.i += 1
        elif t == "-":
            self.i += 1
            self.expect("num")
        elif t == "(":
            self.i += 1
            self.no_conditional, saved = 0, self.no_conditional
            self.type()
            self.no_conditional = saved
            self.expect(")")
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.i += 1
            while self.T[self.i] != "]":
                self.accept("...")
                if self.T[self.i] == "id" and self.T[self.i + 1] == ":" or self.T[self.i] == "id" and self.T[self.i + 1] == "?" and self.T[self.i + 2] == ":":
                    self.i += 1
                    self.accept("?")
                    self.i += 1
                self.type()
                self.accept("?")
                if self.T[self.i] != "]":
                    self.expect(",")
            self.i += 1
        elif t == "typeof":
            self.i += 1
            if self.T[self.i] == "import":
                self.type_primary()
            else:
                if self.T[self.i] == "this":
                    self.i += 1
                else:
                    self.property_word()
                while self.accept("."):
                    self.property_word()
                if self.T[self.i] == "<" and not self.N[self.i]:
                    self.type_arguments()
        elif t == "import":
            self.i += 1
            self.expect("(")
            self.type()
            if self.accept(","):
                self.object()
            self.expect(")")
            while self.accept("."):
                self.property_word()
            if self.T[self.i] == "<":
                self.type_arguments()
        elif t == "tpl{":
            self.i += 1
            while True:
                self.type()
                if self.accept("tpl}"):
                    break
                self.expect("tpl|")
        else:
            self.fail()

    def object_type(self) -> None:
        self.expect("{")
        T = self.T
        while T[self.i] != "}":
            if T[self.i] in ("+", "-"):
                self.i += 1
            while T[self.i] == "id" and self.value(self.i) in ("readonly", "get", "set") and T[self.i + 1] in ("id", "[", "str", "num") or T[self.i] == "id" and self.value(self.i) in ("readonly",) and T[self.i + 1] in RESERVED:
                self.i += 1
            t = T[self.i]
            if t == "new" and T[self.i + 1] in ("(", "<"):
                self.i += 1
                t = T[self.i]
            if t in ("(", "<"):
                self.signature()
            elif t == "[" and T[self.i + 1] == "id" and T[self.i + 2] in (":", "in"):
                mapped = T[self.i + 2] == "in"
                self.i += 3
                self.type()
                if mapped and self.is_word("as"):
                    self.i += 1
                    self.type()
                self.expect("]")
                if T[self.i] in ("+", "-"):
                    self.i += 1
                self.accept("?")
                if self.accept(":"):
                    self.type()
            else:
                self.property_name()
                self.accept("?")
                if T[self.i] in ("(", "<"):
                    self.signature()
                elif self.accept(":"):
                    self.type()
            if T[self.i] in (",", ";"):
                self.i += 1
            elif T[self.i] != "}" and not self.N[self.i]:
                self.fail()
        self.i += 1

    def signature(self) -> None:
        if self.T[self.i] == "<":
            self.type_parameters()
        self.parameters()
        if self.accept(":"):
            self.return_type()


class TypeScriptX(TypeScript):
    jsx = True


_STATEMENTS = {
    "{": Script.block, "var": Script.variables, "const": Script.variables, "if": Script.if_, "for": Script.for_, "while": Script.while_, "do": Script.do_,
    "continue": Script.jump, "break": Script.jump, "return": Script.return_, "throw": Script.throw, "switch": Script.switch, "try": Script.try_,
    "debugger": Script.debugger, ";": Script.empty, "@": Script.decorated, "import": Script.import_, "export": Script.export,
    "function": Script.function_declaration, "class": Script.class_, "enum": lambda self: self.enum() if self.typed else self.fail(),
}
