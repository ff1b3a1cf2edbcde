"""Python 3."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Broken, Parser

KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_TOKEN = re.compile(
    r"((?:[ \t\f]+|\\\r?\n)*(?:\#[^\n\r]*)?)(?:"
    r"((?:[^\W\d])\w*)"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+)(?!\w)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?!\w))"
    r"|(\r\n|\n|\r)"
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[()\[\]{},:.;@=+\-*/%&|^~<>!])"
    r"|(['\"])|([\s\S])|\Z)"
)
#: Numbers may be followed by these words without a space.
_NUMBER_WORD = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[jJ]?)(?=(?:and|else|for|if|in|is|not|or)\b)")
_STRING = {
    "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"),
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
_PREFIX = frozenset("r u b f t br rb fr rf tr rt".split())
_ASSIGN = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
PRECEDENCE = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_COMPARE = frozenset("< > == >= <= != in is".split())
_ENDS = frozenset(") ] } , : = newline ;".split()) | {""}


class Python(Parser):
    starters = frozenset("def class if for while try with return import from raise pass break continue assert del global nonlocal async @ id".split())

    def lex(self, text: str) -> None:
        T, P, N = self.T, self.P, self.N
        if "\0" in text:
            self.add_bad(text.index("\0"), True, "null byte")
            self.whole = True
        at = 1 if text.startswith("﻿") else 0
        match = _TOKEN.match
        indents, depth, line_start = [(0, 0)], 0, True
        n = len(text)
        while at < n:
            if line_start and not depth:
                line_start = False
                m = _INDENT.match(text, at)
                if m[2] or m.end() >= n and not text[m.end() :]:  # a blank line or a comment alone
                    at = m.end()
                    line_start = True
                    if at >= n:
                        break
                    continue
                wide = narrow = 0
                for c in m[1]:
                    if c == "\t":
                        wide, narrow = wide + 8 - wide % 8, narrow + 1
                    elif c == "\f":
                        wide = narrow = 0
                    else:
                        wide, narrow = wide + 1, narrow + 1
                at = m.end(1)
                if wide > indents[-1][0]:
                    if narrow <= indents[-1][1]:
                        self.add_bad(at, True, "inconsistent use of tabs and spaces")
                    indents.append((wide, narrow))
                    self.add("indent", at, True)
                else:
                    while wide < indents[-1][0]:
                        indents.pop()
                        self.add("dedent", at, True)
                    if wide != indents[-1][0]:
                        self.add_bad(at, True, "unindent matches no outer level")
                        indents.append((wide, narrow))
                        self.add("indent", at, True)
                    elif narrow != indents[-1][1]:
                        self.add_bad(at, True, "inconsistent use of tabs and spaces")
            m = match(text, at)
            k = m.lastindex
            if k == 1:
                break
            start, at = m.end(1), m.end()
            if k == 2:
                w = m[2]
                if at < n and text[at] in "'\"" and w.lower() in _PREFIX:
                    at = self.string(start, at, w.lower())
                    continue
                T.append(w if w in KEYWORDS else "id")
            elif k == 5:
                p = m[5]
                if p in "([{":
                    depth += 1
                elif p in ")]}":
                    depth = max(0, depth - 1)
                T.append(p)
            elif k == 3:
                T.append("num")
                if m[3][0] == "0" and len(m[3]) > 1 and m[3].replace("_", "").isdigit() and m[3].strip("0_"):
                    T[-1] = "bad"
                    self.bad[len(T) - 1] = "leading zeros in a number"
            elif k == 4:
                if depth:
                    continue
                line_start = True
                T.append("newline")
            elif k == 6:
                at = self.string(start, start, "")
                continue
            else:
                c = m[7]
                w = _NUMBER_WORD.match(text, start) if c.isdigit() else None
                if w:
                    T.append("num")
                    at = w.end()
                else:
                    self.bad[len(T)] = "invalid number" if c.isdigit() else f"invalid character {c!r}"
                    T.append("bad")
            P.append(start)
            N.append(False)
        if T and T[-1] not in ("newline", "dedent"):
            self.add("newline", n, True)
        for _ in indents[1:]:
            self.add("dedent", n, True)

    whole = False

    def string(self, start: int, quote: int, prefix: str) -> int:
        text = self.text
        mark = text[quote : quote + 3]
        if mark not in ("'''", '"""'):
            mark = text[quote]
        if "f" in prefix or "t" in prefix:
            end = self.formatted(quote + len(mark), mark, "r" in prefix)
        else:
            m = _STRING[mark].match(text, quote + len(mark))
            end = m.end() if m else -1
        if end < 0:
            self.add_bad(start, False, "unterminated string")
            if len(mark) == 3:
                return len(text)
            stop = text.find("\n", quote)
            return len(text) if stop < 0 else stop
        if "b" in prefix and not text[quote:end].isascii():
            self.add_bad(start, False, "bytes can only hold ASCII")
        else:
            self.add("bytes" if "b" in prefix else "str", start, False)
        return end

    def formatted(self, at: int, mark: str, raw: bool) -> int:
        """The end of a formatted string, or -1 if its braces or marks do not close; its expressions are checked later."""
        text, n = self.text, len(self.text)
        while at < n:
            c = text[at]
            if text.startswith(mark, at):
                return at + len(mark)
            if c == "\\" and not raw:
                at += 2
                if text.startswith("N{", at - 1):
                    at = text.find("}", at) + 1 or n
            elif c == "{":
                if text.startswith("{{", at):
                    at += 2
                    continue
                at = self.field(at + 1, mark)
                if at < 0:
                    return -1
            elif c == "}":
                if not text.startswith("}}", at):
                    return -1
                at += 2
            elif c == "\n" and len(mark) == 1:
                return -1
            else:
                at += 1
        return -1

    def field(self, at: int, mark: str) -> int:
        """Behind a replacement field that begins at ``at``; its expression is put aside."""
        text, n, begin, stack = self.text, len(self.text), at, []
        while at < n:
            c = text[at]
            if c in "'\"":
                q = text[at : at + 3]
                q = q if q in ("'''", '"""') else c
                m = _STRING[q].match(text, at + len(q))
                if m is None:
                    return -1
                at = m.end()
                continue
            if c in "([{":
                stack.append(c)
            elif c in ")]" or c == "}" and stack:
                if not stack:
                    return -1
                stack.pop()
            elif c == "\n" and len(mark) == 1 and not stack:
                pass
            elif not stack and (c == "}" or c == ":" or c == "!" and text[at + 1 : at + 2] != "="):
                self.inner.append((begin, text[begin:at]))
                if c == "!":
                    at += 1
                    while at < n and text[at].isalnum():
                        at += 1
                    c = text[at : at + 1]
                if c == ":":
                    at += 1
                    while at < n and text[at] != "}":
                        if text[at] == "{":
                            at = self.field(at + 1, mark)
                            if at < 0:
                                return -1
                        elif text.startswith(mark, at) or text[at] == "\n" and len(mark) == 1:
                            return -1
                        else:
                            at += 1
                return at + 1 if text[at : at + 1] == "}" else -1
            at += 1
        return -1

    def __init__(self, text: str):
        self.inner: list[tuple[int, str]] = []
        super().__init__(text)

    def check(self):
        if not self.whole:
            for at, source in self.inner:
                source = re.sub(r"=\s*$", "", source) if not re.search(r"[=!<>]=\s*$", source) else source
                sub = Python("(" + source + "\n)\n") if source.strip() else None
                if sub is None or sub.check():
                    self.faults.append((at, "invalid expression in a formatted string"))
        return super().check()

    # -- statements

    def program(self) -> None:
        if self.whole:
            self.faults.append((self.text.index("\0"), "null byte"))
            self.i = len(self.T) - 1
            return
        self.statements("")

    def recover(self, at: int, begin: int, end: str) -> None:
        """To behind the logical line and the block that hangs on it."""
        T = self.T
        i = max(at, begin)
        while T[i] and T[i] not in ("newline", "dedent") and not (T[i] == "indent" and i > begin):
            i += 1
        if T[i] == "newline":
            i += 1
        if T[i] == "indent":
            depth = 0
            while T[i]:
                depth += (T[i] == "indent") - (T[i] == "dedent")
                i += 1
                if not depth:
                    break
        elif i == begin and T[i] == "dedent":
            i += end != "dedent"
        self.i = max(i, begin) if T[max(i, begin)] == end else max(i, begin + 1)

    def statement(self) -> None:
        t = self.T[self.i]
        rule = _COMPOUND.get(t)
        if rule:
            return rule(self)
        if t == "id":
            if self.T[self.i + 1] not in ("=", ".", "(", "newline") or self.T[self.i + 1] == "(":
                w = self.value(self.i)
                if w == "match" and self.attempt(self.match_head):
                    return self.match_cases()
                if w == "type" and self.T[self.i + 1] == "id" and self.attempt(self.type_alias):
                    return None
        self.simple_line()

    def simple_line(self) -> None:
        T = self.T
        while True:
            self.simple()
            if T[self.i] == ";":
                self.i += 1
                if T[self.i] != "newline":
                    continue
            if T[self.i] != "newline":
                self.fail()
            self.i += 1
            return

    def block(self) -> None:
        self.expect(":")
        if self.T[self.i] != "newline":
            return self.simple_line()
        self.i += 1
        if self.T[self.i] != "indent":
            self.fail("expected an indented block")
        self.i += 1
        self.statements("dedent")
        self.expect("dedent")

    def simple(self) -> None:
        t = self.T[self.i]
        rule = _SIMPLE.get(t)
        if rule:
            return rule(self)
        kind = self.star_expressions()
        t = self.T[self.i]
        if t == "=":
            while self.T[self.i] == "=":
                if kind not in ("target", "targets"):
                    self.fail("cannot assign here")
                self.i += 1
                kind = self.yield_() if self.T[self.i] == "yield" else self.star_expressions()
        elif t in _ASSIGN:
            if kind != "target":
                self.fail("cannot assign here")
            self.i += 1
            if self.T[self.i] == "yield":
                self.yield_()
            else:
                self.star_expressions()
        elif t == ":":
            if kind != "target":
                self.fail()
            self.i += 1
            self.expression()
            if self.accept("="):
                if self.T[self.i] == "yield":
                    self.yield_()
                else:
                    self.star_expressions()
        elif self.starred and kind == "starred":
            self.fail("starred expression here")

    starred = False

    def word(self) -> None:
        self.i += 1

    def return_(self) -> None:
        self.i += 1
        if self.T[self.i] not in ("newline", ";"):
            self.star_expressions()

    def raise_(self) -> None:
        self.i += 1
        if self.T[self.i] not in ("newline", ";"):
            self.expression()
            if self.accept("from"):
                self.expression()

    def names(self) -> None:
        self.i += 1
        self.expect("id")
        while self.accept(","):
            self.expect("id")

    def delete(self) -> None:
        self.i += 1
        kind = self.star_expressions()
        if kind not in ("target", "targets"):
            self.fail("cannot delete this")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.accept(","):
            self.expression()

    def dotted(self) -> None:
        self.expect("id")
        while self.accept("."):
            self.expect("id")

    def import_(self) -> None:
        self.i += 1
        while True:
            self.dotted()
            if self.accept("as"):
                self.expect("id")
            if not self.accept(","):
                return

    def from_(self) -> None:
        self.i += 1
        dots = False
        while self.T[self.i] in (".", "..."):
            self.i += 1
            dots = True
        if not dots or self.T[self.i] == "id":
            self.dotted()
        self.expect("import")
        if self.accept("*"):
            return
        paren = self.accept("(")
        while True:
            self.expect("id")
            if self.accept("as"):
                self.expect("id")
            if not self.accept(","):
                break
            if paren and self.T[self.i] == ")":
                break
        if paren:
            self.expect(")")

    def if_(self) -> None:
        self.i += 1
        self.named()
        self.block()
        while self.T[self.i] == "elif":
            self.i += 1
            self.named()
            self.block()
        if self.accept("else"):
            self.block()

    def while_(self) -> None:
        self.i += 1
        self.named()
        self.block()
        if self.accept("else"):
            self.block()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.expect("in")
        self.star_expressions()
        self.block()
        if self.accept("else"):
            self.block()

    def targets(self) -> None:
        self.no_in += 1
        kind = self.star_expressions()
        self.no_in -= 1
        if kind not in ("target", "targets", "starred"):
            self.fail("cannot assign here")

    no_in = 0

    def try_(self) -> None:
        self.i += 1
        self.block()
        caught = False
        while self.T[self.i] == "except":
            self.i += 1
            caught = True
            self.accept("*")
            if self.T[self.i] != ":":
                self.expression()
                if self.T[self.i] == ",":
                    while self.accept(","):
                        self.expression()
                elif self.accept("as"):
                    self.expect("id")
            self.block()
        if caught and self.accept("else"):
            self.block()
        if self.accept("finally"):
            self.block()
        elif not caught:
            self.fail("expected 'except' or 'finally'")

    def with_(self) -> None:
        self.i += 1

        def grouped() -> None:
            self.expect("(")
            while True:
                self.expression()
                if self.accept("as"):
                    self.target()
                if not self.accept(",") or self.T[self.i] == ")":
                    break
            self.expect(")")
            if self.T[self.i] != ":":
                self.fail()

        if self.T[self.i] != "(" or not self.attempt(grouped):
            while True:
                self.expression()
                if self.accept("as"):
                    self.target()
                if not self.accept(","):
                    break
        self.block()

    def target(self) -> None:
        if self.T[self.i] == "*":
            self.i += 1
        if self.primary() not in ("target", "targets"):
            self.fail("cannot assign here")

    def decorated(self) -> None:
        while self.accept("@"):
            self.named()
            self.expect("newline")
        if self.T[self.i] not in ("def", "class", "async"):
            self.fail()
        self.statement()

    def async_(self) -> None:
        self.i += 1
        if self.T[self.i] not in ("def", "for", "with"):
            self.fail()
        self.statement()

    def def_(self) -> None:
        self.i += 1
        self.expect("id")
        if self.T[self.i] == "[":
            self.type_parameters()
        self.expect("(")
        self.parameters(")", True)
        self.expect(")")
        if self.accept("->"):
            self.expression()
        self.block()

    def type_parameters(self) -> None:
        self.expect("[")
        while True:
            if self.T[self.i] in ("*", "**"):
                self.i += 1
            self.expect("id")
            if self.accept(":"):
                self.expression()
            if self.accept("="):
                self.accept("*")
                self.expression()
            if not self.accept(",") or self.T[self.i] == "]":
                break
        self.expect("]")

    def type_alias(self) -> None:
        self.i += 1
        self.expect("id")
        if self.T[self.i] == "[":
            self.type_parameters()
        self.expect("=")
        self.expression()
        self.expect("newline")

    def parameters(self, end: str, annotated: bool) -> None:
        T = self.T
        default = star = False
        while T[self.i] != end:
            t = T[self.i]
            if t == "/":
                self.i += 1
            elif t == "*":
                if star:
                    self.fail()
                star, default = True, False
                self.i += 1
                if T[self.i] == ",":
                    if T[self.i + 1] in (end, "**"):
                        self.fail("named arguments must follow '*'")
                else:
                    self.expect("id")
                    if annotated and self.accept(":"):
                        self.accept("*")
                        self.expression()
            elif t == "**":
                self.i += 1
                self.expect("id")
                if annotated and self.accept(":"):
                    self.expression()
                self.accept(",")
                if T[self.i] != end:
                    self.fail()
                return
            else:
                self.expect("id")
                if annotated and self.accept(":"):
                    self.expression()
                if self.accept("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default follows one with default")
            if T[self.i] != end:
                self.expect(",")

    def class_(self) -> None:
        self.i += 1
        self.expect("id")
        if self.T[self.i] == "[":
            self.type_parameters()
        if self.T[self.i] == "(":
            self.arguments()
        self.block()

    # -- match

    def match_head(self) -> None:
        self.i += 1
        self.star_expressions()
        self.expect(":")
        self.expect("newline")
        self.expect("indent")
        if not (self.T[self.i] == "id" and self.value(self.i) == "case"):
            self.fail()

    def match_cases(self) -> None:
        while self.T[self.i] != "dedent":
            if not (self.T[self.i] == "id" and self.value(self.i) == "case"):
                self.fail()
            self.i += 1
            self.pattern_list()
            if self.accept("if"):
                self.named()
            self.block()
        self.i += 1

    def pattern_list(self) -> None:
        self.pattern_as()
        while self.accept(","):
            if self.T[self.i] in (":", "if"):
                return
            self.pattern_as()

    def pattern_as(self) -> None:
        if self.accept("*"):
            self.expect("id")
            return
        self.pattern()
        while self.accept("|"):
            self.pattern()
        if self.accept("as"):
            self.expect("id")

    def pattern(self) -> None:
        T = self.T
        t = T[self.i]
        if t in ("str", "bytes"):
            while T[self.i] in ("str", "bytes"):
                self.i += 1
        elif t in ("None", "True", "False"):
            self.i += 1
        elif t == "num" or t == "-":
            self.accept("-")
            self.expect("num")
            if T[self.i] in ("+", "-"):
                self.i += 1
                self.expect("num")
        elif t in ("(", "["):
            close = ")" if t == "(" else "]"
            self.i += 1
            while T[self.i] != close:
                self.pattern_as()
                if T[self.i] != close:
                    self.expect(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while T[self.i] != "}":
                if self.accept("**"):
                    self.expect("id")
                else:
                    if T[self.i] == "id":
                        self.dotted()
                    else:
                        self.pattern()
                    self.expect(":")
                    self.pattern_as()
                if T[self.i] != "}":
                    self.expect(",")
            self.i += 1
        else:
            self.dotted()
            if self.accept("("):
                while T[self.i] != ")":
                    if T[self.i] == "id" and T[self.i + 1] == "=":
                        self.i += 2
                    self.pattern_as()
                    if T[self.i] != ")":
                        self.expect(",")
                self.i += 1

    # -- expressions

    def star_expressions(self) -> str:
        """One expression or a tuple without parentheses."""
        T = self.T
        kind = self.star_expression()
        if T[self.i] != ",":
            return kind
        good = kind in ("target", "targets", "starred")
        while T[self.i] == ",":
            self.i += 1
            if T[self.i] in _ENDS or T[self.i] in _ASSIGN or self.no_in and T[self.i] == "in":
                break
            good &= self.star_expression() in ("target", "targets", "starred")
        return "targets" if good else "value"

    def star_expression(self) -> str:
        if self.T[self.i] == "*":
            self.i += 1
            kind = self.binary(0)
            self.starred = True
            return "starred" if kind in ("target", "targets") else "value"
        if self.T[self.i] == "yield":
            return self.yield_()
        return self.named()

    def yield_(self) -> str:
        self.i += 1
        if self.accept("from"):
            self.expression()
        elif self.T[self.i] not in _ENDS:
            self.star_expressions()
        return "value"

    def named(self) -> str:
        if self.T[self.i] == "id" and self.T[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return "value"
        return self.expression()

    def expression(self) -> str:
        T = self.T
        t = T[self.i]
        if t == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.i += 1
            no_in, self.no_in = self.no_in, 0
            self.expression()
            self.no_in = no_in
            return "value"
        if t == "id" and T[self.i + 1] in _ENDS:
            self.i += 1
            return "target"
        kind = self.disjunction()
        if T[self.i] == "if":
            self.i += 1
            self.disjunction()
            self.expect("else")
            self.expression()
            return "value"
        return kind

    def disjunction(self) -> str:
        kind = self.inversion()
        while self.T[self.i] in ("and", "or"):
            self.i += 1
            self.inversion()
            kind = "value"
        return kind

    def inversion(self) -> str:
        if self.T[self.i] == "not":
            while self.accept("not"):
                pass
            self.comparison()
            return "value"
        return self.comparison()

    def comparison(self) -> str:
        T = self.T
        kind = self.binary(0)
        while True:
            t = T[self.i]
            if t in _COMPARE:
                if t == "in" and self.no_in:
                    return kind
                self.i += 1
                if t == "is":
                    self.accept("not")
            elif t == "not" and T[self.i + 1] == "in":
                self.i += 2
            else:
                return kind
            self.binary(0)
            kind = "value"

    def binary(self, least: int) -> str:
        kind = self.unary()
        T = self.T
        while True:
            level = PRECEDENCE.get(T[self.i])
            if level is None or level <= least:
                return kind
            self.i += 1
            self.binary(level)
            kind = "value"

    def unary(self) -> str:
        T = self.T
        if T[self.i] in ("+", "-", "~"):
            while T[self.i] in ("+", "-", "~"):
                self.i += 1
            self.power()
            return "value"
        return self.power()

    def power(self) -> str:
        awaited = self.accept("await")
        kind = self.primary()
        if self.T[self.i] == "**":
            self.i += 1
            self.unary()
            return "value"
        return "value" if awaited else kind

    def primary(self) -> str:
        T = self.T
        kind = self.atom()
        while True:
            t = T[self.i]
            if t == ".":
                self.i += 1
                self.expect("id")
                kind = "target"
            elif t == "(":
                self.arguments()
                kind = "value"
            elif t == "[":
                self.i += 1
                self.slices()
                self.expect("]")
                kind = "target"
            else:
                return kind

    def arguments(self) -> None:
        T = self.T
        self.i += 1
        no_in, self.no_in = self.no_in, 0
        keyword = False
        while T[self.i] != ")":
            t = T[self.i]
            if t == "*":
                self.i += 1
                self.expression()
            elif t == "**":
                self.i += 1
                self.expression()
                keyword = True
            elif t == "id" and T[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                if keyword:
                    at = self.i
                    self.named()
                    if T[self.i] in ("for", "async"):
                        self.comprehension()
                    self.i = at
                    self.fail("positional argument follows keyword argument")
                self.named()
                if T[self.i] in ("for", "async"):
                    self.comprehension()
            if T[self.i] != ")":
                self.expect(",")
        self.i += 1
        self.no_in = no_in

    def slices(self) -> None:
        T = self.T
        no_in, self.no_in = self.no_in, 0
        if T[self.i] == "]":
            self.fail()
        while T[self.i] != "]":
            if T[self.i] == "*":
                self.i += 1
                self.binary(0)
            else:
                if T[self.i] != ":":
                    self.named()
                if self.accept(":"):
                    if T[self.i] not in (":", "]", ","):
                        self.expression()
                    if self.accept(":") and T[self.i] not in ("]", ","):
                        self.expression()
            if T[self.i] != "]":
                self.expect(",")
        self.no_in = no_in

    def comprehension(self) -> None:
        while self.T[self.i] in ("for", "async"):
            if self.accept("async") and self.T[self.i] != "for":
                self.fail()
            self.i += 1
            self.targets()
            self.expect("in")
            self.disjunction()
            while self.accept("if"):
                if self.T[self.i] == "id" and self.T[self.i + 1] == ":=":
                    self.named()
                else:
                    self.disjunction()

    def atom(self) -> str:
        T = self.T
        t = T[self.i]
        if t == "id":
            self.i += 1
            return "target"
        if t in ("num", "None", "True", "False", "..."):
            self.i += 1
            return "value"
        if t == "str" or t == "bytes":
            while T[self.i] == t:
                self.i += 1
            if T[self.i] in ("str", "bytes"):
                self.fail("bytes and text next to each other")
            return "value"
        if t == "(":
            self.i += 1
            no_in, self.no_in = self.no_in, 0
            if T[self.i] == ")":
                self.i += 1
                self.no_in = no_in
                return "targets"
            first = self.star_expression()
            if T[self.i] in ("for", "async"):
                self.comprehension()
                kind = "value"
            elif T[self.i] == ",":
                good = first in ("target", "targets", "starred")
                while self.accept(","):
                    if T[self.i] == ")":
                        break
                    good &= self.star_expression() in ("target", "targets", "starred")
                kind = "targets" if good else "value"
            else:
                if first == "starred":
                    self.fail("starred expression here")
                kind = first
            self.expect(")")
            self.no_in = no_in
            return kind
        if t == "[":
            self.i += 1
            no_in, self.no_in = self.no_in, 0
            good = True
            if T[self.i] != "]":
                good = self.star_expression() in ("target", "targets", "starred")
                if T[self.i] in ("for", "async"):
                    self.comprehension()
                    good = False
                while self.accept(","):
                    if T[self.i] == "]":
                        break
                    good &= self.star_expression() in ("target", "targets", "starred")
            self.expect("]")
            self.no_in = no_in
            return "targets" if good else "value"
        if t == "{":
            self.i += 1
            no_in, self.no_in = self.no_in, 0
            mapping = None
            while T[self.i] != "}":
                if self.accept("**"):
                    self.binary(0)
                    pair = True
                elif self.accept("*"):
                    self.binary(0)
                    pair = False
                else:
                    self.named()
                    pair = self.accept(":")
                    if pair:
                        self.expression()
                    if T[self.i] in ("for", "async"):
                        self.comprehension()
                if mapping is None:
                    mapping = pair
                elif mapping != pair:
                    self.fail()
                if T[self.i] != "}":
                    self.expect(",")
            self.i += 1
            self.no_in = no_in
            return "value"
        if t == "lambda" or t == "yield":
            self.fail()
        self.fail()


_INDENT = re.compile(r"([ \t\f]*)((?:\#[^\n\r]*)?(?:\r\n|\n|\r)|\#[^\n\r]*\Z)?")
_COMPOUND = {
    "if": Python.if_, "while": Python.while_, "for": Python.for_, "try": Python.try_, "with": Python.with_, "def": Python.def_, "class": Python.class_,
    "async": Python.async_, "@": Python.decorated,
}
_SIMPLE = {
    "pass": Python.word, "break": Python.word, "continue": Python.word, "return": Python.return_, "raise": Python.raise_, "global": Python.names, "nonlocal": Python.names,
    "del": Python.delete, "assert": Python.assert_, "import": Python.import_, "from": Python.from_,
}
