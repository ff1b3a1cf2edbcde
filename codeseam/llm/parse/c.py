"""C. Files are read without their headers, so a name in a type's place counts as a type; preprocessor lines are skipped."""

from __future__ import annotations

import re

from codeseam.llm.parse.core import Parser

KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch "
    "typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local __attribute__ __asm__ "
    "__inline __inline__ __restrict __extension__ __typeof__ typeof __volatile__ __const asm".split()
)
_TYPE_WORDS = frozenset("char double float int long short signed unsigned void _Bool _Complex _Imaginary".split())
_QUALIFIERS = frozenset("const volatile restrict _Atomic __restrict __const __extension__".split())
_STORAGE = frozenset("auto extern register static typedef inline _Noreturn _Thread_local __inline __inline__".split())
_TOKEN = re.compile(
    r"((?:[ \t\n\r\f\v]+|\\\r?\n|//(?:[^\n\\]|\\[\s\S])*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*)(?:"
    r"((?:[^\W\d]|[$])[\w$]*)"
    r"|((?:0[xX][0-9a-fA-F]*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01]+|\d*\.\d+(?:[eE][+-]?\d+)?|\d+\.?(?:[eE][+-]?\d+)?)[uUlLfF]{0,3}(?![\w.]))"
    r"|(\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\")|('(?:[^'\\\n]|\\[\s\S])+')"
    r"|(\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\],;:.=+\-*/%&|^<>!~?])"
    r"|(\#)|([\s\S])|\Z)"
)
_DIRECTIVE = re.compile(r"[ \t]*(\w*)((?:\\\r?\n|/\*(?:[^*]|\*(?!/))*\*/|[^\n\\]|\\(?!\r?\n))*)")
PRECEDENCE = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_ENDS = frozenset("; ) , ]".split())


class C(Parser):
    starters = frozenset("if for while do switch return break continue goto static extern typedef struct enum union void int char const".split())

    def lex(self, text: str) -> None:
        at = 1 if text.startswith("﻿") else 0
        T, P, N = self.T, self.P, self.N
        match, keywords = _TOKEN.match, KEYWORDS
        conditions: list[int] = []
        line_start = True
        while True:
            m = match(text, at)
            k = m.lastindex
            if k == 1:
                break
            start, at = m.end(1), m.end()
            newline = "\n" in m[1] or line_start
            if k == 7:
                if not newline:
                    self.add_bad(start, newline, "stray '#'")
                    continue
                d = _DIRECTIVE.match(text, at)
                word = d[1]
                at = d.end()
                if word in ("if", "ifdef", "ifndef"):
                    conditions.append(start)
                elif word in ("else", "elif", "elifdef", "elifndef") and not conditions or word == "endif" and not conditions:
                    self.add_bad(start, newline, f"#{word} without #if")
                elif word == "endif":
                    conditions.pop()
                elif word not in ("include", "define", "undef", "pragma", "error", "warning", "line", "else", "elif", "elifdef", "elifndef", "include_next", "ident", "import", "embed", "") or word == "" and d[2].strip() and not d[2].strip()[0].isdigit():
                    self.add_bad(start, newline, "invalid preprocessing directive")
                elif word == "include" and not re.match(r"\s*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_])", d[2]):
                    self.add_bad(start, newline, "invalid #include")
                line_start = True
                continue
            line_start = False
            if k == 2:
                w = m[2]
                if w in ("L", "u", "U", "u8") and at < len(text) and text[at] in "\"'":
                    continue
                T.append(w if w in keywords else "id")
            elif k == 6:
                T.append(m[6])
            elif k == 3:
                T.append("num")
                if m[3][0] == "0" and m[3].isdigit() and any(c in "89" for c in m[3]):
                    T[-1] = "bad"
                    self.bad[len(T) - 1] = "invalid digit in an octal number"
            elif k in (4, 5):
                T.append("str" if k == 4 else "num")
            else:
                c = m[8]
                self.bad[len(T)] = "unterminated literal" if c in "\"'" else "invalid number" if c.isdigit() else f"invalid character {c!r}"
                T.append("bad")
                if c in "\"'":
                    end = text.find("\n", at)
                    at = len(text) if end < 0 else end
            P.append(start)
            N.append(newline)
        if conditions:
            self.add_bad(conditions[-1], True, "#if without #endif")

    level = 0

    # -- declarations

    def statement(self) -> None:
        if self.level:
            return self.inner()
        T = self.T
        t = T[self.i]
        if t == ";":
            self.i += 1
            return None
        if t == "_Static_assert" or t in ("asm", "__asm__"):
            self.i += 1
            self.parenthesized_tokens()
            self.expect(";")
            return None
        if t == "extern" and T[self.i + 1] == "str":  # for C++ readers
            self.i += 2
            if T[self.i] == "{":
                self.i += 1
                self.statements("}")
                self.expect("}")
                return None
            return self.statement()
        self.external()

    def attributes(self) -> None:
        while self.T[self.i] in ("__attribute__", "_Alignas", "__asm__", "asm"):
            self.i += 1
            self.parenthesized_tokens()

    def parenthesized_tokens(self) -> None:
        self.expect("(")
        depth = 1
        while depth:
            t = self.T[self.i]
            if not t or t == "bad":
                self.fail()
            depth += (t == "(") - (t == ")")
            self.i += 1

    def specifiers(self) -> tuple[bool, bool]:
        """Whether a type was named, and whether it is a typedef."""
        T = self.T
        named = typedef = False
        while True:
            t = T[self.i]
            if t in _STORAGE:
                typedef |= t == "typedef"
                self.i += 1
            elif t in _QUALIFIERS:
                self.i += 1
                if t == "_Atomic" and T[self.i] == "(":
                    self.i += 1
                    self.type_name()
                    self.expect(")")
                    named = True
            elif t in _TYPE_WORDS:
                self.i += 1
                named = True
            elif t in ("struct", "union"):
                self.i += 1
                self.attributes()
                tag = self.accept("id")
                if T[self.i] == "{":
                    self.members()
                elif not tag:
                    self.fail()
                named = True
            elif t == "enum":
                self.i += 1
                self.attributes()
                tag = self.accept("id")
                if T[self.i] == "{":
                    self.i += 1
                    while T[self.i] != "}":
                        self.expect("id")
                        self.attributes()
                        if self.accept("="):
                            self.conditional()
                        if T[self.i] != "}":
                            self.expect(",")
                    self.i += 1
                elif not tag:
                    self.fail()
                named = True
            elif t in ("typeof", "__typeof__"):
                self.i += 1
                self.parenthesized_tokens()
                named = True
            elif t in ("__attribute__", "_Alignas"):
                self.attributes()
            elif t == "id" and not named:
                # a name is the type unless it is what is declared
                if T[self.i + 1] in ("id", "*") or T[self.i + 1] in _QUALIFIERS or T[self.i + 1] in _STORAGE or T[self.i + 1] == "(" and T[self.i + 2] in ("*", "^") or T[self.i + 1] in _TYPE_WORDS or self.abstract and T[self.i + 1] in (",", ")", "["):
                    self.i += 1
                    named = True
                else:
                    return named, typedef
            elif t == "id" and named and T[self.i + 1] in ("id",) and T[self.i + 2] in ("(", ";", "=", ",", "[", ")", "__attribute__"):
                self.i += 1  # a macro among the specifiers
            else:
                return named, typedef

    abstract = False

    def members(self) -> None:
        T = self.T
        self.expect("{")
        while T[self.i] != "}":
            if self.accept(";"):
                continue
            if T[self.i] == "_Static_assert":
                self.i += 1
                self.parenthesized_tokens()
                self.expect(";")
                continue
            named, _ = self.specifiers()
            if not named:
                self.fail()
            if T[self.i] != ";":
                while True:
                    if T[self.i] != ":":
                        self.declarator()
                    if self.accept(":"):
                        self.conditional()
                    self.attributes()
                    if not self.accept(","):
                        break
            self.expect(";")
        self.i += 1

    def pointers(self) -> None:
        while self.T[self.i] in ("*", "^"):
            self.i += 1
            while self.T[self.i] in _QUALIFIERS or self.T[self.i] == "__attribute__":
                if self.T[self.i] == "__attribute__":
                    self.attributes()
                else:
                    self.i += 1

    def declarator(self, abstract: bool = False) -> bool:
        """Whether the outermost thing is a function."""
        T = self.T
        self.pointers()
        self.attributes()
        function = False
        if T[self.i] == "(" and (not abstract or T[self.i + 1] in ("*", "(", "^", "id", "[") and not self.parameter_ahead()):
            self.i += 1
            self.declarator(abstract)
            self.expect(")")
        elif T[self.i] == "id":
            self.i += 1
        elif not abstract:
            self.fail()
        first = True
        while True:
            if T[self.i] == "[":
                self.i += 1
                while T[self.i] in _QUALIFIERS or T[self.i] == "static":
                    self.i += 1
                if T[self.i] == "*" and T[self.i + 1] == "]":
                    self.i += 1
                elif T[self.i] != "]":
                    self.assignment()
                self.expect("]")
            elif T[self.i] == "(":
                self.parameters()
                function |= first
            else:
                break
            first = False
        self.attributes()
        return function

    def parameter_ahead(self) -> bool:
        t = self.T[self.i + 1]
        return t == "id" and self.T[self.i + 2] in ("id", "*", ",", ")")

    def parameters(self) -> None:
        T = self.T
        self.expect("(")
        if T[self.i] == "void" and T[self.i + 1] == ")":
            self.i += 2
            return
        while T[self.i] != ")":
            if self.accept("..."):
                if T[self.i] != ")":
                    self.fail()
                break
            abstract, self.abstract = self.abstract, True
            named, _ = self.specifiers()
            self.abstract = abstract
            if not named:
                self.fail()
            self.declarator(True)
            if T[self.i] != ")":
                self.expect(",")
                if T[self.i] == ")":
                    self.fail()
        self.i += 1

    def external(self) -> None:
        T = self.T
        begin = self.i
        named, typedef = self.specifiers()
        if self.accept(";"):
            if not named:
                self.i -= 1
                self.fail()
            return
        function = self.declarator()
        if function and not typedef:
            if T[self.i] == "{":
                return self.block()
            if (T[self.i] in _TYPE_WORDS or T[self.i] in ("struct", "const", "register", "unsigned") or T[self.i] == "id" and T[self.i + 1] in ("id", "*")) and named:  # parameters in the old way
                while T[self.i] != "{":
                    self.specifiers()
                    self.declarators()
                    self.expect(";")
                return self.block()
        if not named and not function:
            self.i = begin
            self.fail("a declaration is expected")
        self.declarators(True)
        self.expect(";")

    def declarators(self, first: bool = False) -> None:
        while True:
            if not first:
                self.declarator()
            first = False
            if self.accept("="):
                self.initializer()
            if not self.accept(","):
                return

    def initializer(self) -> None:
        T = self.T
        if T[self.i] != "{":
            return self.assignment()
        self.i += 1
        while T[self.i] != "}":
            while T[self.i] in (".", "["):
                if self.accept("."):
                    self.expect("id")
                else:
                    self.i += 1
                    self.conditional()
                    if self.accept("..."):
                        self.conditional()
                    self.expect("]")
                self.accept("=")
            if T[self.i] == "id" and T[self.i + 1] == ":":
                self.i += 2
            self.initializer()
            if T[self.i] != "}":
                self.expect(",")
        self.i += 1
        return None

    def type_name(self) -> None:
        abstract, self.abstract = self.abstract, True
        named, _ = self.specifiers()
        self.abstract = abstract
        if not named:
            self.expect("id")
        self.declarator(True)

    # -- statements

    def block(self) -> None:
        self.expect("{")
        self.level += 1
        self.statements("}")
        self.level -= 1
        self.expect("}")

    def declaration_ahead(self) -> bool:
        T = self.T
        t = T[self.i]
        if t in _TYPE_WORDS or t in _STORAGE or t in _QUALIFIERS or t in ("struct", "union", "enum", "typeof", "__typeof__", "_Alignas", "__attribute__"):
            return True
        if t != "id":
            return False
        following = T[self.i + 1]
        if following == "id" or following in _QUALIFIERS:
            return True
        if following == "*":
            k = self.i + 2
            while T[k] == "*" or T[k] in _QUALIFIERS:
                k += 1
            return T[k] == "id" and T[k + 1] in ("=", ";", ",", "[", ")")
        return False

    def inner(self) -> None:
        T = self.T
        t = T[self.i]
        rule = _STATEMENTS.get(t)
        if rule:
            return rule(self)
        if t == "id" and T[self.i + 1] == ":":
            self.i += 2
            if T[self.i] != "}":
                self.inner()
            return
        if t == "_Static_assert" or t in ("asm", "__asm__"):
            self.i += 1
            while T[self.i] in ("volatile", "__volatile__", "goto"):
                self.i += 1
            self.parenthesized_tokens()
            self.expect(";")
            return
        if self.declaration_ahead():
            named, typedef = self.specifiers()
            if self.accept(";"):
                return
            function = self.declarator()
            if function and T[self.i] == "{":  # a nested function, a common extension
                return self.block()
            self.declarators(True)
            self.expect(";")
            return
        self.expression()
        self.expect(";")

    def body(self) -> None:
        if self.declaration_ahead():
            self.fail("a declaration is not allowed here")
        self.inner()

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
        if T[self.i] != ";":
            if self.declaration_ahead():
                self.specifiers()
                self.declarators()
            else:
                self.expression()
        self.expect(";")
        if T[self.i] != ";":
            self.expression()
        self.expect(";")
        if T[self.i] != ")":
            self.expression()
        self.expect(")")
        self.body()

    def case(self) -> None:
        if self.accept("default"):
            self.expect(":")
        else:
            self.i += 1
            self.conditional()
            if self.accept("..."):
                self.conditional()
            self.expect(":")
        if self.T[self.i] != "}":
            self.inner()

    def goto(self) -> None:
        self.i += 1
        if self.accept("*"):
            self.expression()
        else:
            self.expect("id")
        self.expect(";")

    def jump(self) -> None:
        self.i += 1
        self.expect(";")

    def return_(self) -> None:
        self.i += 1
        if self.T[self.i] != ";":
            self.expression()
        self.expect(";")

    def empty(self) -> None:
        self.i += 1

    # -- expressions

    def expression(self) -> None:
        self.assignment()
        while self.accept(","):
            self.assignment()

    def assignment(self) -> None:
        T = self.T
        if T[self.i] == "id" and T[self.i + 1] in _ENDS:
            self.i += 1
            return
        self.conditional()
        if T[self.i] in _ASSIGN:
            self.i += 1
            self.assignment()

    def conditional(self) -> None:
        self.binary(0)
        if self.accept("?"):
            if self.T[self.i] != ":":
                self.expression()
            self.expect(":")
            self.conditional()

    def binary(self, least: int) -> None:
        self.unary()
        T = self.T
        while True:
            level = PRECEDENCE.get(T[self.i])
            if level is None or level <= least:
                return
            self.i += 1
            self.binary(level)

    def type_ahead(self, i: int) -> bool:
        T = self.T
        t = T[i]
        if t in _TYPE_WORDS or t in _QUALIFIERS or t in ("struct", "union", "enum", "typeof", "__typeof__"):
            return True
        if t != "id":
            return False
        k = i + 1
        while T[k] == "*" or T[k] in _QUALIFIERS:
            k += 1
        if T[k] != ")":
            return False
        if k > i + 1:
            return True
        return T[k + 1] in ("id", "num", "str", "(", "{", "~", "!", "sizeof")

    def unary(self) -> None:
        T = self.T
        t = T[self.i]
        if t in ("++", "--", "&", "*", "+", "-", "~", "!", "&&", "__extension__"):
            if t == "&&":
                self.i += 1
                self.expect("id")
                return
            self.i += 1
            return self.unary()
        if t in ("sizeof", "_Alignof"):
            self.i += 1
            if T[self.i] == "(" and self.type_ahead(self.i + 1) and (T[self.i + 1] != "id" or self.attempt(self.sized)):
                if T[self.i] == "(":
                    self.sized()
                if T[self.i] == "{":
                    self.initializer()
                return
            return self.unary()
        if t == "(" and self.type_ahead(self.i + 1):

            def cast() -> None:
                self.i += 1
                self.type_name()
                self.expect(")")
                if T[self.i] == "{":
                    self.initializer()
                    self.postfix()
                else:
                    self.unary()

            if T[self.i + 1] != "id":
                return cast()
            if self.attempt(cast):
                return
        self.primary()
        self.postfix()

    def sized(self) -> None:
        self.expect("(")
        self.type_name()
        self.expect(")")

    def primary(self) -> None:
        T = self.T
        t = T[self.i]
        if t in ("id", "num"):
            self.i += 1
        elif t == "str":
            while T[self.i] == "str" or T[self.i] == "id" and (T[self.i - 1] == "str" or T[self.i + 1] == "str"):
                self.i += 1
        elif t == "(":
            self.i += 1
            if T[self.i] == "{":
                self.block()
            else:
                self.expression()
            self.expect(")")
        elif t == "_Generic":
            self.i += 1
            self.parenthesized_tokens()
        else:
            self.fail()

    def postfix(self) -> None:
        T = self.T
        while True:
            t = T[self.i]
            if t == "(":
                self.i += 1
                if T[self.i] == ")":
                    self.i += 1
                    continue
                while True:
                    if self.type_argument():
                        pass
                    else:
                        self.assignment()
                    if T[self.i] == ")":
                        break
                    self.expect(",")
                self.i += 1
            elif t == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif t in (".", "->"):
                self.i += 1
                self.expect("id")
            elif t in ("++", "--"):
                self.i += 1
            else:
                return

    def type_argument(self) -> bool:
        """Macros such as ``va_arg`` and ``offsetof`` take types."""
        t = self.T[self.i]
        if t in _TYPE_WORDS or t in ("struct", "union", "enum", "const"):
            self.type_name()
            return True
        if t == "id" and self.T[self.i + 1] == "*" and self.T[self.i + 2] in ("*", ")", ","):
            self.type_name()
            return True
        return False


_STATEMENTS = {
    "{": C.block, "if": C.if_, "for": C.for_, "while": C.while_, "do": C.do_, "switch": C.while_, "case": C.case, "default": C.case, "goto": C.goto, "break": C.jump,
    "continue": C.jump, "return": C.return_, ";": C.empty,
}
