"""Functions paired with their documentation.

Method: recursive patterns of the ``regex`` library capture a declaration's comment, its signature and its balanced body
in one match; strings, characters and comments are taken as wholes, so brackets inside them do not count. The match
begins at the first of the comments above the symbol's first line; in Python the string that begins the body is the
comment, if there is one. Captures whose comment is trivial are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.session import broadcast_if_small, checkpointed

# -- what a documentation says -----------------------------------------------------------------------------------------

_TAG = re.compile(r"^\s*(?:[@\\](?:\w|\.)+|:[\w ]+:|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields|Examples?|Usage|See also|Since|Version|Section)\s*:|\{@\w+[^}]*\})", re.I)
_BLOCK_TAG = re.compile(r"^\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields|Examples?|Usage)\s*:\s*$", re.I)
_PLACEHOLDER = re.compile(
    r"""(?ix) ^\s*(?:
      (?:todo|fixme|xxx|tbd|hack|wip)\b.*
      | (?:please\s+)?(?:add|write|insert|fill\s+in|put|needs?|missing)\s+(?:a\s+|an\s+|the\s+|some\s+|more\s+)?(?:doc\w*|summary|description|comment\w*|text|content|explanation|details?)\b.*
      | (?:no|missing|empty)\s+(?:description|doc\w*|summary|comment\w*)\b.*
      | (?:description|summary|documentation|doc(?:s|string)?|comment|undocumented|not\s+documented|n/?a|none|placeholder|lorem\s+ipsum.*|\.\.\.|…|tba|function|method|helper|constructor|describe\s+.*here|short\s+description.*|to\s+be\s+(?:documented|written|done|defined).*|documentation\s+(?:goes|to\s+follow|pending).*|auto-?generated\s+(?:method\s+|function\s+)?(?:stub|doc\w*|comment).*)
      )[\s.:!]*$"""
)
_TOOL = re.compile(
    r"""(?ix) ^\s*(?:
      eslint | jshint | jslint | tslint | stylelint | prettier-ignore | noqa\b | nosonar\b | nosec\b | nolint | pylint\s*: | flake8\s*: | mypy\s*: | type\s*:\s*ignore | pyright\s*: | ruff\s*: | isort\s*: | yapf\s*:
      | fmt\s*:\s*(?:on|off) | black\s*: | pragma\b | istanbul\s+ignore | c8\s+ignore | v8\s+ignore | coverage\s*: | codecov | clang-(?:format|tidy) | checkstyle | rubocop | swiftlint | ktlint | spotless | go:\w+ | \+build
      | @?ts-(?:ignore|expect-error|nocheck|check) | @(?:suppress\w*|generated|flow|jest\w*|vitest\w*) | suppress\s*warnings | language\s*=\s*\w+$ | vim?\s*: | -\*- | endregion\b | region\s*$ | webpackChunkName | sourceMappingURL | lint-?(?:ignore|disable) | biome-ignore | deno-lint | cspell | spell-?checker | markdownlint | detect-secrets
      ).*$"""
)
_OWNER = re.compile(
    r"""(?ix) ^\s*(?:
      spdx-\S* | (?:\(c\)|©|copyright)\b | all\s+rights\s+reserved | licen[sc]ed?\b\s*(?:under|:|to\b) | this\s+(?:file|code|source)\s+(?:belongs|is\s+licen[sc]ed|is\s+part\s+of)\b
      | (?:authors?|owners?|maintainers?|reviewers?|contact|code\s*owners?)\s*: | (?:written|created|maintained|owned|authored|contributed)\s+by\b | owned\s+by\b | (?:last\s+)?(?:modified|changed|edited|updated)\s+(?:by|on)\b
      ).*$"""
)
_DIVIDER = re.compile(r"^[\s\W_]*$")
_CODE = re.compile(
    r"""(?x) ^\s*(?:
      (?:[\w$]+(?:\.[\w$]+)*\s*(?:\[[^\]]*\])?\s*(?::=|[-+*/|&^%]?=(?!=)|=>)\s*\S.*)                     # an assignment
      | (?:(?:const|let|var|val|final|auto|int|long|double|float|bool|boolean|char|String|static|public|private|protected|export|import|from|def|func|fn|class|package|using|namespace|\#include|\#define)\s+[\w$<>\[\]"'.{*]+.*(?:[;{(=:]|\bimport\b).*)
      | (?:await\s+|return\s+|throw\s+|raise\s+|yield\s+|new\s+|delete\s+|print\s*)?[\w$]+(?:(?:\.|->|::)[\w$]+)*\((?:.*)\)\s*[;{]?\s*   # a call alone
      | (?:if|for|while|switch|elif|else\s+if|catch|with|match)\b\s*.*[:{]\s*$
      | (?:return|break|continue|pass|else|try|finally|do)\b[^.!?]*[;:{]?\s*$(?<=[;:{)\]]) | (?:return|break|continue|pass)\s*;?\s*$
      | .*;\s*$ | [{}\[\]();,\s]+$ | </?\w+[^>]*>\s*$
      )$"""
)
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+[!/]?|\#+!?|--+|;+|%+|<!--|\"\"\"|'''|[rRuUfFbB]{1,2}(?=\"\"\"|'''))|(?:\*+/|-->|\"\"\"|''')\s*$")
_INLINE_TAG = re.compile(r"\{@(\w+)\s*([^}]*)\}")
_SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯฀-๿]")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")

# Words that add nothing to a name.
_EMPTY_WORDS = set(
    "a an the this that these those its it is are be of for to in on at by with from and or as into function method helper procedure routine func constructor "
    "getter setter accessor wrapper utility implementation impl definition here does do class object member callback handler main default simple simply just "
    "given new value values some any".split()
)


def _stem(word: str) -> str:
    """Enough to see ``publishes`` in ``publish`` and ``tries`` in ``try``."""
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 2 and not (end == "s" and word.endswith("ss")):
            word = word[: len(word) - len(end)] + put
            break
    word = word[:-1] if word.endswith("e") and len(word) > 3 else word
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def prose(doc: str) -> str:
    """What a documentation says in words: without comment marks, tags, examples, placeholders, notes to tools or about
    ownership, dividers and code."""
    kept, skip_from = [], None
    for raw in doc.replace("\r\n", "\n").split("\n"):
        line, before = raw, None
        while line != before:  # marks can stand one in another
            before, line = line, _MARKS.sub("", line)
        indent = len(line) - len(line.lstrip())
        text = line.strip()
        if skip_from is not None:  # a tag's or example's block is deeper than its head
            if not text or indent > skip_from:
                continue
            skip_from = None
        if _BLOCK_TAG.match(line):
            skip_from = indent
            continue
        if not text or _TAG.match(text) or _PLACEHOLDER.match(text) or _TOOL.match(text) or _OWNER.match(text) or _DIVIDER.match(text) or _CODE.match(text):
            continue
        kept.append(_INLINE_TAG.sub(lambda m: m[2] if m[1].lower() in ("link", "linkplain", "code", "literal") else "", text))
    return "\n".join(kept).strip()


def tells(doc: str | None, name: str | None) -> bool:
    """True if the documentation says what the function does, and not just its name again."""
    if not doc:
        return False
    text = prose(doc)
    if not text:
        return False
    if len(_SPACELESS.findall(text)) >= 4:
        return True
    own = {_stem(w.lower()) for w in _NAME_WORD.findall(name or "")} | {_stem("".join(_NAME_WORD.findall(name or "")).lower())}
    words = [w.lower() for w in _WORD.findall(re.sub(r"\b" + re.escape(name) + r"\b", " ", text) if name else text)]
    split = [p.lower() for w in _WORD.findall(text) for p in _NAME_WORD.findall(w)]
    new = {_stem(w) for w in words if w not in _EMPTY_WORDS} - own
    if all(_stem(p) in own or p in _EMPTY_WORDS for p in split):
        return False
    return len(new) >= 2 or len(new) == 1 and len(words) >= 3


# -- capturing ---------------------------------------------------------------------------------------------------------

# The recursion is that of the whole pattern, whose first alternatives are brackets with what they hold: a group of its own
# for them would keep each of its captures, and take a time that grows with the square of their number. Every alternative
# begins with characters of its own and gives nothing back, so a text is read a bounded number of times however broken it is.

_QUOTED = r"""(?: "(?:[^"\\\n]++|\\.)*+" | '(?:[^'\\\n]++|\\.)*+' | `(?:[^`\\]++|\\.)*+` )"""
_NOTE = r"(?: //[^\n]*+ | /\*(?:[^*]++|\*(?!/))*+\*/ )"
#: Comment, signature and balanced body of a declaration in a language with braces, from the comment's first line on. A
#: declaration without a body ends with its semicolon.
_BRACED = regex.compile(
    rf"""
    \( (?: {_QUOTED} | {_NOTE} | (?=[({{]) (?R) | [^()"'`{{}}/]++ | / )*+ \)
  | \{{ (?: {_QUOTED} | {_NOTE} | (?=\{{) (?R) | [^{{}}"'`/]++ | / )*+ \}}
  | \[ (?: {_QUOTED} | {_NOTE} | (?=\[) (?R) | [^\[\]"'`/]++ | / )*+ \]
  | (?![(\[{{])
    (?<comment> (?: [ \t]*+ {_NOTE} [ \t]*+ \r?\n )*+ )
    (?<signature> [ \t]*+ (?> {_QUOTED} | (?=[(\[]) (?R) | {_NOTE} | => | [^{{}};()\[\]"'`/\n=]++ | = (?!>) | / (?![/*]) | \n (?!\s*+\n) )*? )
    (?<body> (?=\{{) (?R) | (?<==>)\s*+ (?: {_QUOTED} | (?=[(\[{{]) (?R) | [^;\n"'`()\[\]{{}}]++ | [^;\n] )++ | ; )
""",
    regex.VERBOSE | regex.VERSION1,
)

_PY_STRING = r"""(?: \"{3}(?:[^"\\]++|\\(?s:.)|"(?!""))*+"{3} | \'{3}(?:[^'\\]++|\\(?s:.)|'(?!''))*+'{3} | "(?:[^"\\\n]++|\\(?s:.))*+" | '(?:[^'\\\n]++|\\(?s:.))*+' )"""
_PY_REST = rf"(?: {_PY_STRING} | (?=[(\[{{]) (?R) | \#[^\n]*+ | [^\n\"'()\[\]{{}}\#]++ )*+"


@lru_cache(maxsize=256)
def _indented(indent: str) -> regex.Pattern:
    """A Python declaration at this indentation with the comment above, and the string that its body may begin with: the
    body goes on over blank, deeper and bracketed lines."""
    deeper = indent.replace(" ", "[ ]").replace("\t", "[\\t]")
    return regex.compile(
        rf"""
    [(\[{{] (?: {_PY_STRING} | \#[^\n]*+ | (?=[(\[{{]) (?R) | [^()\[\]{{}}"'\#]++ )*+ [)\]}}]
  | (?![(\[{{])
    (?<comment> (?: [ \t]*+ \#[^\n]*+ \n )*+ )
    (?<signature> (?: [ \t]*+ @ {_PY_REST} \n )*+ [ \t]*+ (?:async[ ]++)?+ (?:def|class)\b (?: {_PY_STRING} | (?=[(\[{{]) (?R) | [^:\n"'()\[\]{{}}]++ )*+ : )
    (?: (?= (?: [ \t\r]*+ (?: \#[^\n]*+ )?+ \n )*+ [ \t]*+ [rRuU]?+ (?<inside> {_PY_STRING} ) ) )?+
    (?<body> {_PY_REST} (?: \n (?: [ \t\r]*+ (?=\n|\Z) | {deeper}[ \t]++ {_PY_REST} ) )*+ )
""",
        regex.VERBOSE | regex.VERSION1,
    )


class Capture(NamedTuple):
    comment: str  # the comment above, or the string that begins the body
    signature: str
    code: str
    whole: bool  # captured as a balanced whole


def comment_line(line: Callable[[int], str], start_line: int, indented: bool) -> int:
    """The first of the lines of comments and annotations that stand right above ``start_line``."""
    first = start_line
    while first > 1:
        above = line(first - 1).strip()
        if above.endswith("*/") and not indented:
            opening = first - 1
            while opening > 0 and "/*" not in line(opening):
                opening -= 1
            if not opening or not line(opening).lstrip().startswith("/*"):
                break  # a comment behind code
            first = opening
        elif above.startswith(("#", "@") if indented else ("//", "@")):
            first -= 1
        else:
            break
    return first


def capture(text: str, starts: list[int], start_line: int, end_line: int, indented: bool) -> Capture:
    """The declaration at ``start_line`` with its comment, in one match from the comment's first line on. Where nothing
    matches, the symbol's lines stand for the code and there is no comment.

    ``starts``: the offset at which each line of ``text`` begins.
    """
    n = len(starts)
    if not 1 <= start_line <= n:
        return Capture("", "", "", False)
    line = lambda no: text[starts[no - 1] : starts[no] if no < n else len(text)]
    a, b = starts[start_line - 1], starts[end_line] if start_line <= end_line < n else len(text)
    own = line(start_line)
    pattern = _indented(own[: len(own) - len(own.lstrip(" \t"))]) if indented else _BRACED
    m = None
    for first in dict.fromkeys((comment_line(line, start_line, indented), start_line)):
        m = pattern.match(text, starts[first - 1])
        if m is not None and m.end("body") > a:  # and not a declaration that ends before
            break
        m = None
    if m is None:
        return Capture("", own.strip(), text[a:b].rstrip(), False)
    comment = (indented and m["inside"]) or m["comment"]
    return Capture(comment.strip("\r\n"), m["signature"].strip(), text[m.start("signature") : m.end("body")].strip("\r\n"), True)


#: Symbols of one file that a task holds together, on average.
SYMBOLS_AT_ONCE = 2_000

# -- the operator ------------------------------------------------------------------------------------------------------

#: What a constant's signature shows if it assigns a function.
ASSIGNS_FUNCTION = r"=\s*(?:async\b\s*)?(?:function\b|func\s*\(|lambda\b|\((?:[^()\"'`]|\([^()]*\))*\)\s*(?::[^=\"'`]*)?=>|[A-Za-z_$][\w$]*\s*=>)"


def is_function(kind: str = "kind", signature: str = "signature") -> Column:
    k = F.lower(F.trim(F.col(kind)))
    return F.coalesce(k.isin("function", "method") | (k.isin("constant", "variable") & F.coalesce(F.col(signature).rlike(ASSIGNS_FUNCTION), F.lit(False))), F.lit(False))


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id, name, kind, path, signature, description, code, captured``: one pair for each distinct symbol.

    Taken are functions, methods and constants that assign a function, whose documentation tells what they do. Comment,
    signature and body are captured together in the file's text (``captured``), and a capture whose comment is trivial is
    dropped; the symbol's ``doc`` is checked afterwards and has to tell as well. ``doc`` is the description where the text
    has no comment there or nothing can be captured; ``code`` is then the symbol's lines, and null if the file is missing.
    Symbols with a null doc are dropped before the file texts are touched, and each file's text is shuffled once, to the
    list of its symbols' lines; a file with very many symbols is met by several lists. Of a repeated id or file one row
    counts.
    """
    functions = symbols.where(is_function() & F.col("doc").isNotNull())
    wanted = functions.select("id", "file_id", "name", "kind", "path", "signature", "start_line", "end_line", "doc").dropDuplicates(["id"])
    counts = functions.groupBy("file_id").count().where(F.col("count") > SYMBOLS_AT_ONCE)
    counts = checkpointed(counts.select(F.col("file_id").alias("_hot"), F.ceil(F.col("count") / SYMBOLS_AT_ONCE).alias("_parts")))
    wanted = wanted.join(broadcast_if_small(counts), F.col("file_id").eqNullSafe(F.col("_hot")), "left")
    wanted = wanted.withColumn("_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))))
    texts = files.select(F.col("file_id").alias("_file"), "content").dropDuplicates(["_file"])
    schema = "symbol_id STRING, name STRING, kind STRING, path STRING, signature STRING, description STRING, code STRING, captured BOOLEAN"
    per_file = wanted.groupBy("file_id", "_part").agg(
        F.collect_list(F.struct("id", "name", "kind", "path", "signature", "start_line", "end_line", "doc")).alias("symbols")  # about SYMBOLS_AT_ONCE
    )

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, symbols_ in zip(b["content"], b["symbols"]):
                starts = [0, *(m.end() for m in re.finditer("\n", text))] if text is not None else []
                for s in symbols_:
                    found = Capture("", "", "", False)
                    if text is not None:
                        first = int(s["start_line"]) if pd.notna(s["start_line"]) else 0
                        last = int(s["end_line"]) if pd.notna(s["end_line"]) else first
                        found = capture(text, starts, first, last, str(s["path"]).endswith((".py", ".pyi")))
                    comment = found.comment or s["doc"]
                    if tells(comment, s["name"]) and (comment == s["doc"] or tells(s["doc"], s["name"])):
                        out.append((s["id"], s["name"], s["kind"], s["path"], s["signature"] or found.signature or None, prose(comment), found.code or None, found.whole))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return per_file.join(texts, F.col("file_id") == F.col("_file"), "left").select("content", "symbols").mapInPandas(pair, schema)
