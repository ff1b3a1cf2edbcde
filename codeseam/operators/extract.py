"""Symbols, imports and uses out of source text.

Python is read with its own parser; the languages with braces by declaration patterns whose bodies are matched with
strings and comments taken out. Line ranges are thus those of the declarations up to their closing brace.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeseam.functions import paths as P
from codeseam.functions import text as X

Symbol = tuple[str, str, str, int, int, bool]  # name, kind, signature, first and last line, exported

_HIDDEN = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`")
_SCRIPT = re.compile(
    r"^(?P<indent>[ \t]*)(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:"
    r"(?:async\s+)?function\s*\*?\s*(?P<function>[\w$]+)|(?:abstract\s+)?class\s+(?P<class>[\w$]+)|interface\s+(?P<interface>[\w$]+)|type\s+(?P<type>[\w$]+)\s*[=<]|(?:const|let|var)\s+(?P<constant>[\w$]+)"
    r"|(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?(?P<method>[\w$#]+)\s*(?:<[^>\n]*>)?\([^)\n]*\)\s*(?::[^{\n]+)?\{)",
    re.M,
)
_GO = re.compile(r"^(?:func\s+(?:\((?P<receiver>[^)\n]*)\)\s*)?(?P<function>\w+)\s*[\[(]|type\s+(?P<type>\w+)\s+(?P<of>struct|interface)?|(?:const|var)\s+(?P<constant>\w+))", re.M)
_JAVA = re.compile(
    r"^(?P<indent>[ \t]*)(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|sealed)\s+)*)(?:(?:class|enum|record)\s+(?P<class>\w+)|interface\s+(?P<interface>\w+)"
    r"|(?:<[^>\n]+>[ \t]*)?(?!(?:return|new|throw|else|case|yield|assert|package|import)\b)[\w.]++(?:<[^;(){}\n]*>)?(?:\[\])*[ \t]+(?P<method>\w+)[ \t]*\([^)\n]*\)\s*(?:throws[^{\n]+)?[{;])",
    re.M,
)
_C = re.compile(r"^(?P<static>static\s+)?(?:(?:const|unsigned|signed|struct|enum|inline|extern)\s+)*\w[\w ]*[\s*]+(?P<function>\w+)\s*\([^;{}]*\)\s*\{|^(?:typedef\s+)?struct\s+(?P<class>\w+)\s*\{", re.M)
_RUST = re.compile(
    r"^(?P<indent>[ \t]*)(?P<export>pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:default|async|unsafe|const|extern)[ \t]+)*(?:fn[ \t]+(?P<function>\w+)|(?:struct|enum|union)[ \t]+(?P<class>\w+)|(?:unsafe[ \t]+)?trait[ \t]+(?P<interface>\w+)"
    r"|type[ \t]+(?P<type>\w+)|static[ \t]+(?:mut[ \t]+)?(?P<constant>\w+))|^[ \t]*(?P<export2>pub(?:\([^)\n]*\))?[ \t]+)?const[ \t]+(?P<constant2>\w+)[ \t]*:",
    re.M,
)
_PHP = re.compile(
    r"^(?P<indent>[ \t]*)(?P<mods>(?:(?:public|private|protected|static|final|abstract|readonly)[ \t]+)*)(?:function[ \t]+&?(?P<function>\w+)|(?:class|enum)[ \t]+(?P<class>\w+)|(?:interface|trait)[ \t]+(?P<interface>\w+)|const[ \t]+(?:\w+[ \t]+)?(?P<constant>\w+)[ \t]*=)",
    re.M,
)
_PATTERNS = {"rust": _RUST, "php": _PHP, "typescript": _SCRIPT, "javascript": _SCRIPT, "go": _GO, "java": _JAVA, "c": _C, "cpp": _C}
_NOT_NAMES = frozenset("if for while switch catch return function else do try new await typeof constructor".split()) - {"constructor"}

_IMPORT = re.compile(
    r"(?:^|[;\n])\s*(?:import\s+(?:(?P<what>(?:type\s+)?[^'\"`;()=]*?)\s*from\s*)?|export\s+(?P<again>(?:type\s+)?[^'\"`;()=]*?)\s*from\s*)[\"'](?P<spec>[^\"'\n]+)[\"']"
)
_DYNAMIC = re.compile(r"(?:(?:const|let|var)\s+(?P<what>[\w$]+|\{[^}]*\})\s*=\s*(?:await\s+)?)?\b(?:require|import)\(\s*[\"'](?P<spec>[^\"'\n]+)[\"']\s*\)")


#: A single quote also begins a lifetime in Rust, and a hash a comment in PHP.
_HIDDEN_IN = {
    "rust": re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n']+)'"),
    "php": re.compile(r"(?://|\#(?!\[))[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'"),
}


def blanked(text: str, language: str | None = None) -> str:
    """Strings and comments replaced by blanks, offsets and lines kept."""
    return _HIDDEN_IN.get(language or "", _HIDDEN).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


_GOES_ON = re.compile(r"\s*(?:[{)\]=.,|&?:+]|=>)")
_STOP = re.compile(r"[{};\n]")


def _end(text: str, at: int) -> int:
    """The offset of the brace that closes the first one from ``at``, or of the line's end if a statement ends first."""
    depth = 0
    for m in _STOP.finditer(text, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif c == ";" and not depth:
            return m.start()
        elif c == "\n" and not depth and not _GOES_ON.match(text, m.end()):
            return m.start()
    return len(text) - 1


def _python(text: str) -> list[Symbol]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return _by_indentation(text)
    lines, out = text.split("\n"), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((node.name, kind, lines[node.lineno - 1].strip(), node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_")))
    return sorted(out, key=lambda s: s[3])


_DEFINITION = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def _by_indentation(text: str) -> list[Symbol]:
    """The declarations of a Python text that does not parse: up to the last line that is deeper than their first."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        m = _DEFINITION.match(line)
        if m is None:
            continue
        last = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                    break
                last = j
        out.append((m[3], "class" if m[2] == "class" else "function", line.strip(), i + 1, last + 1, not m[3].startswith("_")))
    return out


_RUBY = re.compile(r"([ \t]*)(?:(?:private|public|protected)[ \t]+)?(def|class|module)[ \t]+(?:self\.)?([\w:]+[?!=]?)")


def _ruby(text: str) -> list[Symbol]:
    """The declarations of a Ruby text, each up to the ``end`` at its own indentation, or to its own line if it has none."""
    lines, out, open_ = text.split("\n"), [], []
    hidden = False  # below ``private``
    for i, line in enumerate(lines):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if bare in ("private", "protected"):
            hidden = True
        elif bare == "public":
            hidden = False
        m = _RUBY.match(line)
        if m:
            kind = {"class": "class", "module": "class"}.get(m[2]) or ("method" if m[1] else "function")
            hidden = hidden and kind != "class"
            short = bare.endswith((" end", ";end")) or m[2] == "def" and re.search(r"\)\s*=\s|\w\s+=\s", bare) is not None
            symbol = [m[3], kind, bare, i + 1, i + 1, kind == "class" or not hidden and "private def" not in bare]
            out.append(symbol)
            if not short:
                open_.append((indent, symbol))
        elif open_ and re.match(r"end\b", bare):
            for at in range(len(open_) - 1, -1, -1):
                if open_[at][0] == indent:
                    open_[at][1][4] = i + 1
                    del open_[at:]
                    break
    return [tuple(x) for x in out]


def symbols_of(text: str, language: str | None) -> list[Symbol]:
    """The declarations of a text; none for a language without a reader."""
    if language == "python":
        return _python(text)
    if language == "ruby":
        return _ruby(text)
    pattern = _PATTERNS.get(language or "")
    if pattern is None:
        return []
    plain = blanked(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lines, out = text.split("\n"), []
    for m in pattern.finditer(plain):
        group = next((k for k in ("function", "class", "interface", "type", "constant", "constant2", "method") if k in pattern.groupindex and m[k]), None)
        if group is None or m[group] in _NOT_NAMES and language not in ("rust", "php"):
            continue
        name, groups, kind = m[group], m.groupdict(), group.rstrip("2")
        if language == "go":
            exported = name[:1].isupper()
            kind = "method" if groups.get("receiver") else {"struct": "class", "interface": "interface"}.get(groups.get("of") or "", kind)
        elif language == "java":
            exported = "public" in (groups.get("mods") or "")
        elif language == "rust":
            exported = bool(groups.get("export") or groups.get("export2"))
            kind = "method" if kind == "function" and groups["indent"] else kind
        elif language == "php":
            exported = not re.search(r"private|protected", groups["mods"] or "")
            kind = "method" if kind == "function" and groups["indent"] else kind
        elif language in ("c", "cpp"):
            exported = not groups.get("static")
        else:
            if kind == "method" and not groups["indent"]:
                continue
            if kind == "constant" and groups["indent"]:
                continue
            exported = bool(groups.get("export"))
        first = bisect_right(starts, m.start(group))
        last = bisect_right(starts, _end(plain, m.start(group)))
        out.append((name, kind, lines[first - 1].strip(), first, max(first, last), exported))
    return out


def relations_of(text: str, language: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """``kind, spec, name, use`` of each import and of each use of an imported name: ``imports``, ``calls`` and
    ``references``, a name once each; a name can be both."""
    if language == "python":
        found = re.findall(r"^\s*from\s+(\.+[\w.]*)\s+import\s+([^\n(]+|\([^)]*\))", text, re.M)
        imports = [(("./" if dots == 1 else "../" * (dots - 1)) + spec.lstrip(".").replace(".", "/"), re.findall(r"\w+(?=\s*(?:,|$|\)|#))", names)) for spec, names in found for dots in [len(spec) - len(spec.lstrip("."))]]
    elif language in ("typescript", "javascript"):
        hits = [*_IMPORT.finditer(text), *_DYNAMIC.finditer(text)]
        imports = [(m["spec"], [re.split(r"\s+as\s+|\s*:\s*", p.strip())[-1] for p in re.split(r"[{},]", re.sub(r"^type\s+|\*\s+as\s+", "", m["what"] or "")) if p.strip()]) for m in hits]
    else:
        return []
    out: list[tuple[str, str, str | None, str | None]] = []
    plain = blanked(text)
    for spec, names in imports:
        out.append(("imports", spec, None, None))
        for name in dict.fromkeys(n for n in names if re.fullmatch(r"[\w$]+", n)):
            if re.search(rf"(?<![\w$.]){re.escape(name)}\s*\(", plain):
                out.append(("calls", spec, name, name))
            if re.search(rf"(?<![\w$.]){re.escape(name)}\s*\.\s*[\w$]+", plain):
                out.append(("references", spec, name, name))
    return list(dict.fromkeys(out))


def extract_symbols(files: DataFrame) -> DataFrame:
    """``file_id, index_id, path, name, kind, signature, start_line, end_line, exported`` and a stable ``id``."""
    rows = files.where(F.col("content").isNotNull()).select("file_id", "index_id", "path", F.coalesce("language", P.language("path")).alias("language"), "content")
    ddl = "file_id string, index_id string, path string, name string, kind string, signature string, start_line int, end_line int, exported boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, i, p, *s) for f, i, p, lang, t in zip(*(b[c] for c in ("file_id", "index_id", "path", "language", "content"))) for s in symbols_of(t, lang)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    return rows.mapInPandas(run, ddl).select(X.hash_id("sym_", "index_id", "path", "start_line", "end_line", "kind", "name", length=20).alias("id"), "*")


def extract_relations(files: DataFrame) -> DataFrame:
    """``index_id, path, kind, spec, name`` before imports are resolved."""
    rows = files.where(F.col("content").isNotNull()).select("index_id", "path", F.coalesce("language", P.language("path")).alias("language"), "content")
    ddl = "index_id string, path string, kind string, spec string, name string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, p, *r[:3]) for i, p, lang, t in zip(*(b[c] for c in ("index_id", "path", "language", "content"))) for r in relations_of(t, lang)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    return rows.mapInPandas(run, ddl)


CONFIDENCE = {"imports": 0.9, "calls": 0.7, "references": 0.6}


def file_edges(files: DataFrame, symbols: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """All edges of a set of files: resolved imports and uses, tests, and each file's own symbols. ``known``: the
    ``index_id, path`` that they may lead to, if more than these files."""
    from codeseam.operators import graph

    own, known = files.select("index_id", "path"), files.select("index_id", "path") if known is None else known
    uses = graph.resolve_imports(extract_relations(files).select("index_id", "path", "spec", "kind"), known)
    weight = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    edges = uses.select("index_id", F.col("path").alias("from_path"), "to_path", F.col("kind").alias("type"), weight[F.col("kind")].alias("confidence")).distinct()
    edges = edges.unionByName(graph.test_edges(own, known))
    return edges.unionByName(graph.symbol_edges(symbols)) if symbols is not None else edges
