"""Generated, minified and vendored files and data blobs among source files.

Method: belief propagation over the directory trees. Each file has evidence of its own (its name, its banner, the look
of its text), as log-likelihoods of the labels ``handwritten, generated, minified, vendored, blob``. A directory has
the same labels for what it mainly holds; a compatibility ties each directory to its files and subdirectories. On a
tree two passes are exact: messages go up from the files level by level, then down again, and a file's belief is its
own evidence times what its siblings, their directory and its parents say.

Every step of a pass is an aggregation by directory with partial sums on the map side, so a directory with a third of
all files is summed where its files are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeseam.session import broadcast_if_small, checkpointed

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
#: Log-odds that a file without any evidence is handwritten.
PRIOR = 3.0
#: A directory's file, and a directory's subdirectory, has its label with this weight against each other label.
SAME_FILE, SAME_DIRECTORY = 4.0, 6.0
#: Characters from which the look of a script, and that of data, speaks with its full weight; of shorter texts in proportion.
ENOUGH_SCRIPT, ENOUGH_DATA = 400, 1200

# -- evidence of a file ------------------------------------------------------------------------------------------------

# Names that tools and conventions give.
_VENDOR_DIRS = set("vendor vendored third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages external externals deps godeps pods site-packages".split())
_GENERATED_DIRS = set("generated __generated__ gen autogen auto_generated auto-generated generated_src generated-src .generated".split())
_BUILT_DIRS = set("dist build out target bundle bundles .next .nuxt".split())
_GENERATED_NAME = re.compile(
    r"(?i)\.pb(?:\.\w+)?\.(?:go|cc|h|c|js|ts|py|java)$|_pb2(?:_grpc)?\.pyi?$|(?:Grpc|OuterClass)\.java$|[._-](?:g|gen|generated|autogen|designer)\.\w+$|^zz_generated|\.(?:js|css|ts)\.map$|"
    r"^(?:package-lock|npm-shrinkwrap|composer\.lock|yarn\.lock|pnpm-lock|poetry\.lock|cargo\.lock|pipfile\.lock)"
)
_MINIFIED_NAME = re.compile(r"(?i)[.-](?:min|bundle|chunk|prod)\.(?:m?js|cjs|css)$|[-.][0-9a-f]{8,20}(?:[-_.]\w+)?\.(?:m?js|css)$")
_SCRIPT = re.compile(r"(?i)\.(?:m?js|cjs|css|jsx?|tsx?)$")
_DATA_NAME = re.compile(r"(?i)\.(?:json|js|mjs|cjs|ts|tsx|jsx|py|c|h|cc|cpp|go|java|rs|rb|php|kt|cs)$")

#: Comments that end with a mark, and the marks of those that end with their line (or go on in a block's line).
_BLOCKS = {"/*": "*/", '"""': '"""', "'''": "'''", "<!--": "-->"}
_MARK = re.compile(r"#!.*|(?://+[!/]?|/\*+!?|\*+/?|\#+|--+|;+|%+|<!--|\"\"\"|''')\s*")
_SPACE = re.compile(r"[\s\ufeff]*+")
#: Where ``#`` begins no comment: selectors, and directives, of which only one that gives a value is code.
_STYLES = re.compile(r"(?i)\.(?:css|scss|less)$")
_C_NAME = re.compile(r"(?i)\.(?:c|h|cc|cpp|cxx|hh|hpp|hxx|inl|m|mm|cs)$")
_DIRECTIVE = re.compile(r"#[ \t]*(?:if|ifn?def|el(?:if|se)|endif|define|undef|pragma|include|import|error|warning|line|nullable|(?:end)?region)\b")
_CONSTANT = re.compile(r"#[ \t]*define[ \t]+\w+(?:\(|[ \t]+[^\s/])")
#: Subjects whose work is to handle generated files, not to be one.
_ABOUT = re.compile(r"(?i)^(?:finds|decides|detects|checks|writes|reads|parses|skips|tests|lists|returns|collects|handles|removes|creates|builds|emits|generates|prints|the generator|helper|script (?:that|to)|tool (?:that|to))\b")
_GENERATED = re.compile(
    r"""(?ix)
      @generated\b | <auto-?generated | ^(?:\W*(?:note|warning|attention)\W+)?(?:this\s+(?:file|code|module|class|source)\s+(?:is|was|has\s+been)\s+)?(?:\w+\s+){0,2}?(?:auto-?matically|auto-?|machine-?)\s*-?(?:generated|created|produced|written)\b
    | ^(?:code|file|source|sources?\s+code|stubs?|bindings?|client|parser|lexer|this\s+(?:file|code|module|class|source))?\s*+(?:is|was|has\s+been)?\s*+(?:generated|emitted|produced)\s+(?:by|from|with|using|on|at)\b
    | ^(?:written|built|created|compiled|made)\s+by\s+(?:a\s+|the\s+)?(?:script|tool|generator|compiler|build|program|running|make)\b | ^\w+\s+(?:built|made|created|written)\s+by\s+running\b
    | ^machine[- ](?:made|written|generated)\b | \byour\s+(?:edits|changes)\s+(?:vanish|are\s+lost|will\s+be\s+(?:lost|overwritten))\b | ^output\s+of\b | \btreat\s+(?:this\s+|it\s+)?as\s+(?:a\s+)?(?:build|generated|compiler)\s+output\b | \b(?:hand|manual)[- ]edits?\s+(?:get|are|will\s+be|is)\s+(?:overwritten|lost|discarded)\b
    | \bregenerate,?\s+(?:never|don't|do\s+not|instead\s+of)\b | \bre-?run\s+the\s+\w+\s+after\b | ^(?:please\s+)?do\s+not\s+(?:edit|modify|change)\b | \bdo\s+not\s+(?:edit|modify)(?:\s+(?:by\s+hand|manually|this\s+file|directly))?\W*$ | -\s*edit\s+\S+\.\w+\s+instead
    | (?:wurde|wird)\s+(?:automatisch|maschinell)\b.*\b(?:erzeugt|generiert|erstellt) | (?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt) | nicht\s+(?:bearbeiten|ändern|editieren)\W*$ | (?:généré|créé|produit)e?s?\s+(?:automatiquement|par) | ne\s+pas\s+(?:modifier|éditer)
    | (?:generado|creado|producido)\s+(?:automáticamente|por) | no\s+(?:editar|modificar)\W*$ | gerado\s+automaticamente | não\s+edit | generato\s+automaticamente | non\s+modificare
    | (?:автоматически|сгенерирован\w*|создан\w*\s+автоматически) | не\s+(?:редактировать|изменять|править) | 自动生成 | 自動生成 | 由.{0,20}生成 | 请勿(?:手动)?(?:修改|编辑) | 編集しない | 변경하지\s*마
    """
)
_UPSTREAM = re.compile(r"(?ix) \bupstream:\s*\S+ | \bcopied\s+(?:into|from|verbatim|without\s+changes)\b | \bvendored\b | \bbring\s+fixes\s+to\s+the\s+upstream | \bimported\s+from\s+https?://")
_OWNER = re.compile(r"(?i)copyright\b.{0,40}?\b(?:the\s+)?([a-z][\w.]*(?:-[\w.]+)*)\s+(?:contributors|authors|team|project|developers)\b|this\s+file\s+belongs\s+to\s+([a-z][\w.]*(?:-[\w.]+)*)\b|copyright\b.{0,20}\bby\s+([a-z][\w.-]+)")
_BANNER = re.compile(r"^/\*!")
_BUNDLER = re.compile(r"__webpack_require__|\(function\s*\(modules\)|parcelRequire|System\.register\(|define\.amd|//# sourceMappingURL=")
_NUMBERS = re.compile(r"[-+0-9a-fA-FxX.,\s\[\]{}()\"':]+")
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_ENCODED = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}|\\u[0-9a-fA-F]{4}){10,}")
_PEM = re.compile(r"^\W*-----BEGIN [A-Z0-9 ]+-----")
_LOCKFILE = re.compile(r'"lockfileVersion"\s*:')
_RECORDS = re.compile(r'\{\s*"[^"]{1,40}"\s*:\s*[^{}\[\]]{1,200}\}\s*,\s*\{\s*"')


def _header(text: str, name: str = "") -> list[str]:
    """The lines of all comments before the first code, without their marks."""
    out, at = [], 0
    while (at := _SPACE.match(text, at).end()) < len(text):
        mark = next((m for m in _BLOCKS if text.startswith(m, at)), None)
        if mark:
            end = text.find(_BLOCKS[mark], at + len(mark))
            end = end if end >= 0 else len(text)
            out += text[at:end].split("\n")
            at = end + len(_BLOCKS[mark])
            continue
        directive = _C_NAME.search(name) and _DIRECTIVE.match(text, at)
        if not _MARK.match(text, at) or text[at] == "#" and _STYLES.search(name) or directive and _CONSTANT.match(text, at):
            break
        end = text.find("\n", at)
        end = end if end >= 0 else len(text)
        if not directive:  # they stand before the banner, but say nothing
            out.append(text[at:end])
        at = end
    lines = [line.strip() for line in out]
    return [line[m.end() if (m := _MARK.match(line)) else 0 :].removesuffix("*/").removesuffix("-->").strip() for line in lines]


def _covered(pattern: re.Pattern, text: str) -> int:
    """The number of characters that the matches cover, without a list of them."""
    return sum(m.end() - m.start() for m in pattern.finditer(text))


def evidence(path: str | None, content: str | None, repository: str | None = None) -> list[float]:
    """The log-likelihood of each label, up to a constant; without evidence only the prior speaks."""
    hand, generated, minified, vendored, blob = PRIOR, 0.0, 0.0, 0.0, 0.0
    path, text = path or "", content or ""
    *folders, name = path.split("/")
    folders = {f.lower() for f in folders}
    if _PEM.match(text) or name.endswith((".pem", ".key", ".crt", ".pub")):
        return [hand + 20.0, 0.0, 0.0, 0.0, 0.0]
    if folders & _VENDOR_DIRS:
        vendored += 7.0
    if folders & _GENERATED_DIRS:
        generated += 5.0
    if folders & _BUILT_DIRS:
        minified += 1.5
        generated += 0.5
    if _GENERATED_NAME.search(name):
        generated += 7.0
    if _MINIFIED_NAME.search(name):
        minified += 6.0
    header = _header(text, name)
    if any(_GENERATED.search(line) and not _ABOUT.match(line) for line in header):
        generated += 7.0
    if any(_UPSTREAM.search(line) for line in header):
        vendored += 6.0
    owners = {next(filter(None, m.groups())).lower() for line in header for m in [_OWNER.search(line)] if m}
    if owners and repository:
        if repository.lower() in owners:
            vendored -= 1.5
        else:
            vendored += 1.0  # licence headers also name people, firms and toolkits, so this says little
    if text:
        newlines = text.count("\n") + 1
        per_line = len(text) / newlines
        blank = (text.count(" ") + text.count("\t") + newlines) / len(text)
        # what the look of a text says grows with its length until the text is long enough to tell
        if _SCRIPT.search(name):
            if per_line > 250 and blank < 0.12:
                minified += 6.0 * min(1.0, len(text) / ENOUGH_SCRIPT)
            if _BANNER.match(text):
                minified += 2.0 * min(1.0, len(text) / ENOUGH_SCRIPT)
            if _BUNDLER.search(text):
                minified += 4.5 * min(1.0, len(text) / ENOUGH_SCRIPT)
        if _DATA_NAME.search(name):
            enough = min(1.0, len(text) / ENOUGH_DATA)
            share, numbers, encoded = (_covered(p, text) / len(text) for p in (_NUMBERS, _NUMBER, _ENCODED))
            if share > 0.85 and numbers > 0.3 or encoded > 0.75:
                blob += 7.0 * enough
            if name.lower().endswith(".json"):
                if _LOCKFILE.search(text) or text.count('"integrity"') > 3:
                    generated += 6.0 * enough
                elif per_line > 800 or sum(1 for _ in _RECORDS.finditer(text)) > 20:
                    blob += 6.0 * enough
    return [hand, generated, minified, vendored, blob]


# -- belief propagation ------------------------------------------------------------------------------------------------

_B = [f"b{i}" for i in range(len(LABELS))]


def _message(same: float):
    """What a node of these log-beliefs tells a neighbour: for each of the neighbour's labels, the log of the sum over
    the node's own, weighted by compatibility. A column function, vectorised, as the same sums written as column
    expressions multiply each time they are used."""

    @F.pandas_udf(", ".join(f"{x} double" for x in _B))
    def message(b0: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, b4: pd.Series) -> pd.DataFrame:
        beliefs = np.column_stack([b0, b1, b2, b3, b4])
        weights = np.exp(beliefs - beliefs.max(axis=1, keepdims=True)) if len(beliefs) else beliefs
        return pd.DataFrame(np.log(weights.sum(axis=1, keepdims=True) + weights * (same - 1.0)), columns=_B)

    return message


def _told(df: DataFrame, beliefs: list[Column], same: float, out: list[str]) -> DataFrame:
    """``df`` with the message as columns ``out``."""
    df = df.withColumn("_message", _message(same)(*beliefs))
    return df.withColumns({o: F.col("_message")[x] for o, x in zip(out, _B)}).drop("_message")


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}{x}" for x in _B]


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(_B, _columns(prefix))))


def propagate(files: DataFrame) -> DataFrame:
    """``files``: ``tree, dir, file, b0..b4`` (log evidence). Gives ``file, b0..b4`` with the log beliefs.

    Directories are numbered by depth; the passes go over the depths there are, so a deeper tree means more steps and
    not a cut. ``dir`` is ``""`` for files at the root.
    """
    key, own = ["tree", "dir"], [F.col(x) for x in _B]
    sums = [F.sum(m).alias(x) for m, x in zip(_columns("m"), _B)]
    told = _told(files, own, SAME_FILE, _columns("m")).groupBy(*key).agg(*sums)
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    )
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    parent = F.when(depth <= 1, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "/"))
    everything = told.select("tree", F.explode(above).alias("dir")).distinct()
    dirs = checkpointed(
        everything.join(told, key, "left").select(*key, depth.alias("depth"), parent.alias("parent"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in _B])
    )
    deepest = dirs.agg(F.max("depth")).head()[0] or 0

    up = {deepest: dirs.where(F.col("depth") == deepest)}
    for level in range(deepest - 1, -1, -1):
        sent = _told(up[level + 1], own, SAME_DIRECTORY, _columns("m")).groupBy("tree", F.col("parent").alias("dir")).agg(*sums)
        both = dirs.where(F.col("depth") == level).join(_renamed(sent, "_"), key, "left")
        up[level] = checkpointed(both.select(*key, "depth", "parent", *[(F.col(x) + F.coalesce(f"_{x}", F.lit(0.0))).alias(x) for x in _B]))
    down = [up[0]]
    for level in range(1, deepest + 1):
        over = _renamed(down[-1], "_").select("tree", F.col("dir").alias("parent"), *_columns("_"))
        both = up[level].join(over, ["tree", "parent"])
        down.append(checkpointed(_answered(both, SAME_DIRECTORY).select(*key, "depth", "parent", *_B)))
    final = down[0]
    for one in down[1:]:
        final = final.unionByName(one)
    both = files.join(_renamed(final, "_").select(*key, *_columns("_")), key)
    return _answered(both, SAME_FILE).select("file", *_B)


def _answered(both: DataFrame, same: float) -> DataFrame:
    """Beliefs ``b`` with what the directory ``_b`` says without what it had been told by this very node."""
    own = [F.col(x) for x in _B]
    both = _told(both, own, same, _columns("m"))
    both = _told(both, [F.col(d) - F.col(m) for d, m in zip(_columns("_"), _columns("m"))], same, _columns("a"))
    return both.withColumns({x: F.col(x) + F.col(a) for x, a in zip(_B, _columns("a"))})


def classify(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """``file_id, label, probability``, one row for each distinct file_id of ``files``.

    A row with null or empty content has only its path's evidence; one without path stands at the root of its tree; a
    file whose index is unknown has no repository name to compare owners with. Trees are those of ``index_id`` (rows
    without one form a tree of their own).
    """
    names = broadcast_if_small(indexes.select(F.col("id").alias("_id"), F.element_at(F.split("repo_root", "/"), -1).alias("repository")).dropDuplicates(["_id"]))
    rows = (
        files.select("file_id", F.coalesce("index_id", F.lit("")).alias("tree"), "path", "content")
        .join(names, F.col("tree") == F.col("_id"), "left")
        .drop("_id")
    )
    schema = T.StructType([rows.schema["file_id"], rows.schema["tree"], T.StructField("dir", T.StringType()), *[T.StructField(x, T.DoubleType()) for x in _B]])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (f, t, (p or "").rpartition("/")[0].strip("/"), *evidence(p, c, r if isinstance(r, str) else None))
                for f, t, p, c, r in zip(batch["file_id"], batch["tree"], batch["path"], batch["content"], batch["repository"])
            ]
            yield pd.DataFrame(out, columns=schema.names)

    # read by both passes; a repeated file_id is dropped when it has been looked at, as texts are much more to shuffle
    seen = checkpointed(rows.mapInPandas(look, schema).dropDuplicates(["file_id"]).withColumnRenamed("file_id", "file"))
    beliefs = propagate(seen)
    beliefs = beliefs.withColumn("top", F.greatest(*_B))
    top = F.col("top")
    total = sum((F.exp(F.col(x) - top) for x in _B[1:]), F.exp(F.col(_B[0]) - top))
    label = F.coalesce(*[F.when(F.col(x) == top, name) for x, name in zip(_B, LABELS)])
    return beliefs.select(F.col("file").alias("file_id"), label.alias("label"), (1.0 / total).alias("probability"))
