"""Column builders over POSIX paths: parts, filters, languages, import candidates and test targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeseam.functions.text import _col, split_identifiers

# File extensions and their languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "sh": "bash", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql",
}
# Languages with a grammar, whose files are code; all others are prose.
CODE_LANGUAGES = ["typescript", "javascript", "python", "go", "rust", "java", "ruby", "php", "c", "cpp"]
# Folders and file names that are never indexed.
DENIED_FOLDERS = (
    "node_modules build dist out coverage .cache .next .nuxt .turbo .svelte-kit .gradle target __pycache__ .venv venv .mypy_cache .pytest_cache".split()
)
DENIED_NAMES = [r"\.min\.js$", r"\.min\.css$", r"\.map$", r"(^|/)vendor/", r"\.bundle\.[a-z]+$"]
# What makes a file a test.
TEST_ENDS = [r"\.test\.[a-z]+$", r"\.spec\.[a-z]+$", r"_test\.[a-z]+$", r"\.test$", r"\.spec$"]
TEST_BEGIN = "^test_"
TEST_FOLDERS = ["__tests__", "tests", "test", "__test__"]
IMPACT_TEST = r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[cm]?[jt]sx?$"
GENERATED = r"(?i)(^|/)(generated|vendor)(/|$)|\.(generated|gen)\.[^.]+$"
#: Any of them, whatever the case.
TEST_NAME = "(?i)" + "|".join([*TEST_ENDS, TEST_BEGIN])
# Where an import without or with another extension may point.
FALLBACK_EXTENSIONS = ".ts .tsx .mts .cts .js .jsx .mjs .cjs .d.ts .py .go .rs .java .rb .php .c .cpp".split()
INDEX_FILES = "index.ts index.tsx index.js index.jsx index.mjs index.py __init__.py".split()
SOURCE_OF_OUTPUT = {".js": [".ts", ".tsx", ".d.ts", ".mts", ".cts"], ".jsx": [".tsx", ".d.ts"], ".mjs": [".mts", ".ts"], ".cjs": [".cts", ".ts"]}
# Folders and stems that say nothing about a module.
CONTAINERS = "src app apps components features hooks lib libs packages routes utils".split()
GENERIC_STEMS = "index main default mod module".split()
# Words too common to look for.
QUERY_STOPWORDS = "index main default value data type item result".split()

MAX_FILE_BYTES = 5 * 1024 * 1024


def to_posix(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\\", "/")


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def dirname(path: Column | str) -> Column:
    """What is before the last slash; a dot where there is none."""
    return F.when(F.contains(_col(path), F.lit("/")), F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)).otherwise(".")


def extname(path: Column | str) -> Column:
    """The last dot of the name and what follows, unless the name begins with that dot."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def normalize(path: Column | str) -> Column:
    """Without dots and doubled slashes, parents resolved where there is something to leave."""
    absolute = F.startswith(_col(path), F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        leave = (part == "..") & (F.size(done) > 0) & (last != "..")
        up = (part == "..") & absolute & (F.size(done) == 0)
        return F.when((part == "") | (part == ".") | up, done).when(leave, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    joined = F.array_join(F.reduce(F.split(_col(path), "/"), empty, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def join(folder: Column, name: Column) -> Column:
    return normalize(F.concat_ws("/", folder, name))


def inside(path: Column | str) -> Column:
    """True if a relative path does not leave its root."""
    n = normalize(path)
    return ~F.startswith(n, F.lit("/")) & (n != "..") & ~F.startswith(n, F.lit("../"))


def language(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.regexp_replace(F.lower(extname(path)), r"^\.", ""))


def content_type(lang: Column | str) -> Column:
    return F.when(F.coalesce(_col(lang).isin(CODE_LANGUAGES), F.lit(False)), "code").otherwise("prose")


def denied(path: Column | str) -> Column:
    folders = "|".join(f.replace(".", r"\.") for f in DENIED_FOLDERS)
    return _col(path).rlike(rf"(?:^|/)(?:{folders})/|" + "|".join(DENIED_NAMES))


def has_prefix(path: Column | str, prefix: str) -> Column:
    """The path itself or anything below it; the prefix is taken literally."""
    clean = prefix.removeprefix("./").removeprefix("/").removesuffix("/")
    return (_col(path) == clean) | F.startswith(_col(path), F.lit(clean + "/")) if clean else F.lit(True)


def is_test(path: Column | str) -> Column:
    return basename(path).rlike(TEST_NAME) | F.arrays_overlap(F.split(dirname(path), "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def is_impact_test(path: Column | str) -> Column:
    return _col(path).rlike(IMPACT_TEST)


def is_generated(path: Column | str) -> Column:
    return _col(path).rlike(GENERATED)


def is_relative(spec: Column | str) -> Column:
    return F.startswith(_col(spec), F.lit("."))


def import_candidates(from_path: Column | str, spec: Column | str) -> Column:
    """The paths that an import may mean, the likeliest first; null for a spec that is not relative."""
    target = join(dirname(from_path), _col(spec))
    none = F.array().cast("array<string>")
    sources = [
        F.when(F.endswith(target, F.lit(out)), F.array(*[F.concat(F.substr(target, F.lit(1), F.length(target) - len(out)), F.lit(s)) for s in ends])).otherwise(none)
        for out, ends in SOURCE_OF_OUTPUT.items()
    ]
    bare = F.when(extname(target) == "", F.array(*[F.concat(target, F.lit(e)) for e in FALLBACK_EXTENSIONS])).otherwise(none)
    inside_folder = F.array(*[join(target, F.lit(i)) for i in INDEX_FILES])
    return F.when(is_relative(spec), F.array_distinct(F.concat(F.array(target), *sources, bare, inside_folder)))


def test_targets(path: Column | str) -> Column:
    """The source files that a test file may test, by its name and place."""
    base, folder = basename(path), dirname(path)
    ext = F.regexp_extract(base, r"(?i)\.([a-z0-9]+)$", 1)
    dotted = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")
    none = F.array().cast("array<string>")
    out = [
        F.when(base.rlike(suffix), F.array(join(folder, F.concat(F.regexp_replace(base, suffix, ""), dotted)), join(folder, F.regexp_replace(base, suffix, "")))).otherwise(none)
        for suffix in ("(?i)" + end for end in TEST_ENDS)
    ]
    out.append(F.when(base.rlike("(?i)" + TEST_BEGIN), F.array(join(folder, F.regexp_replace(base, "(?i)" + TEST_BEGIN, "")))).otherwise(none))
    parts = F.split(folder, "/")
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    # only the first mark of a test is taken out of the name
    stem = F.regexp_replace(F.regexp_replace(base, r"^(.*?)(?:\.test\.|\.spec\.|_test\.)", "$1."), r"\.[a-z]+$", "")
    above = F.array(join(parent, F.concat(stem, dotted)), join(F.concat_ws("/", parent, F.lit("src")), F.concat(stem, dotted)))
    out.append(F.when(F.arrays_overlap(parts, F.array(*map(F.lit, TEST_FOLDERS[:3]))), above).otherwise(none))
    return F.array_distinct(F.concat(*out))


def file_stem(path: Column | str) -> Column:
    base, ext = basename(path), extname(path)
    return F.regexp_replace(F.substr(base, F.lit(1), F.length(base) - F.length(ext)), r"[._-]+", " ")


def symbol_query(name: Column | str, path: Column | str, stopwords: list[str] | None = None) -> Column:
    """Words by which one could look for a symbol without knowing its name; empty if there are too few."""
    stop = F.array(*map(F.lit, stopwords or QUERY_STOPWORDS))
    keep = lambda p: ~F.array_contains(stop, F.lower(p))
    parts = F.filter(split_identifiers(name, 3, 5), keep)
    stem = F.filter(F.split(file_stem(path), "(?i)[^a-z0-9]+"), lambda p: F.length(p) >= 3)
    both = F.filter(F.array_distinct(F.concat(parts, stem)), keep)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 4), " ")).when(F.size(both) >= 2, F.array_join(F.slice(both, 1, 4), " ")).otherwise("")


def module_subject(path: Column | str) -> Column:
    """Words for a module: its stem, and the nearest folder that says something."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: p != "")
    leaf = file_stem(F.element_at(parts, -1))
    folders = F.reverse(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: file_stem(p)))
    telling = F.filter(folders, lambda p: ~F.array_contains(F.array(*map(F.lit, CONTAINERS)), F.lower(p)))
    context = F.coalesce(F.get(telling, F.lit(0)), F.get(folders, F.lit(0)))
    generic = F.array_contains(F.array(*map(F.lit, GENERIC_STEMS)), F.lower(leaf))
    raw = F.when(generic, F.coalesce(context, leaf)).otherwise(F.concat_ws(" ", context, leaf))
    words = F.flatten(
        F.transform(
            F.filter(F.split(raw, "[^A-Za-z0-9_]+"), lambda p: p != ""),
            lambda p: F.when(F.size(split_identifiers(p, 2, 8)) > 0, split_identifiers(p, 2, 8)).otherwise(F.array(F.lower(p))),
        )
    )
    return F.array_join(F.slice(F.array_distinct(words), 1, 8), " ")
