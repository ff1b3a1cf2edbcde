"""Queries of the text, path and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import paths as P
from codeseam.functions import scoring as S
from codeseam.functions import text as X
from codeseam.operators import maintenance as M
from codeseam.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_BASE}, '^.+?(\\.[^.]*)$', 1))"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"
_LANG = "CASE " + _EXT + " " + " ".join(f"WHEN '.{e}' THEN '{n}'" for e, n in P.LANGUAGES.items()) + " END"
_DENIED = "regexp_matches(path, '(?:^|/)(?:" + "|".join(f.replace(".", "\\.") for f in P.DENIED_FOLDERS) + ")/|" + "|".join(P.DENIED_NAMES) + "')"
_TEST = f"(regexp_matches({_BASE}, '{P.TEST_NAME}') OR list_has_any(string_split({_DIR}, '/'), ['__tests__', 'tests', 'test', '__test__']))"
SPLIT = (  # the parts of the compound identifiers of %s
    "list_transform(list_filter(flatten(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: "
    "list_filter(string_split_regex(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: p <> '')), "
    "lambda l: len(l) > 1)), lambda p: length(p) >= {1} AND NOT regexp_full_match(p, '[0-9]+')), lambda p: lower(p))"
)


def first_seen(expr: str, most: int) -> str:
    return f"list_filter({expr}, lambda p, i: list_position({expr}, p) = i)[1:{most}]"


@query(f"SELECT DISTINCT index_id, path, {_LANG} AS inferred FROM scanned_files WHERE size <= {P.MAX_FILE_BYTES} AND NOT {_DENIED}")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "scanned_files").where((F.col("size") <= P.MAX_FILE_BYTES) & ~P.denied("path"))
    return t.select("index_id", "path", P.language("path").alias("inferred")).distinct()


@query(f"SELECT {_LANG} AS inferred, language, count(*) AS n FROM corpus_files GROUP BY 1, 2")
def language_infer(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_files").groupBy(P.language("path").alias("inferred"), "language").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT path FROM corpus_files WHERE {_DENIED}")
def deny_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_files").where(P.denied("path")).select("path").distinct()


@query(f"SELECT DISTINCT path, {_TEST} AS by_name, regexp_matches(path, '{P.IMPACT_TEST}') AS by_impact FROM corpus_files")
def test_file_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_files").select("path", P.is_test("path").alias("by_name"), P.is_impact_test("path").alias("by_impact")).distinct()


@query(f"SELECT DISTINCT path FROM corpus_files WHERE regexp_matches(path, '{P.GENERATED}')")
def generated_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_files").where(P.is_generated("path")).select("path").distinct()


@query("SELECT index_id, path, count(*) AS n FROM symbols WHERE path = 'src' OR starts_with(path, 'src/') GROUP BY ALL")
def path_prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symbols").where(P.has_prefix("path", "./src/")).groupBy("index_id", "path").agg(F.count("*").alias("n"))


@query("SELECT index_id, content_type, count(DISTINCT id) AS n FROM chunks GROUP BY ALL")
def content_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("index_id", "content_type").agg(F.countDistinct("id").alias("n"))


@query(
    "SELECT branch_name, count(DISTINCT c.id) AS n FROM chunks c JOIN (SELECT DISTINCT id, branch_name FROM index_rows) i ON c.index_id = i.id GROUP BY 1"
)
def branch_filter(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_rows").select(F.col("id").alias("index_id"), "branch_name").distinct()
    return table(spark, sf, "chunks").select("id", "index_id").join(i, "index_id").groupBy("branch_name").agg(F.countDistinct("id").alias("n"))


@query("SELECT DISTINCT index_id, path FROM chunks WHERE chunker_version IS NULL OR chunker_version < 2")
def stale_chunker_paths(spark: SparkSession, sf: str) -> DataFrame:
    return M.stale_paths(table(spark, sf, "chunks"))


@query(
    "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda t: t <> ''), ' ') AS tokens, "
    "array_to_string(list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_]+'), lambda t: length(t) >= 2 AND t NOT IN ('the','a','an','and','or','of','to','in','for','is','on')), ' ') AS terms "
    "FROM documents WHERE text IS NOT NULL"
)
def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.array_join(X.query_tokens("text"), " ").alias("tokens"), F.array_join(X.preview_terms("text"), " ").alias("terms"))


@query(f"SELECT DISTINCT id, array_to_string({first_seen(SPLIT.format('content', 3), 128)}, ' ') AS parts FROM chunks")
def split_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", F.array_join(X.split_identifiers("content"), " ").alias("parts")).distinct()


@query(
    f"SELECT id, sha256(CASE WHEN len(p) > 0 THEN content || chr(10) || array_to_string(p, ' ') ELSE content END) AS digest "
    f"FROM (SELECT DISTINCT id, content, {first_seen(SPLIT.format('content', 3), 128)} AS p FROM chunks)"
)
def subtoken_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("id", F.sha2(X.with_subtokens("content"), 256).alias("digest")).distinct()


@query(
    "SELECT index_id, count(*) AS n_chunks, sum(n)::BIGINT AS n_tokens FROM (SELECT DISTINCT id, index_id, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}\\p{Co}]+')) AS n FROM chunks) GROUP BY 1"
)
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").dropDuplicates(["id"]).select("index_id", F.size(X.search_tokens("content")).alias("n"))
    return c.groupBy("index_id").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_tokens"))


@query(
    "SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS base, " + _DIR + f" AS folder, regexp_extract({_BASE}, '^.+?(\\.[^.]*)$', 1) AS ext, "
    "regexp_extract(path, '^(?:[^/]*/)?(.*)$', 1) AS up FROM corpus_files WHERE contains(path, '/')"
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "corpus_files").select("path").where(F.contains("path", F.lit("/"))).distinct()
    first = F.get(F.split("path", "/"), F.lit(0))
    return p.select("path", P.basename("path").alias("base"), P.dirname("path").alias("folder"), P.extname("path").alias("ext"), P.normalize(F.concat(F.lit("./x/.././"), first, F.lit("/..//"), F.regexp_replace("path", "^[^/]*/", ""))).alias("up"))


_CANDIDATES = (
    "WITH p AS (SELECT DISTINCT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, " + _DIR + " AS folder FROM corpus_files WHERE regexp_matches(path, '^[^./][^/]*/.+\\.(ts|js|tsx|jsx|mjs|cjs)$')), "
    "t AS (SELECT path, folder || '/' || stem AS bare FROM p), "
    "c AS (SELECT path, 1 AS kind, unnest(list_concat([bare || '.js', bare || '.ts', bare || '.tsx', bare || '.d.ts', bare || '.mts', bare || '.cts'], "
    "list_transform(['index.ts','index.tsx','index.js','index.jsx','index.mjs','index.py','__init__.py'], lambda i: bare || '.js/' || i))) AS candidate FROM t) "
    "SELECT path, candidate FROM c"
)


@query(_CANDIDATES)
def import_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "corpus_files").select("path").where(F.col("path").rlike(r"^[^./][^/]*/.+\.(ts|js|tsx|jsx|mjs|cjs)$")).distinct()
    spec = F.concat(F.lit("./"), F.regexp_replace(P.basename("path"), r"\.[^.]*$", ""), F.lit(".js"))
    return p.select("path", F.explode(P.import_candidates("path", spec)).alias("candidate"))


@query(
    "SELECT DISTINCT path, regexp_replace(path, '\\.(test|spec)\\.', '.', 'i') AS target FROM (SELECT DISTINCT 'src/' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.([a-z]+)$', '.test.\\1') AS path "
    "FROM corpus_files WHERE regexp_matches(path, '/[^/.]+\\.(ts|js|go|java)$'))"
)
def test_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "corpus_files").where(F.col("path").rlike(r"/[^/.]+\.(ts|js|go|java)$"))
    named = F.concat(F.lit("src/"), F.regexp_replace(P.basename("path"), r"\.([a-z]+)$", ".test.$1"))
    t = p.select(named.alias("path")).distinct()
    return t.select("path", F.get(P.test_targets("path"), F.lit(0)).alias("target"))


@query("SELECT DISTINCT file_id, sha256(content) AS digest, length(content) AS n_chars, octet_length(encode(content)) AS n_bytes FROM corpus_files WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus_files").where(F.col("content").isNotNull())
    return c.select("file_id", F.sha2("content", 256).alias("digest"), F.length("content").cast("bigint").alias("n_chars"), F.octet_length("content").cast("bigint").alias("n_bytes")).distinct()


@query("SELECT DISTINCT id, 'idx_' || substr(sha256(repo_root || '|' || worktree_path || '|' || branch_name || '|' || coalesce(head_sha, '')), 1, 32) AS identity FROM index_rows")
def index_identity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "index_rows").select("id", X.index_identity().alias("identity")).distinct()


@query(
    "SELECT DISTINCT id, rtrim(translate(to_base64(encode(start_line || '|' || id)), '+/', '-_'), '=') AS cursor, start_line::BIGINT AS back, 0::BIGINT AS broken FROM chunks"
)
def cursor_codec(spark: SparkSession, sf: str) -> DataFrame:
    c = X.encode_cursor("start_line", "id")
    return table(spark, sf, "chunks").select("id", c.alias("cursor"), X.decode_cursor(c).cast("bigint").alias("back"), X.decode_cursor(F.lit("!?")).cast("bigint").alias("broken")).distinct()


@query(
    "SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM events"
)
def confidence_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", S.confidence_label(F.col("value") / 100).alias("label"))


_DEDENT = (
    "SELECT id, sha256(array_to_string(list_transform(lines, lambda l: CASE WHEN length(l) >= least_ THEN substr(l, least_ + 1) ELSE l END), chr(10))) AS digest, least_::BIGINT AS indent FROM ("
    "SELECT id, lines, coalesce(list_min(list_transform(list_filter(lines, lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')), lambda l: length(regexp_extract(l, '^([ \\t]*)', 1)))), 0) AS least_ "
    "FROM (SELECT DISTINCT id, string_split(content, chr(10)) AS lines FROM chunks))"
)


@query(_DEDENT)
def dedent_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "content").distinct()
    lines = F.filter(F.split("content", "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    indent = F.coalesce(F.array_min(F.transform(lines, lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1)))), F.lit(0))
    return c.select("id", F.sha2(X.dedent("content"), 256).alias("digest"), indent.cast("bigint").alias("indent"))


_TERM = "return shelf"


@query(
    "SELECT id, sha256(CASE WHEN at_ IS NULL THEN CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || chr(10) || '…' ELSE content END ELSE "
    "(CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(content, s + 1, least(length(content), s + 500) - s) || (CASE WHEN least(length(content), s + 500) < length(content) THEN chr(10) || '…' ELSE '' END) END) AS digest "
    "FROM (SELECT *, greatest(0, at_ - 1 - 250) AS s FROM (SELECT DISTINCT id, content, list_min(list_filter([strpos(lower(content), 'return'), strpos(lower(content), 'shelf')], lambda x: x > 0)) AS at_ FROM chunks))"
)
def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "content").distinct()
    return c.select("id", F.sha2(X.snippet_window("content", F.lit(_TERM), 500), 256).alias("digest"))


@query(
    "SELECT id, sha256(CASE WHEN length(l) > 200 THEN substr(l, 1, 200) || '…' ELSE l END) AS digest FROM (SELECT id, trim(coalesce(list_filter(lines, lambda x: contains(lower(x), 'return') OR contains(lower(x), 'shelf'))[1], lines[1], '')) AS l "
    "FROM (SELECT DISTINCT id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM chunks))"
)
def headline(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("id", "content").distinct()
    return c.select("id", F.sha2(X.headline_text("content", F.lit(_TERM), F.lit(None).cast("string")), 256).alias("digest"))
