"""Queries of the search, exploration and graph operators.

The corpus is taken as one index, and the search texts among the documents as the set of queries. The relation graph is
drawn from the orders: who imports, calls, references and tests what is invented, its shape is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import paths as P
from codeseam.functions import scoring as S
from codeseam.functions import text as X
from codeseam.operators import bm25, chunking, evaluation, extract, graph, search
from codeseam.plans.textual import SPLIT, first_seen
from codeseam.session import checkpointed, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").withColumn("index_id", F.lit("all"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "symbols").dropDuplicates(["id"]).withColumn("index_id", F.lit("all"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where((F.col("doc_type") == "query") & F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.lit("all").alias("index_id"))


# -- BM25 --------------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
_PARTS = first_seen(SPLIT.format("content", 3), 128)
_BM25 = f"""
WITH c AS (SELECT id, any_value(content) AS content, any_value(path) AS path, any_value(content_type) AS content_type, any_value(symbol_id) AS symbol_id,
                  any_value(start_line) AS start_line, any_value(end_line) AS end_line FROM chunks GROUP BY id),
e AS (SELECT id, {_TOK.format("CASE WHEN len(p) > 0 THEN content || chr(10) || array_to_string(p, ' ') ELSE content END")} AS w1, {_TOK.format("path")} AS w2
      FROM (SELECT id, content, path, {_PARTS} AS p FROM c)),
lens AS (SELECT id, len(w1) + len(w2) AS dl FROM e),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
q AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_type = 'query' AND text IS NOT NULL),
tok AS (SELECT query_id, pos, term FROM (SELECT query_id, {first_seen("list_filter(string_split_regex(query, '[^A-Za-z0-9_]+'), lambda t: t <> '')", 1000)} AS l FROM q), unnest(l) WITH ORDINALITY AS u(term, pos)),
parts AS (SELECT query_id, pos, {first_seen(SPLIT.format("term", 3), 16)} AS l FROM tok),
phrases AS (
  SELECT query_id, pos * 2 AS clause, 0 AS k, {_TOK.format("term")} AS words FROM tok
  UNION ALL
  SELECT query_id, pos * 2 + 1, k, {_TOK.format("part")} FROM parts, unnest(l) WITH ORDINALITY AS u(part, k) WHERE len(l) > 1),
live AS (SELECT * FROM phrases WHERE len(words) > 0),
shape AS (SELECT query_id, clause, list(words ORDER BY k) AS s FROM live GROUP BY ALL),
kept AS (SELECT query_id, min(clause) AS clause FROM shape GROUP BY query_id, s),
cl AS (SELECT * FROM live JOIN kept USING (query_id, clause)),
pw AS (SELECT DISTINCT words FROM cl),
occ AS (SELECT id, w, generate_subscripts(w, 1) AS i FROM (SELECT id, w1 AS w FROM e UNION ALL SELECT id, w2 FROM e)),
hit AS (SELECT occ.id, pw.words, count(*) AS tf FROM occ JOIN pw ON occ.w[occ.i] = pw.words[1] WHERE list_slice(occ.w, occ.i, occ.i + len(pw.words) - 1) = pw.words GROUP BY 1, 2),
df AS (SELECT words, count(*) AS n_with FROM hit GROUP BY 1),
part AS (SELECT hit.id, hit.words, CASE WHEN ln((n - n_with + 0.5) / (n_with + 0.5)) > 0 THEN ln((n - n_with + 0.5) / (n_with + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
         FROM hit JOIN df USING (words) JOIN lens USING (id), stats),
need AS (SELECT query_id, clause, count(*) AS needed FROM cl GROUP BY ALL),
per AS (SELECT cl.query_id, part.id, cl.clause, sum(s) AS s, count(DISTINCT k) AS there FROM part JOIN cl USING (words) GROUP BY ALL),
score AS (SELECT query_id, id, -sum(s) AS bm25 FROM per JOIN need USING (query_id, clause) WHERE there = needed GROUP BY ALL)
"""


@query(_BM25 + "SELECT query_id, id AS chunk_id, round(bm25, 6) AS bm25 FROM score")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = bm25.score(bm25.chunk_tokens(corpus(spark, sf)), asked(spark, sf), "global")
    return s.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


_TOP = "rank_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) AS place FROM score)\n"


@query(_BM25 + ", " + _TOP + "SELECT query_id, id AS chunk_id, place FROM rank_ WHERE place <= 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = search.candidates(corpus(spark, sf), asked(spark, sf), 5, scope="global")
    return found.select("query_id", "chunk_id", F.col("place").cast("bigint").alias("place"))


@query()
def bm25_porter(spark: SparkSession, sf: str) -> DataFrame:
    s = bm25.score(bm25.chunk_tokens(corpus(spark, sf), stem=True), asked(spark, sf), "global", stem=True)
    return s.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


@query(
    "SELECT term, count(DISTINCT id) AS n_with, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}\\p{Co}]+')) AS term FROM (SELECT DISTINCT id, content FROM chunks)) GROUP BY term"
)
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    post = bm25.postings(bm25.chunk_tokens(corpus(spark, sf), subtokens=False)).where(F.col("field") == "content")
    return post.groupBy("term").agg(F.count("*").alias("n_with"), F.sum("tf").alias("n"))


# -- ranking -----------------------------------------------------------------------------------------------------------

_SIGNALS = (
    _BM25
    + ", "
    + _TOP
    + f""",
found AS (SELECT r.query_id, r.id, r.bm25, r.place, c.path, c.start_line, c.end_line, c.content_type, c.symbol_id FROM rank_ r JOIN c ON r.id = c.id WHERE place <= 20),
terms AS (SELECT query_id, list_filter(list_distinct(list_transform(list_concat(list_filter(string_split_regex(query, '[^A-Za-z0-9_]+'), lambda t: t <> ''), {first_seen(SPLIT.format("query", 3), 16)}), lambda t: lower(t))), lambda t: length(t) > 1) AS terms FROM q),
sy AS (SELECT DISTINCT id, path, lower(name) AS name FROM symbols),
filehit AS (SELECT f.query_id, f.path, bool_or(len(list_filter(t.terms, lambda x: contains(sy.name, x))) > 0) AS part, bool_or(list_contains(t.terms, sy.name)) AS whole
            FROM (SELECT DISTINCT query_id, path FROM found) f JOIN terms t USING (query_id) JOIN sy ON sy.path = f.path GROUP BY ALL),
seeds AS (SELECT DISTINCT query_id, path FROM found WHERE place <= 8),
sig AS (SELECT f.*, CASE WHEN max(-bm25) OVER w = min(-bm25) OVER w THEN 1.0 ELSE (-bm25 - min(-bm25) OVER w) / (max(-bm25) OVER w - min(-bm25) OVER w) END AS fts,
  CASE WHEN len(list_filter(t.terms, lambda x: contains(coalesce(o.name, ''), x))) > 0 THEN 1.0 WHEN h.part THEN 0.5 ELSE 0.0 END AS symbol,
  CASE WHEN list_contains(t.terms, coalesce(o.name, '')) THEN 1.0 WHEN h.whole THEN 0.5 ELSE 0.0 END AS exact,
  CASE WHEN s.path IS NOT NULL THEN 1.0 ELSE 0.0 END AS graph,
  CASE WHEN len(list_filter(t.terms, lambda x: contains(lower(f.path), x))) > 0 THEN 1.0 ELSE 0.0 END AS path_hit,
  CASE WHEN content_type = 'code' THEN 1.0 ELSE 0.0 END AS code
  FROM found f JOIN terms t USING (query_id) LEFT JOIN sy o ON o.id = f.symbol_id LEFT JOIN filehit h ON h.query_id = f.query_id AND h.path = f.path LEFT JOIN seeds s ON s.query_id = f.query_id AND s.path = f.path
  WINDOW w AS (PARTITION BY f.query_id))
"""
)


@query(_SIGNALS + "SELECT query_id, id AS chunk_id, round(fts, 6) AS fts, symbol, exact, graph, path_hit, code FROM sig")
def search_signals(spark: SparkSession, sf: str) -> DataFrame:
    q = asked(spark, sf)
    s = search.signals(search.candidates(corpus(spark, sf), q, 5, scope="global"), q, names(spark, sf), None)
    return s.select("query_id", "chunk_id", F.round("fts", 6).alias("fts"), "symbol", "exact", "graph", "path_hit", "code")


def _fuse(weights: dict[str, float]) -> str:
    w = S.redistributed(weights, [k for k in weights if k != "recency"])
    total = " + ".join(f"{k} * {w[k]!r}" for k in ("fts", "symbol", "graph", "code", "path_hit", "exact"))
    return (
        _SIGNALS
        + f", fused AS (SELECT *, {total} AS raw FROM sig), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, path, start_line, id) - 1 AS rank FROM fused)\n"
    )


_WHY = "array_to_string(list_filter([CASE WHEN fts > 0 THEN 'fts' END, CASE WHEN symbol > 0 THEN 'symbol' END, CASE WHEN exact > 0 THEN 'exact' END, CASE WHEN graph > 0 THEN 'graph' END, CASE WHEN path_hit > 0 THEN 'path' END, CASE WHEN code > 0 THEN 'code' END], lambda x: x IS NOT NULL), ',')"
_PAGE = "SELECT query_id, rank, id AS handle, floor(raw * 1000 + 0.5) / 1000 AS score, " + _WHY + " AS why FROM placed WHERE rank >= {0} AND rank < {1}"


def _page(spark: SparkSession, sf: str, weights: dict[str, float], offset: int = 0) -> DataFrame:
    r = search.search(
        corpus(spark, sf), names(spark, sf), None, asked(spark, sf), 5, offset, weights=weights, snippet="none", stem=False, scope="global", locale_order=False
    )
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "handle", "score", "why")


@query(_fuse(S.WEIGHTS) + _PAGE.format(0, 5))
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, S.WEIGHTS)


@query(_fuse(S.LEXICAL) + _PAGE.format(0, 5))
def hybrid_rank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, S.LEXICAL)


@query(_fuse(S.FTS_ONLY) + _PAGE.format(0, 5))
def hybrid_rank_fts_only(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, S.FTS_ONLY)


@query(_fuse(S.WEIGHTS) + _PAGE.format(5, 10))
def search_page2(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, S.WEIGHTS, 5)


@query()
def search_full(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "files").where(~F.col("deleted")).select(F.lit("all").alias("index_id"), "path")
    return search.search(corpus(spark, sf), names(spark, sf), graph.test_edges(files), asked(spark, sf), scope="global")


_EXPLORE = (
    _fuse(S.WEIGHTS).replace("place <= 20", "place <= 32")
    + ", pg AS (SELECT query_id, rank, id AS handle, path, start_line || '-' || end_line AS lines, floor(raw * 1000 + 0.5) / 1000 AS score, "
    + _WHY
    + " AS why, symbol_id FROM placed WHERE rank < 8), "
    "sg AS (SELECT pg.*, coalesce(s.signature, s.kind || ' ' || s.name) AS signature FROM pg LEFT JOIN (SELECT DISTINCT id, name, kind, signature FROM symbols) s ON s.id = pg.symbol_id), "
    "g AS (SELECT query_id, path, coalesce(signature, chr(1) || handle) AS grp, arg_min(handle, rank) AS handle, arg_min(lines, rank) AS lines, arg_min(score, rank) AS score, arg_min(why, rank) AS why, count(*) AS collapsed FROM sg GROUP BY 1, 2, 3), "
    "it AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, lines, handle) AS item_no, max(score) OVER (PARTITION BY query_id, path) AS best FROM g), "
    "f AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, path) AS file_no FROM it), "
    "z AS (SELECT *, greatest(max(file_no) OVER (PARTITION BY query_id) - 6, 0) AS omitted_files, (sum((item_no > 3)::INT) OVER (PARTITION BY query_id))::BIGINT AS omitted_results FROM f) "
    "SELECT query_id, file_no, path, item_no, handle, lines, score, why, collapsed, omitted_files, omitted_results FROM z WHERE item_no <= 3 AND file_no <= 6"
)


@query(_EXPLORE)
def explore_groups(spark: SparkSession, sf: str) -> DataFrame:
    q = asked(spark, sf)
    hits = search.search(corpus(spark, sf), names(spark, sf), None, q, 8, snippet="none", stem=False, scope="global", locale_order=False)
    out = search.explore(hits, corpus(spark, sf), names(spark, sf), locale_order=False).drop("preview", "signature")
    return _big(out.withColumn("collapsed", F.coalesce("collapsed", F.lit(1))), "file_no", "item_no", "omitted_files", "omitted_results", "collapsed")


_RANGES = (
    "WITH c AS (SELECT DISTINCT id, file_id, start_line, end_line FROM chunks), s AS (SELECT DISTINCT id, file_id, name, kind, signature, start_line, end_line FROM symbols) "
    "SELECT c.id AS chunk_id, arg_min(coalesce(s.signature, s.kind || ' ' || s.name), struct_pack(a := NOT (contains(lower(s.name), 'er') OR contains(lower(s.name), 'map')), b := s.end_line - s.start_line, c := s.id)) AS signature "
    "FROM c LEFT JOIN s ON c.file_id = s.file_id AND s.start_line <= c.end_line AND s.end_line >= c.start_line GROUP BY 1"
)


@query(_RANGES)
def range_overlap_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk as a result of its file, with two terms that some names have."""
    c = table(spark, sf, "chunks").select(F.lit(0).alias("query_id"), F.col("file_id").alias("index_id"), F.col("id").alias("chunk_id"), "path", "start_line", "end_line").distinct()
    s = table(spark, sf, "symbols").withColumn("index_id", F.col("file_id"))
    best = search.headline_symbols(c.withColumn("terms", F.array(F.lit("er"), F.lit("map"))), s)
    return best.select("chunk_id", F.col("headline_signature").alias("signature"))


_OUTLINE = (
    "WITH s AS (SELECT DISTINCT id, index_id, path, name, kind, signature, start_line, end_line, exported FROM symbols {0}), f AS (SELECT index_id, path, row_number() OVER (PARTITION BY index_id ORDER BY path) AS file_no FROM (SELECT DISTINCT index_id, path FROM s)) "
    "SELECT s.index_id, file_no, s.path, row_number() OVER (PARTITION BY s.index_id, s.path ORDER BY start_line, id) AS symbol_no, name, kind, signature, start_line || '-' || end_line AS lines, exported FROM s JOIN f ON s.index_id = f.index_id AND s.path = f.path WHERE file_no <= {1}"
)


def _big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query(_OUTLINE.format("WHERE exported", 50))
def outline_exported(spark: SparkSession, sf: str) -> DataFrame:
    return _big(search.outline(table(spark, sf, "symbols")), "file_no", "symbol_no")


@query(_OUTLINE.format("WHERE starts_with(path, 'src/')", 3))
def outline_capped(spark: SparkSession, sf: str) -> DataFrame:
    return _big(search.outline(table(spark, sf, "symbols"), "src", 3, True), "file_no", "symbol_no")


@query(
    "WITH s AS (SELECT DISTINCT id, path, name, start_line FROM symbols), n AS (SELECT unnest(['closeParser', 'Ledger', 'park', 'nothing_like_it']) AS wanted), "
    "e AS (SELECT n.wanted, s.*, true AS exact FROM n JOIN s ON s.name = n.wanted), p AS (SELECT n.wanted, s.*, false AS exact FROM n JOIN s ON contains(s.name, n.wanted) WHERE n.wanted NOT IN (SELECT wanted FROM e)) "
    "SELECT wanted, id, exact FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY path, start_line, id) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM p)) WHERE r <= 20"
)
def symbol_resolve(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("all", w) for w in ("closeParser", "Ledger", "park", "nothing_like_it")], "index_id string, wanted string")
    return graph.resolve_symbol(names(spark, sf), wanted).select("wanted", "id", "exact")


@query(
    "SELECT c.id, array_to_string(string_split(f.content, chr(10))[c.start_line:c.end_line], chr(10)) = c.content AS same, length(c.content) > 4000 AS truncated "
    "FROM (SELECT DISTINCT id, file_id, start_line, end_line, content FROM chunks) c JOIN corpus_files f ON c.file_id = f.file_id"
)
def expand_handles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").dropDuplicates(["id"])
    t = c.select(F.col("id").alias("target"), F.col("file_id").alias("index_id"), F.col("id").alias("handle"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    files = table(spark, sf, "corpus_files").select(F.col("file_id").alias("index_id"), "path", "content")
    got = search.expand(t, files, c.withColumn("index_id", F.col("file_id")))
    cut = F.when(F.length("content") > 4000, F.concat(F.substring("content", 1, 4000), F.lit("\n… (truncated)"))).otherwise(F.col("content"))
    return got.join(c.select(F.col("id").alias("target"), X.dedent(cut).alias("own")), "target").select(F.col("target").alias("id"), (F.col("text") == F.col("own")).alias("same"), "truncated")


_GREP = (
    "SELECT query_id, rank, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM (SELECT DISTINCT q.query_id, f.path, len(list_filter(q.terms, lambda t: contains(lower(f.path), t))) AS n "
    "FROM (SELECT doc_id AS query_id, "
    + first_seen(
        "list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ('a','an','and','change','find','for','from','impact','in','of','on','the','to'))", 8
    )
    + " AS terms FROM documents WHERE doc_type = 'query' AND text IS NOT NULL) q JOIN corpus_files f ON len(list_filter(q.terms, lambda t: contains(lower(f.content), t))) > 0)) WHERE rank <= 10"
)


@query(_GREP)
def rg_baseline(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "corpus_files").withColumn("index_id", F.lit("all"))
    return _big(search.grep_baseline(f, asked(spark, sf), locale_order=False), "rank")


# -- chunks, symbols and edges -----------------------------------------------------------------------------------------


@query()
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_files(table(spark, sf, "corpus_files")).drop("content")


@query()
def structured_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_files(table(spark, sf, "corpus_files"), table(spark, sf, "symbols")).drop("content")


@query()
def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_symbols(table(spark, sf, "corpus_files"))


@query()
def extract_edges(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_relations(table(spark, sf, "corpus_files"))


@query(
    "WITH s AS (SELECT DISTINCT id, index_id, path, exported FROM symbols) SELECT index_id, path, 'defines' AS type, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT index_id, path, 'belongs_to', count(*) FROM s GROUP BY ALL "
    "UNION ALL SELECT index_id, path, 'exports', count(*) FROM s WHERE exported GROUP BY ALL"
)
def symbol_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.symbol_edges(table(spark, sf, "symbols"))
    return e.groupBy("index_id", F.col("from_path").alias("path"), "type").agg(F.count("*").alias("n"))


EDGES = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b, 'imports' AS type, 0.9 AS conf FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey, 'calls', 0.7 FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references', 0.6 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'references', 0.6 FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'tests', 0.8 FROM nation
  UNION ALL SELECT DISTINCT 'tests/l' || l_linenumber, 'p' || l_partkey, 'tests', 0.8 FROM lineitem WHERE l_linenumber = 7
  UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey, 'defines', 1.0 FROM part),
starts AS (SELECT 'p' || p_partkey AS start FROM part WHERE p_partkey % 50 = 0)
"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph, drawn once and written, as stored edges would be."""
    t = lambda name: table(spark, sf, name)
    node = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))

    def e(df: DataFrame, a, b, kind: str, confidence: float) -> DataFrame:
        return df.select(F.lit("all").alias("index_id"), a.alias("from_path"), b.alias("to_path"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    out = e(t("lineitem"), node("o", "l_orderkey"), node("p", "l_partkey"), "imports", 0.9).distinct()
    out = out.unionByName(e(t("orders"), node("o", "o_orderkey"), node("c", "o_custkey"), "calls", 0.7).distinct())
    out = out.unionByName(e(t("customer"), node("c", "c_custkey"), node("n", "c_nationkey"), "references", 0.6))
    out = out.unionByName(e(t("supplier"), node("s", "s_suppkey"), node("n", "s_nationkey"), "references", 0.6))
    out = out.unionByName(e(t("nation"), node("n", "n_nationkey"), node("r", "n_regionkey"), "tests", 0.8))
    out = out.unionByName(e(t("lineitem").where(F.col("l_linenumber") == 7), node("tests/l", "l_linenumber"), node("p", "l_partkey"), "tests", 0.8).distinct())
    return checkpointed(out.unionByName(e(t("part"), node("p", "p_partkey"), node("p", "p_partkey"), "defines", 1.0)))


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """The stated set of start nodes: every fiftieth part, against all edges."""
    p = table(spark, sf, "part").where(F.col("p_partkey") % 50 == 0)
    return p.select(F.lit("all").alias("index_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("start"))


def _walk(name: str, direction: str, depth: int, types: list[str] | None = None) -> str:
    only = f" AND type IN ({', '.join(repr(t) for t in types)})" if types else ""
    out = f"SELECT a, b, type, conf FROM e WHERE a <> b{only}"
    back = f"SELECT b AS a, a AS b, type, conf FROM e WHERE a <> b{only}"
    steps = {"out": out, "in": back, "both": f"{out} UNION ALL {back}"}[direction]
    return (
        f", {name}_s AS ({steps}), {name}_w AS (SELECT start, start AS node, '' AS type, 0.0 AS conf, 0 AS hops, [start] AS seen FROM starts UNION ALL "
        f"SELECT w.start, s.b, s.type, s.conf, w.hops + 1, list_append(w.seen, s.b) FROM {name}_w w JOIN {name}_s s ON w.node = s.a WHERE w.hops < {depth} AND NOT list_contains(w.seen, s.b)), "
        f"{name} AS (SELECT start, node AS path, type AS edge_type, min(hops)::BIGINT AS hops, max(conf)::DOUBLE AS confidence FROM {name}_w WHERE hops > 0 GROUP BY ALL)"
    )


def _near(df: DataFrame) -> DataFrame:
    return df.select("start", "path", "edge_type", F.col("hops").cast("bigint").alias("hops"), "confidence")


@query(EDGES.replace("'p' || p_partkey AS start FROM part WHERE p_partkey", "DISTINCT 'o' || o_orderkey AS start FROM orders WHERE o_orderkey") + _walk("x", "out", 3) + " SELECT * FROM x")
def neighbors_out(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 50 == 0).select(F.lit("all").alias("index_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("start"))
    return _near(graph.neighbors(edges(spark, sf), o, depth=3, direction="out"))


@query(EDGES + _walk("x", "in", 2) + " SELECT * FROM x")
def neighbors_in(spark: SparkSession, sf: str) -> DataFrame:
    return _near(graph.neighbors(edges(spark, sf), starts(spark, sf), depth=2, direction="in"))


@query(EDGES + _walk("x", "both", 2) + " SELECT * FROM x")
def neighbors_both(spark: SparkSession, sf: str) -> DataFrame:
    return _near(graph.neighbors(edges(spark, sf), starts(spark, sf)))


@query(EDGES + _walk("x", "both", 3, ["imports", "calls"]) + " SELECT * FROM x")
def neighbors_depth3(spark: SparkSession, sf: str) -> DataFrame:
    return _near(graph.neighbors(edges(spark, sf), starts(spark, sf), ["imports", "calls"], 3))


@query(EDGES + " SELECT start, a AS path, 'tests' AS edge_type, 1::BIGINT AS hops, max(conf)::DOUBLE AS confidence FROM e JOIN starts ON b = start WHERE type = 'tests' GROUP BY ALL")
def tests_for(spark: SparkSession, sf: str) -> DataFrame:
    return _near(graph.tests_for(edges(spark, sf), starts(spark, sf)))


_CALLERS, _CALLEES, _AFFECTED = ["calls", "references", "imports", "imported_by"], ["calls", "references", "imports"], ["imported_by", "references", "calls"]
_BEST = "(SELECT start, path, edge_type, hops, confidence FROM (SELECT *, row_number() OVER (PARTITION BY start, path, edge_type ORDER BY hops, confidence DESC) AS r FROM {0}) WHERE r = 1)"
_IMPACT = (
    EDGES
    + _walk("callers", "in", 2, _CALLERS)
    + _walk("callees", "out", 2, _CALLEES)
    + _walk("more", "in", 2, _AFFECTED)
    + ", affected AS "
    + _BEST.format("(SELECT * FROM callers UNION ALL SELECT * FROM more)")
)
_LABEL = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END"


@query(
    _IMPACT
    + f" SELECT start, 'caller' AS relation, path, edge_type, hops, confidence, 'graph' AS provenance, {_LABEL} AS confidence_label FROM callers UNION ALL SELECT start, 'callee', path, edge_type, hops, confidence, 'graph', {_LABEL} FROM callees "
    f"UNION ALL SELECT start, 'affected_file', path, edge_type, hops, confidence, 'graph', {_LABEL} FROM affected"
)
def impact_files(spark: SparkSession, sf: str) -> DataFrame:
    i = graph.impact(edges(spark, sf), starts(spark, sf), 2, False)
    return i.select("start", "relation", "path", "edge_type", F.col("hops").cast("bigint").alias("hops"), "confidence", "provenance", "confidence_label")


@query(
    _IMPACT
    + ", t AS (SELECT start, a AS path, 1::BIGINT AS hops, conf::DOUBLE AS confidence FROM e JOIN starts ON b = start WHERE type = 'tests' UNION ALL SELECT f.start, e.a, 1, e.conf FROM affected f JOIN e ON e.b = f.path WHERE e.type = 'tests' "
    f"UNION ALL SELECT start, path, hops, least(confidence, 0.6) FROM affected WHERE regexp_matches(path, '{P.IMPACT_TEST}')) "
    "SELECT start, path, min(hops) AS hops FROM t GROUP BY ALL"
)
def impact_tests(spark: SparkSession, sf: str) -> DataFrame:
    i = graph.impact(edges(spark, sf), starts(spark, sf)).where(F.col("relation") == "affected_test")
    return i.select("start", "path", F.col("hops").cast("bigint").alias("hops"))


@query(EDGES + " SELECT b AS to_path, count(DISTINCT a) AS n, min(a) AS first, max(a) AS last FROM e WHERE a <> b AND type IN ('imports', 'calls', 'references') GROUP BY 1")
def expected_callers(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.expected_callers(edges(spark, sf))


_ORDERED = " SELECT start, path, edge_type, n FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, confidence DESC, edge_type, path) AS n FROM {0}) WHERE n <= 10"


@query(EDGES + _walk("x", "both", 2) + _ORDERED.format("x"))
def neighbors_ordered(spark: SparkSession, sf: str) -> DataFrame:
    near = graph.ordered(graph.neighbors(edges(spark, sf), starts(spark, sf))).where(F.col("n") <= 10)
    return _big(near.select("start", "path", "edge_type", "n"), "n")


@query(_IMPACT + _ORDERED.format("affected"))
def impact_ordered(spark: SparkSession, sf: str) -> DataFrame:
    i = graph.impact(edges(spark, sf), starts(spark, sf), 2, False).where(F.col("relation") == "affected_file")
    return _big(graph.ordered(i).where(F.col("n") <= 10).select("start", "path", "edge_type", "n"), "n")


@query(
    EDGES
    + _walk("callers", "in", 1, _CALLERS)
    + ", f AS (SELECT start, path, min(struct_pack(a := hops, b := -confidence, c := edge_type)) AS o FROM callers GROUP BY ALL), "
    "g AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY o, path) AS n FROM f) SELECT start AS task_id, array_to_string(list(path ORDER BY n), ',') AS found FROM g WHERE n <= 10 GROUP BY 1"
)
def eval_graph_arm(spark: SparkSession, sf: str) -> DataFrame:
    t = starts(spark, sf).select(F.col("start").alias("id"), F.lit("callers").alias("type"), "index_id", F.col("start").alias("target_path"))
    g = evaluation.graph_arm(edges(spark, sf), t).where(F.size("found_paths") > 0)
    return g.select("task_id", F.array_join("found_paths", ",").alias("found"))


# -- search with a graph between the corpus's files --------------------------------------------------------------------

_LINKS = (
    "links AS (SELECT a.path AS a, b.path AS b, ['imports', 'tests', 'calls', 'references'][(ascii(substr(sha256(a.path || b.path), 1, 1)) % 4) + 1] AS type "
    "FROM (SELECT DISTINCT path FROM chunks) a JOIN (SELECT DISTINCT path FROM chunks) b ON substr(sha256(a.path), 1, 3) = substr(sha256(b.path), 4, 3)), "
    "near AS (SELECT query_id, path FROM seeds UNION SELECT query_id, b FROM seeds JOIN links ON path = a UNION SELECT query_id, a FROM seeds JOIN links ON path = b)"
)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between files of the corpus, drawn by hashes of their paths: the imports of the test tables lead nowhere."""
    p = table(spark, sf, "chunks").select("path").distinct()
    a = p.select(F.col("path").alias("from_path"), F.substring(F.sha2("path", 256), 1, 3).alias("h"))
    b = p.select(F.col("path").alias("to_path"), F.substring(F.sha2("path", 256), 4, 3).alias("h"))
    kind = F.get(F.array(*map(F.lit, ("imports", "tests", "calls", "references"))), F.pmod(F.ascii(F.sha2(F.concat("from_path", "to_path"), 256)), F.lit(4)))
    return a.join(b, "h").select(F.lit("all").alias("index_id"), "from_path", "to_path", kind.alias("type"), F.lit(0.9).alias("confidence"))


_GRAPHED = _SIGNALS.replace("sig AS (", _LINKS + ",\nsig AS (").replace("LEFT JOIN seeds s", "LEFT JOIN near s")


@query(_GRAPHED + "SELECT query_id, id AS chunk_id, graph FROM sig")
def search_signals_graph(spark: SparkSession, sf: str) -> DataFrame:
    q = asked(spark, sf)
    s = search.signals(search.candidates(corpus(spark, sf), q, 5, scope="global"), q, names(spark, sf), links(spark, sf))
    return s.select("query_id", "chunk_id", "graph")


_FIRST = _fuse(S.WEIGHTS).replace(_SIGNALS, _GRAPHED)


@query(
    _FIRST
    + ", one AS (SELECT query_id, path FROM placed WHERE rank = 0) SELECT DISTINCT query_id, b AS path, type AS edge_type FROM one JOIN links ON a = path AND a <> b WHERE type IN ('imports', 'tests') "
    "UNION SELECT query_id, a, type FROM one JOIN links ON b = path AND a <> b WHERE type IN ('imports', 'tests')"
)
def search_related(spark: SparkSession, sf: str) -> DataFrame:
    q, e = asked(spark, sf), links(spark, sf)
    page = search.search(corpus(spark, sf), names(spark, sf), e, q, 5, snippet="none", stem=False, scope="global", locale_order=False)
    return search.related_to_first(page, q, e).select("query_id", "path", "edge_type")


_ARMS = ", ".join(
    f"arm_{i} AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY first, path) AS n FROM (SELECT query_id, path, min(rank) AS first FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({' + '.join(f'{k} * {w[k]!r}' for k in ('fts', 'symbol', 'graph', 'code', 'path_hit', 'exact'))}, 9) DESC, path, start_line, id) - 1 AS rank FROM sig) WHERE rank < 20 GROUP BY ALL))"
    for i, w in enumerate(S.redistributed(x, [k for k in x if k != "recency"]) for x in (S.WEIGHTS, S.LEXICAL, S.FTS_ONLY))
)


@query(
    _SIGNALS + ", " + _ARMS + f", rg AS ({_GREP.replace('rank <= 10', 'rank <= 5')}), every AS (SELECT query_id, 'full' AS arm, path, n FROM arm_0 UNION ALL SELECT query_id, 'lexical', path, n FROM arm_1 UNION ALL "
    "SELECT query_id, 'fts-only', path, n FROM arm_2 UNION ALL SELECT query_id, 'rg', path, rank FROM rg) SELECT query_id, arm, array_to_string(list(path ORDER BY n), ',') AS found FROM every WHERE n <= 5 GROUP BY ALL"
)
def eval_arms(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "corpus_files").withColumn("index_id", F.lit("all"))
    r = evaluation.retrieval_arms(corpus(spark, sf), names(spark, sf), None, f, asked(spark, sf), 5, scope="global", stem=False, locale_order=False)
    return r.select("query_id", "arm", F.array_join("found_paths", ",").alias("found"))


@query("SELECT DISTINCT file_id, name, start_line, end_line FROM symbols")
def symbols_found(spark: SparkSession, sf: str) -> DataFrame:
    """The declarations that the symbols table lists, as far as extraction finds them too: all of them."""
    keys = ["file_id", "name", "start_line", "end_line"]
    known = table(spark, sf, "symbols").select(*keys).distinct()
    return extract.extract_symbols(table(spark, sf, "corpus_files")).select(*keys).distinct().join(known, keys, "left_semi")
