"""Column builders over text: query tokens, identifier parts, search tokens, dedent, previews, hashes and cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that previews and generated queries pass over.
PREVIEW_STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "is", "on"]

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def query_tokens(query: Text, min_length: int = 1, stopwords: list[str] | None = None) -> Column:
    """The runs of letters, digits and underscores of a query, in their order."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else None

    def keep(t: Column) -> Column:
        long = F.length(t) >= max(1, min_length)
        return long & ~F.array_contains(stop, F.lower(t)) if stop is not None else long

    return F.filter(F.split(_col(query), "[^A-Za-z0-9_]+"), keep)


# Where an identifier is cut, besides its underscores.
ACRONYM_END, CASE_CHANGE = "([A-Z]+)([A-Z][a-z])", "([a-z0-9])([A-Z])"
#: An identifier in one piece is passed over; one that has a place where it is cut is the group.
_COMPOUND = r"_*+(?:[A-Z]?+[a-z0-9]++|[A-Z]++(?:[0-9][a-z0-9]*+)?+)_*+(?![A-Za-z0-9_])|([A-Za-z_][A-Za-z0-9_]*+)"


def identifier_parts(identifier: Text) -> Column:
    """An identifier cut at underscores and changes of case; of a text with blanks, all its identifiers' parts."""
    words = F.regexp_replace(F.regexp_replace(_col(identifier), ACRONYM_END, "$1 $2"), CASE_CHANGE, "$1 $2")
    return F.filter(F.split(words, "[^A-Za-z0-9]+"), lambda p: p != "")


def split_identifiers(text: Text, min_length: int = 3, most: int = 128) -> Column:
    """The lower-case parts of all compound identifiers of a text: at least ``min_length`` long, no bare numbers, each
    once in the order of first sight, at most ``most``.

    The compound ones are cut together, as one text, so the patterns run once over each text.
    """
    compound = F.array_join(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(_COMPOUND), 1)), " ")
    parts = F.array_distinct(identifier_parts(F.concat(compound, F.lit(" "))))
    kept = F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: (F.length(p) >= min_length) & ~p.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, most)


def with_subtokens(content: Text) -> Column:
    """The text that is matched: the content and, on a line of its own, its identifiers' parts."""
    own = _col(content)
    added = F.transform(  # over one element, so that the parts are found once
        F.array(split_identifiers(content)), lambda parts: F.when(F.size(parts) > 0, F.concat(own, F.lit("\n"), F.array_join(parts, " "))).otherwise(own)
    )
    return F.get(added, F.lit(0))


def search_tokens(text: Text) -> Column:
    """The tokens of the inverted index: runs of letters, digits and private characters, in lower case."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def utf16_length(text: Text) -> Column:
    """The length in UTF-16 units, in which limits of chunks are given."""
    return (F.octet_length(F.encode(_col(text), "UTF-16LE")) / 2).cast("int")


def dedent(text: Text) -> Column:
    """Without the indentation that all lines with something on them share; tabs count as one."""
    lines = F.split(_col(text), "\n")
    blanks = F.transform(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""), lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1)))
    least = F.coalesce(F.array_min(blanks), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.length(x) >= least, F.substr(x, least + 1)).otherwise(x)), "\n")


def preview_terms(query: Text) -> Column:
    return query_tokens(F.lower(_col(query)), 2, PREVIEW_STOPWORDS)


def snippet_window(content: Text, query: Text, most: int = 1500) -> Column:
    """A window of at most ``most`` characters around the earliest term, with marks where it cuts, before highlighting."""
    content, terms = _col(content), preview_terms(query)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(content), t)), lambda at: at > 0))
    start = F.greatest(F.lit(0), first - 1 - most // 2)
    end = F.least(F.length(content), start + most)
    around = F.concat(
        F.when(start > 0, "…").otherwise(""), F.substr(content, start + 1, end - start), F.when(end < F.length(content), "\n…").otherwise("")
    )
    head = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("\n…"))).otherwise(content)
    return F.when(first.isNull(), head).otherwise(around)


def highlighted(text: Text, terms: Column) -> Column:
    """Each occurrence of each term in asterisks, whatever its case; terms are words, so they need no escaping."""
    return F.reduce(terms, _col(text), lambda done, t: F.regexp_replace(done, F.concat(F.lit("(?i)("), t, F.lit(")")), F.lit("**$1**")))


def snippet(content: Text, query: Text, most: int = 1500) -> Column:
    return highlighted(dedent(snippet_window(content, query, most)), preview_terms(query))


def headline_text(content: Text, query: Text, signature: Text, most: int = 200) -> Column:
    """The signature, else the first line with a term, else the first line with anything, cut to ``most`` characters."""
    terms = preview_terms(query)
    lines = F.filter(F.split(_col(content), "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    hit = F.filter(lines, lambda x: F.exists(terms, lambda t: F.contains(F.lower(x), t)))
    own = F.trim(_col(signature))
    line = F.trim(F.coalesce(F.when(own != "", own), F.get(hit, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def headline(content: Text, query: Text, signature: Text, most: int = 200) -> Column:
    return highlighted(headline_text(content, query, signature, most), preview_terms(query))


def strip_quotes(text: Text) -> Column:
    return F.regexp_replace(_col(text), "^[\"'`]|[\"'`]$", "")


def first_line(text: Text) -> Column:
    return F.get(F.split(_col(text), "\n"), F.lit(0))


def escape_pattern(text: Text) -> Column:
    """The text as a regular expression that matches itself."""
    return F.regexp_replace(_col(text), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def hash_id(prefix: str, *parts: Text, length: int = 32, separator: str = "|") -> Column:
    """``prefix`` and the first characters of the SHA-256 of the joined parts; a null part counts as empty."""
    joined = F.concat_ws(separator, *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def index_identity(repo_root: Text = "repo_root", worktree: Text = "worktree_path", branch: Text = "branch_name", head: Text = "head_sha") -> Column:
    """The id of an index; an error where the repository, or the commit of a branch, is missing."""
    missing = _col(repo_root).isNull() | (_col(head).isNull() & (F.coalesce(_col(branch), F.lit("")) != "DETACHED"))
    return F.when(missing, F.raise_error(F.lit("an index needs a repository, and a commit unless it is detached"))).otherwise(
        hash_id("idx_", repo_root, worktree, branch, head)
    )


def encode_cursor(rank: Text, handle: Text) -> Column:
    raw = F.base64(F.encode(F.concat_ws("|", _col(rank).cast("string"), _col(handle)), "UTF-8"))
    return F.rtrim(F.translate(F.regexp_replace(raw, r"[\r\n]", ""), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Text) -> Column:
    """The rank in a cursor; 0 for none or a broken one."""
    plain = F.translate(_col(cursor), "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.coalesce(F.expr("1") * F.get(F.split(text, r"\|"), F.lit(0)).try_cast("bigint"), F.lit(0))
