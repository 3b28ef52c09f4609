"""Search over a corpus in native expressions: lines, matches, context, listings, statistics.

The native tier needs text content and a line-wise query; ``exact`` scans whole files with
byte semantics for everything else.  Lines are split where the row is: a search that only
filters and projects never shuffles.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import literals, template
from ..functions import pattern as P
from ..options import BinaryMode, Query
from ..sources.corpus import Corpus


def is_native(corpus: Corpus, q: Query, spans: bool = False) -> bool:
    return corpus.text and not (q.multiline or q.crlf or q.null_data) and q.encoding in ("auto", "none") and not (spans and q.compiled().can_be_empty)


def is_risky(q: Query) -> bool:
    """Whether Java's engine would need stack for each repetition: of more than one character, without a small bound."""
    c = q.compiled()

    def risky(n) -> bool:
        if n.kind == "rep" and (n.value[1] is None or n.value[1] > 100):
            kid = n.kids[0]
            while kid.kind == "group" and kid.value[0] is None:
                kid = kid.kids[0]
            if kid.kind not in ("lit", "class", "dot"):
                return True
        return any(map(risky, n.kids))

    return c.tree is not None and risky(c.tree)


def _tested(q: Query):
    """The test of a line by an engine that keeps its state on the heap."""
    pattern = "(?V1)" + q.compiled().python

    @F.pandas_udf("boolean")
    def test(lines: pd.Series) -> pd.Series:
        search = regex.compile(pattern).search
        return lines.map(lambda t: None if t is None else search(t) is not None)

    return test


def hit(text: Column, q: Query) -> Column:
    """Whether a line matches (inverted if the query is).  Risky patterns go through an Arrow function, which can't stand in a lambda."""
    if q.fixed and len(q.patterns) == 1 and not (q.insensitive or q.word or q.line):
        out = text.contains(q.patterns[0]) if q.patterns[0] else F.lit(True)
    elif is_risky(q):
        out = _tested(q)(text)
    else:
        out = text.rlike(q.compiled().java)
    return ~out if q.invert else out


def any_case(literal: str) -> str:
    """A regular expression for the literal, which is folded, in any case."""
    more = {"k": "\u212a", "s": "\u017f"}
    return "".join(f"[{c}{c.upper()}{more.get(c, '')}]" if c.isascii() and c.isalpha() else P.escape_char(c) for c in literal)


def _query_column(text: Column, query, folded: bool) -> Column:
    kind, value = query
    if folded and (kind == "lit" or kind == "or" and all(k == "lit" for k, _ in value)):
        return text.rlike("|".join(any_case(v) for v in ([value] if kind == "lit" else [v for _, v in value])))
    if kind == "lit":
        return text.contains(value)
    parts = [_query_column(text, p, folded) for p in value]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p
    return out


def uses_fold(node) -> bool:
    return node.flags.i and node.kind in ("lit", "class") or any(map(uses_fold, node.kids))


def folded_query(query):
    kind, value = query
    return (kind, "".join(map(literals.fold, value))) if kind == "lit" else (kind, [folded_query(p) for p in value])


def requirement(q: Query, text: bool = True):
    """(literal query or None, whether it speaks of folded text).  Raw bytes (encoding none) aren't narrowed unless the corpus is text."""
    c = q.compiled()
    if q.invert or c.native_dialect or q.encoding not in ("auto", "none") or q.encoding == "none" and not text:
        return None, False
    query = literals.required(c.tree)
    fold = uses_fold(c.tree)
    return (folded_query(query) if fold and query else query), fold


def _sees_ends(n) -> bool:
    return n.kind == "assert" and n.value in ("text_start", "text_end") or any(map(_sees_ends, n.kids))


def prefiltered(corpus: Corpus, q: Query) -> DataFrame:
    """Files that hold the literals which any match needs; ``contains`` reaches the Parquet scan.

    Without such literals a whole text is tested before it is split: a line's match is one of the text too,
    since line ends and word edges are the same there."""
    query, fold = requirement(q)
    if query is not None:
        return corpus.df.where(_query_column(F.col("content"), query, fold))
    c = q.compiled()
    if not corpus.text or q.invert or c.native_dialect or c.can_be_empty or is_risky(q) or q.null_data or q.crlf or q.multiline or _sees_ends(c.tree):
        return corpus.df
    return corpus.df.where(F.col("content").rlike(c.java))


def _searchable(df: DataFrame, q: Query) -> DataFrame:
    """Binary policy on text: the part before the first line that holds NUL, unless NULs are kept."""
    if q.binary is BinaryMode.TEXT:
        return df
    content = F.col("content")
    nul = F.locate("\0", content)
    before = F.substring(content, F.lit(1), nul - 1)
    cut = F.when((nul > 0) & ~F.col("explicit") & F.lit(q.binary is BinaryMode.QUIT), F.regexp_replace(before, r"[^\n]*\z", "")).when(nul > 0, F.translate(content, "\0", "\n")).otherwise(content)
    return df.withColumn("content", cut)


def lines(df: DataFrame, keep: list[str] = ["file_id", "path"]) -> DataFrame:  # noqa: B006
    """keep, line_number (from 1), line; no empty line after a last terminator; an empty file has none."""
    split = df.select(*keep, F.split("content", "\n", -1).alias("all"))
    out = split.select(*keep, F.size("all").alias("n"), F.posexplode("all").alias("at", "line"))
    return out.where(~((F.col("at") == F.col("n") - 1) & (F.col("line") == ""))).select(*keep, (F.col("at") + 1).cast("long").alias("line_number"), "line")


def offsets(df: DataFrame) -> DataFrame:
    """Lines of files with the byte offset of each."""
    w = Window.partitionBy("file_id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)).cast("long"))


def limited(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    w = Window.partitionBy("file_id").orderBy("line_number")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def _body(content: str = "content") -> Column:
    """The lines of a text as an array."""
    every = F.split(content, "\n", -1)
    return F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def grep(corpus: Corpus, q: Query, with_offsets: bool = False) -> DataFrame:
    """file_id, path, line_number, line (and byte_offset) of matching lines.

    A limit is taken within the row, so that nothing is shuffled; offsets need a window over a file's lines."""
    df = _searchable(prefiltered(corpus, q), q)
    if q.max_count and not with_offsets and not is_risky(q):
        numbered = F.transform(_body(), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line")))
        return df.select("file_id", "path", F.inline(F.slice(F.filter(numbered, lambda s: hit(s["line"], q)), 1, q.max_count)))
    df = lines(df)
    if with_offsets:
        df = offsets(df)
    return limited(df.where(hit(F.col("line"), q)), q.max_count)


def _hit_lines(q: Query) -> Column:
    n = F.coalesce(F.size(F.filter(_body(), lambda x: hit(x, q))), F.lit(0))
    return F.least(n, F.lit(q.max_count)) if q.max_count else n


def count_lines(corpus: Corpus, q: Query, include_zero: bool = False) -> DataFrame:
    """file_id, hits of matching lines, counted within each row: no explode, no shuffle.

    A file that the literals rule out counts 0 without being split."""
    if is_risky(q):
        found = grep(corpus, q).groupBy("file_id").agg(F.count("*").alias("hits"))
        return corpus.df.select("file_id").join(found, "file_id", "left").select("file_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits")) if include_zero else found
    df = _searchable(corpus.df if include_zero else prefiltered(corpus, q), q)
    out = df.select("file_id", _hit_lines(q).cast("long").alias("hits"))
    return out if include_zero else out.where("hits > 0")


def count_matches(corpus: Corpus, q: Query, include_zero: bool = False) -> DataFrame:
    """file_id, hits: spans; the pattern must not match the empty string."""
    df = grep(corpus, q).groupBy("file_id").agg(F.sum(F.regexp_count("line", F.lit(q.compiled().java))).cast("long").alias("hits")).where("hits > 0")
    if include_zero:
        return corpus.df.select("file_id").join(df, "file_id", "left").select("file_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return df


def _has_hit(q: Query) -> Column:
    """Stops at a text's first matching line."""
    return F.coalesce(F.exists(_body(), lambda x: hit(x, q)), F.lit(False))


def files_with_matches(corpus: Corpus, q: Query) -> DataFrame:
    if is_risky(q):
        return count_lines(corpus, q).select("file_id")
    return _searchable(prefiltered(corpus, q), q).where(_has_hit(q)).select("file_id")


def files_without_match(corpus: Corpus, q: Query) -> DataFrame:
    """Needs every file: nothing is narrowed away."""
    if is_risky(q):
        return count_lines(corpus, q, include_zero=True).where("hits = 0").select("file_id")
    return _searchable(corpus.df, q).where(~_has_hit(q)).select("file_id")


def hit_paths(corpus: Corpus, q: Query) -> DataFrame:
    """The paths of files with hits, to enqueue them for an index."""
    return files_with_matches(corpus, q).join(corpus.df.select("file_id", "path"), "file_id").select("path").distinct()


def paths(corpus: Corpus) -> DataFrame:
    return corpus.df.select("file_id", "path")


def only_matching(corpus: Corpus, q: Query) -> DataFrame:
    """file_id, line_number, match_number, matched: a row for each span."""
    java = q.compiled().java
    found = grep(corpus, q).select("file_id", "line_number", F.posexplode(F.regexp_extract_all("line", F.lit(java), 0)).alias("at", "matched"))
    return found.select("file_id", "line_number", (F.col("at") + 1).cast("long").alias("match_number"), "matched")


def replaced(corpus: Corpus, q: Query) -> DataFrame:
    """file_id, line_number, line with each span replaced."""
    c = q.compiled()
    new = F.regexp_replace("line", F.lit(c.java), F.lit(template.to_java(q.replace or "", c.groups, c.names)))
    return grep(corpus, q).select("file_id", "line_number", new.alias("line"))


def columns(corpus: Corpus, q: Query) -> DataFrame:
    """file_id, line_number, column (1-based byte of the first span), line."""
    first = F.regexp_instr("line", F.lit(q.compiled().java))
    return grep(corpus, q).select("file_id", "line_number", (F.octet_length(F.substring("line", F.lit(1), first - 1)) + 1).cast("long").alias("column"), "line")


def context(corpus: Corpus, q: Query) -> DataFrame:
    """file_id, line_number, kind (match, before, after, other), breaks, line.

    A line within ``after`` lines of an accepted hit above is after, within ``before`` of one
    below is before; hits beyond the limit count as context only.  breaks: a gap stands before
    the line.  With passthru every other line is ``other``."""
    df = lines(_searchable(corpus.df if q.passthru else prefiltered(corpus, q), q)).withColumn("is_hit", hit(F.col("line"), q))
    w = Window.partitionBy("file_id").orderBy("line_number")
    if q.max_count:
        df = df.withColumn("is_hit", F.col("is_hit") & (F.sum(F.col("is_hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= q.max_count))
    if q.passthru:
        return df.select("file_id", "line_number", F.when(F.col("is_hit"), "match").otherwise("other").alias("kind"), F.lit(False).alias("breaks"), "line")
    near = lambda a, b: F.coalesce(F.max(F.col("is_hit").cast("int")).over(w.rowsBetween(a, b)), F.lit(0)) == 1
    kind = F.when(F.col("is_hit"), "match").when(near(-q.after, 0) if q.after else F.lit(False), "after").when(near(0, q.before) if q.before else F.lit(False), "before")
    df = df.withColumn("kind", kind).where("kind is not null")
    gap = (F.col("line_number") - F.lag("line_number").over(w)) > 1
    return df.select("file_id", "line_number", "kind", F.coalesce(gap, F.lit(False)).alias("breaks"), "line")


def stats(corpus: Corpus, q: Query) -> DataFrame:
    """One row: matches, files_with_matches, files_searched, bytes_searched."""
    raw = F.coalesce(F.octet_length("content"), F.lit(0))
    if is_risky(q):
        df = corpus.df.select("file_id", raw.alias("raw")).join(count_lines(corpus, q), "file_id", "left").select(F.coalesce("hits", F.lit(0)).alias("n"), "raw")
    else:
        df = _searchable(corpus.df.withColumn("raw", raw), q).select(_hit_lines(q).alias("n"), "raw")
    return df.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("files_with_matches"), F.count("*").alias("files_searched"), F.coalesce(F.sum("raw"), F.lit(0)).cast("long").alias("bytes_searched")
    )


def found(corpus: Corpus, q: Query) -> bool:
    """Quiet mode: stops at the first file with a hit."""
    return bool(files_with_matches(corpus, q).limit(1).count())
