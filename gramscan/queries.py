"""Search queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import Regex, matching
from .operators import exact, index, render
from .operators import search as S
from .options import Case, Engine, Query
from .plans import planner
from .sources.corpus import Corpus
from .sources.filters import Filter, ordered, scoped

Q = Query.of


def _documents(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def _pages(spark: SparkSession, sf_dir: str) -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("path", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", ""))
    return Corpus.from_table(df, "page_id", "html", "path")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("file_id").alias("doc_id"), "line_number", "line")


def _grep(q: Query):
    return lambda spark, d: _lines(S.grep(_documents(spark, d), q))


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("file_id").alias("doc_id"))


def _hits(df: DataFrame) -> DataFrame:
    return df.select(F.col("file_id").alias("doc_id"), "hits")


LITERAL, WORD, ALTERNATION = "idiot", "the", ("license", "copyright", "rights reserved")
REQUIRED = r"[a-z]+ (?:MIT|Apache) License"
DIGITS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


_stores: dict[tuple, index.Store] = {}


def _store(spark: SparkSession, d: str, name: str, make) -> index.Store:
    """A store in the folder that all executors share, made once a session for a folder of tables."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stores:
        folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="gramscan-")
        store = index.Store(spark, f"{folder.rstrip('/')}/store-{name}-{uuid.uuid4().hex}")
        make(store)
        _stores[key] = store
    return _stores[key]


def _whole(spark: SparkSession, d: str) -> index.Store:
    return _store(spark, d, "whole", lambda s: s.build(_documents(spark, d)))


def _planned(spark: SparkSession, d: str, q: Query) -> planner.Plan:
    return planner.plan(_documents(spark, d), q, _whole(spark, d))


def narrowed_search(spark: SparkSession, d: str) -> DataFrame:
    q = Q(REQUIRED)
    return _lines(S.grep(_planned(spark, d, q).narrowed(), q))


def narrowed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _ids(_planned(spark, d, Q(LITERAL)).candidates)


def narrowed_ignore_case(spark: SparkSession, d: str) -> DataFrame:
    q = Q(LITERAL, case=Case.INSENSITIVE)
    return _lines(S.grep(_planned(spark, d, q).narrowed(), q))


def narrowed_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by grams that are taken on the fly, without a store."""
    return _ids(planner.narrow_in_place(_documents(spark, d), Q(LITERAL)))


def store_files(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d).files().select(F.col("file_id").alias("doc_id"), "path", "size")


def store_update(spark: SparkSession, d: str) -> DataFrame:
    """A store that was built on half of the rows and then updated."""

    def make(store: index.Store) -> None:
        corpus = _documents(spark, d)
        store.build(Corpus(corpus.df.where("file_id % 2 = 0")))
        store.update(corpus)

    q = Q(LITERAL)
    return _lines(S.grep(planner.plan(_documents(spark, d), q, _store(spark, d, "updated", make)).narrowed(), q))


def store_stale(spark: SparkSession, d: str) -> DataFrame:
    """A store of texts that were edited since: edited and unknown files are candidates."""
    old = F.when(F.col("file_id") % 3 == 0, F.lit("nothing yet")).otherwise(F.col("content"))
    store = _store(spark, d, "stale", lambda s: s.build(Corpus(_documents(spark, d).df.where("file_id % 5 > 0").withColumn("content", old))))
    q = Q(LITERAL)
    return _lines(S.grep(planner.plan(_documents(spark, d), q, store, fresh=False).narrowed(), q))


def store_complete_mode(spark: SparkSession, d: str) -> DataFrame:
    """A mode that needs every file takes them from the store and narrows nothing."""
    corpus, q = _documents(spark, d), Q(LITERAL)
    plan = planner.plan(corpus, q, _whole(spark, d), mode="files_without_match")
    return _ids(S.files_without_match(plan.narrowed(), q))


def encoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Every other text as UTF-16 bytes with a mark, found through the index and the exact tier."""
    df = _documents(spark, d).df
    data = F.when(F.col("file_id") % 2 == 0, F.encode("content", "UTF-16")).otherwise(F.encode("content", "UTF-8"))
    corpus, q = Corpus(df.withColumn("content", data), text=False), Q(LITERAL)
    store = _store(spark, d, "encoded", lambda s: s.build(corpus))
    return _lines(exact.scan(planner.plan(corpus, q, store).narrowed(), q).where("kind = 'match'"))


def risky_repetition(spark: SparkSession, d: str) -> DataFrame:
    """A repeated group, which Java's engine would search with a stack frame for each turn."""
    return _lines(S.grep(_documents(spark, d), Q(r"(?:an|er|th)+ing[ ,.]")))


def count_records(spark: SparkSession, d: str) -> DataFrame:
    corpus = _documents(spark, d)
    hits = S.count_lines(corpus, Q("the")).join(corpus.df.select("file_id", "path"), "file_id")
    return render.counts(hits).select(F.col("file_id").alias("doc_id"), "rendered")


def path_records(spark: SparkSession, d: str) -> DataFrame:
    corpus = _documents(spark, d)
    hits = S.files_with_matches(corpus, Q(LITERAL)).join(corpus.df.select("file_id", "path"), "file_id")
    return render.path_records(hits, root="/corpus").select(F.col("file_id").alias("doc_id"), "rendered")


def stats_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.stats_text(S.stats(_documents(spark, d), Q("the"))).select(F.col("line").cast("long").alias("line"), "rendered")


def hit_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.hit_paths(_documents(spark, d), Q(LITERAL))


def pattern_files(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of an option and of a pattern file with a comment and blank lines."""
    q = Query.from_sources([LITERAL], ["# words\n\n  copyright \nlicen[sc]e\n"], "ignored")
    return _lines(S.grep(_documents(spark, d), q))


def size_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = Filter(max_size=2048, types=[("html", True)])
    df = _pages(spark, d).df
    return df.where(rules.column(F.col("path"), size=F.octet_length("content"))).select(F.col("file_id").alias("page_id"), "path")


def line_anchors_crlf(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in CR LF: the pattern's end stands before the CR."""
    df = _documents(spark, d).df.withColumn("content", F.regexp_replace("content", "\n", "\r\n"))
    found = exact.scan(Corpus(df), Q(r"idiot[a-z .,]*$", crlf=True)).where("kind = 'match'")
    return found.select(F.col("file_id").alias("doc_id"), "line_number", F.rtrim("line", F.lit("\r")).alias("line"))


def multiline_events(spark: SparkSession, d: str) -> DataFrame:
    """Every line that a match across lines touches."""
    q = Q(r"\.\n[A-Z][a-z]+ the", multiline=True)
    return exact.scan(_documents(spark, d), q).where("kind = 'match'").select(F.col("file_id").alias("doc_id"), "line_number")


def gram_index(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_documents(spark, d), index.IndexRecord()).select(F.col("file_id").alias("doc_id"), "gram")


def gram_df(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_documents(spark, d), index.IndexRecord(norm="ascii-lower")).groupBy("gram").agg(F.count("*").alias("df"))


def lazy_merge(spark: SparkSession, d: str) -> DataFrame:
    """A lazy index that holds the even ids; the others come from the walk that is merged in."""
    meta = index.Meta(coverage="lazy")
    store = _store(spark, d, "lazy", lambda s: s.build(Corpus(_documents(spark, d).df.where("file_id % 2 = 0")), meta))
    q = Q(LITERAL)
    return _lines(S.grep(planner.plan(_documents(spark, d), q, store).narrowed(), q))


def byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    return S.grep(_documents(spark, d), Q(LITERAL), with_offsets=True).select(F.col("file_id").alias("doc_id"), "line_number", "byte_offset", "line")


def match_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.columns(_documents(spark, d), Q(LITERAL)).select(F.col("file_id").alias("doc_id"), "line_number", F.col("column").alias("col"), "line")


def context_before_after(spark: SparkSession, d: str) -> DataFrame:
    return S.context(_documents(spark, d), Q(LITERAL, before=1, after=2)).select(F.col("file_id").alias("doc_id"), "line_number", "kind", "breaks", "line")


def passthru(spark: SparkSession, d: str) -> DataFrame:
    return S.context(_documents(spark, d), Q(WORD, word=True, unicode=False, passthru=True)).select(F.col("file_id").alias("doc_id"), "line_number", "kind", "line")


def only_matching(spark: SparkSession, d: str) -> DataFrame:
    return S.only_matching(_documents(spark, d), Q(DIGITS)).select(F.col("file_id").alias("doc_id"), "line_number", "match_number", "matched")


def replace_captures(spark: SparkSession, d: str) -> DataFrame:
    return _lines(S.replaced(_documents(spark, d), Q(r"(?P<user>[a-z]+)\.([0-9]+)@", replace="<${2}_$user>@")))


def type_glob_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = Filter(globs=["*example.com/**", "!**/fr/*"])
    df = _pages(spark, d).df
    return df.where(rules.column(F.col("path"))).select(F.col("file_id").alias("page_id"), "path")


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _pages(spark, d).df.withColumn("path", F.concat(F.element_at(F.split("path", "/"), 2), F.lit("/"), F.col("path")))
    return scoped(df, ["en"]).select(F.col("file_id").alias("page_id"), "path")


def sort_path(spark: SparkSession, d: str) -> DataFrame:
    return ordered(_pages(spark, d).df, descending=True).select(F.col("file_id").alias("page_id"), "path")


def conversation_grep(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/conversations.parquet").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return S.grep(Corpus.from_table(df, "key", "text"), Q("the", word=True, unicode=False)).select(F.col("file_id").alias("turn_key"), "line_number", "line")


def events_json_grep(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet")
    return S.grep(Corpus.from_table(df, "event_id", "props"), Q(r"[0-9]{2}")).select(F.col("file_id").alias("event_id"), "line")


def multiline_spans(spark: SparkSession, d: str) -> DataFrame:
    q = Q(r"\.\n[A-Z][a-z]+ the", multiline=True)
    return _hits(exact.count_spans(_documents(spark, d), q))


def exact_lines(spark: SparkSession, d: str) -> DataFrame:
    """The exact tier on a query that the native tier also answers."""
    return exact.scan(_documents(spark, d), Q(LITERAL)).where("kind = 'match'").select(F.col("file_id").alias("doc_id"), "line_number", "byte_offset", "line")


def rendered_text(spark: SparkSession, d: str) -> DataFrame:
    return render.text(exact.scan(_documents(spark, d), Q(LITERAL)), offset=True).select(F.col("file_id").alias("doc_id"), "rendered")


def rendered_json(spark: SparkSession, d: str) -> DataFrame:
    return render.json_lines(exact.scan(_documents(spark, d), Q(LITERAL))).select(F.col("file_id").alias("doc_id"), "seq", "rendered")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").where("text is not null")


def regex_find(spark: SparkSession, d: str) -> DataFrame:
    found = _texts(spark, d).select("doc_id", Regex(REQUIRED).find(F.col("text")).alias("m")).where("m is not null")
    return found.select("doc_id", F.col("m.start").cast("long").alias("first_byte"), F.col("m.text").alias("matched"))


def regex_find_iter(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(Regex(DIGITS).find_iter(F.col("text"))).alias("at", "matched")).select("doc_id", F.col("at").cast("long").alias("at"), "matched")


def regex_captures(spark: SparkSession, d: str) -> DataFrame:
    groups = _texts(spark, d).select("doc_id", F.explode(Regex(r"(?P<user>[a-z]+)\.([0-9]+)@").captures_iter(F.col("text"))).alias("g"))
    return groups.select("doc_id", F.col("g")[0].alias("whole"), F.col("g")[1].alias("name"), F.col("g")[2].alias("number"))


def regex_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = Regex("[.!?]+[ \\n]+", unicode=False).split(F.col("text"))
    return _texts(spark, d).select("doc_id", F.size(pieces).cast("long").alias("n_pieces"), pieces[0].alias("first_piece"), F.array_join(pieces, "|").alias("pieces"))


def regex_replacen(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where(F.col("text").contains(LITERAL)).select("doc_id", Regex(f"{LITERAL}(s?)").replace(F.col("text"), "<$1>", 2).alias("replaced"))


def regex_set(spark: SparkSession, d: str) -> DataFrame:
    which = _texts(spark, d).select("doc_id", matching(F.col("text"), "licen[sc]e", "copyright", LITERAL).alias("which")).where(F.size("which") > 0)
    return which.select("doc_id", F.array_join(F.col("which").cast("array<string>"), ",").alias("patterns"))


def vimgrep(spark: SparkSession, d: str) -> DataFrame:
    """Lines with number and column, cut after 40 bytes with a note."""
    events = exact.scan(_documents(spark, d), Q(REQUIRED)).where("kind = 'match'")
    return render.text(events, column=True, max_columns=40).select(F.col("file_id").alias("doc_id"), "rendered")


def index_kinds_intersected(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that trigrams and 5-grams both admit."""
    meta = index.Meta(kinds=["trigram", "ngram-5"])
    store = _store(spark, d, "kinds", lambda s: s.build(_documents(spark, d), meta))
    return _ids(planner.plan(_documents(spark, d), Q(LITERAL), store).candidates)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    doc = _documents
    return {
        "grep_literal": _grep(Q("the")),
        "grep_fixed": _grep(Q("2.0.", fixed=True)),
        "grep_ignore_case": _grep(Q(LITERAL, case=Case.INSENSITIVE)),
        "grep_smart_case": _grep(Q("apache license", case=Case.SMART)),
        "grep_word": _grep(Q(WORD, word=True, unicode=False)),
        "grep_line_regexp": _grep(Q(r"[A-Z][a-z]+\.", line=True)),
        "grep_multi_pattern": _grep(Q(*ALTERNATION)),
        "grep_alternation_ignore_case": _grep(Q(*ALTERNATION, case=Case.INSENSITIVE)),
        "grep_regex_required_literal": _grep(Q(REQUIRED)),
        "grep_no_literal": _grep(Q(DIGITS)),
        "grep_pcre2_lookbehind": _grep(Q(r"(?<=the )idiot", engine=Engine.PCRE2)),
        "grep_auto_engine": _grep(Q(r"(?<=the )idiot", engine=Engine.AUTO)),
        "grep_unicode_class": _grep(Q(r"\p{Lu}ß|ß\p{Lu}|\p{Greek}|[[:upper:]--[A-Y]]")),
        "grep_invert": _grep(Q("e", invert=True)),
        "grep_max_count": _grep(Q("the", max_count=2)),
        "count_lines": lambda s, d: _hits(S.count_lines(doc(s, d), Q("the"))),
        "count_matches": lambda s, d: _hits(S.count_matches(doc(s, d), Q("the"))),
        "count_include_zero": lambda s, d: _hits(S.count_lines(doc(s, d), Q(LITERAL), include_zero=True)),
        "count_matches_include_zero": lambda s, d: _hits(S.count_matches(doc(s, d), Q(LITERAL), include_zero=True)),
        "files_with_matches": lambda s, d: _ids(S.files_with_matches(doc(s, d), Q(LITERAL))),
        "files_without_match": lambda s, d: _ids(S.files_without_match(doc(s, d), Q("the"))),
        "paths_listing": lambda s, d: S.paths(doc(s, d)).select(F.col("file_id").alias("doc_id"), "path"),
        "search_stats": lambda s, d: S.stats(doc(s, d), Q("the")),
        **{f.__name__: f for f in (only_matching, replace_captures, byte_offsets, match_columns, context_before_after, passthru, gram_index, gram_df, narrowed_candidates, narrowed_search, narrowed_ignore_case, lazy_merge, type_glob_filter, scope_filter, sort_path, conversation_grep, events_json_grep, multiline_spans, exact_lines, rendered_text, rendered_json, regex_find, regex_find_iter, regex_captures, regex_split, regex_replacen, regex_set, vimgrep, index_kinds_intersected, narrowed_in_place, store_files, store_update, store_stale, store_complete_mode, encoded_files, risky_repetition, count_records, path_records, stats_lines, hit_paths, pattern_files, size_filter, line_anchors_crlf, multiline_events)},
    }


_L = """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, unnest(a) AS line, unnest(generate_series(1, len(a))) AS k, len(a) AS n FROM p),
l AS (SELECT doc_id, CAST(k AS BIGINT) AS line_number, line FROM q WHERE NOT (k = n AND line = '')) """


def _where(rule: str) -> str:
    return f"{_L} SELECT doc_id, line_number, line FROM l WHERE {rule}"


_THE = "regexp_matches(line, '(^|[^0-9A-Za-z_])the([^0-9A-Za-z_]|$)')"


def oracle_sql() -> dict[str, str]:
    alternation = "license|copyright|rights reserved"
    gram = """WITH RECURSIVE b AS (SELECT doc_id, {text} AS h, octet_length({raw}) AS n FROM documents),
    w AS (SELECT doc_id, h, unnest(generate_series(1, n - 2)) AS k FROM b WHERE n >= 3)
    SELECT DISTINCT doc_id, CAST(('0x' || substr(h, CAST(2 * k - 1 AS INTEGER), 6)) AS BIGINT) AS gram FROM w"""
    identity = gram.format(text="hex(encode(text))", raw="encode(text)")
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(8490) || chr(383), 'abcdefghijklmnopqrstuvwxyzks')"
    lower = gram.format(text=f"hex(encode({fold}))", raw=f"encode({fold})")
    pages = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"
    context = f"""{_L}, h AS (SELECT *, contains(line, '{LITERAL}') AS hit FROM l),
    c AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS above, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS below FROM h),
    k AS (SELECT doc_id, line_number, CASE WHEN hit THEN 'match' WHEN above = 1 THEN 'after' WHEN below = 1 THEN 'before' END AS kind, line FROM c)
    SELECT doc_id, line_number, kind, coalesce(line_number - lag(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) > 1, false) AS breaks, line FROM k WHERE kind IS NOT NULL"""
    literal = _where(f"contains(line, '{LITERAL}')")
    grams = " AND ".join(f"contains(text, '{LITERAL[k : k + 3]}')" for k in range(len(LITERAL) - 2))
    grams = f"SELECT doc_id FROM documents WHERE {grams} OR text IS NULL OR strlen(text) < 3"
    said = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    path = f"'{{\"path\":{{\"text\":' || {said('CAST(doc_id AS VARCHAR)')} || '}}'"
    json = f"""{_L}, o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1 AS BIGINT) AS byte_offset FROM l),
    m AS (SELECT *, string_split(line, '{LITERAL}') AS p, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS k FROM o WHERE contains(line, '{LITERAL}')),
    s AS (SELECT *, list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) AS BIGINT) + 5 * (i - 1)) AS spots FROM m),
    f AS (SELECT doc_id, max(k) AS last, count(*) AS matched_lines, CAST(sum(len(spots)) AS BIGINT) AS matches FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(k AS BIGINT) AS seq, '{{"type":"match","data":' || {path} || ',"lines":{{"text":' || {said('line || chr(10)')} || '}},"line_number":' || line_number || ',"absolute_offset":' || byte_offset || ',"submatches":[' ||
      array_to_string(list_transform(spots, lambda x: '{{"match":{{"text":"{LITERAL}"}},"start":' || x || ',"end":' || (x + 5) || '}}'), ',') || ']}}}}' AS rendered FROM s
    UNION ALL SELECT doc_id, 0, '{{"type":"begin","data":' || {path} || '}}}}' FROM f
    UNION ALL SELECT doc_id, CAST(last + 1 AS BIGINT), '{{"type":"end","data":' || {path} || ',"stats":{{"matched_lines":' || matched_lines || ',"matches":' || matches || '}}}}}}' FROM f
    UNION ALL SELECT NULL, 0, '{{"type":"summary","data":{{"stats":{{"searches_with_match":' || count(*) || ',"matched_lines":' || coalesce(sum(matched_lines), 0) || ',"matches":' || coalesce(sum(matches), 0) || '}}}}}}' FROM f"""
    return {
        "rendered_json": json,
        "narrowed_in_place": grams,
        "store_files": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size FROM documents",
        "store_update": literal,
        "store_stale": literal,
        "encoded_files": literal,
        "store_complete_mode": f"SELECT doc_id FROM documents WHERE text IS NULL OR NOT contains(text, '{LITERAL}')",
        "risky_repetition": _where("regexp_matches(line, '(an|er|th)+ing[ ,.]')"),
        "count_records": f"{_L} SELECT doc_id, doc_id || ':' || count(*) AS rendered FROM l WHERE contains(line, 'the') GROUP BY doc_id",
        "path_records": f"SELECT doc_id, '/corpus/' || doc_id AS rendered FROM documents WHERE contains(text, '{LITERAL}')",
        "stats_lines": f"{_L}, c AS (SELECT doc_id, count(*) AS n FROM l WHERE contains(line, 'the') GROUP BY doc_id) SELECT CAST(0 AS BIGINT) AS line, coalesce(sum(n), 0) || ' matches' AS rendered FROM c UNION ALL SELECT 1, count(*) || ' files contained matches' FROM c UNION ALL SELECT 2, count(*) || ' files searched' FROM documents UNION ALL SELECT 3, sum(coalesce(strlen(text), 0)) || ' bytes searched' FROM documents",
        "hit_paths": f"SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE contains(text, '{LITERAL}')",
        "pattern_files": _where(f"regexp_matches(line, '{LITERAL}|copyright|licen[sc]e')"),
        "size_filter": f"SELECT p.page_id, path FROM ({pages}) p JOIN pages USING (page_id) WHERE regexp_matches(path, '[.]html?$') AND coalesce(strlen(html), 0) <= 2048 AND NOT regexp_matches(path, '(^|/)[.][^/]')",
        "line_anchors_crlf": _where("regexp_matches(line, 'idiot[a-z .,]*$')"),
        "multiline_events": f"{_L}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_number) AS below, lag(line) OVER (PARTITION BY doc_id ORDER BY line_number) AS above FROM l) SELECT doc_id, line_number FROM n WHERE (line LIKE '%.' AND regexp_matches(below, '^[A-Z][a-z]+ the')) OR (above LIKE '%.' AND regexp_matches(line, '^[A-Z][a-z]+ the'))",
        "grep_literal": _where("contains(line, 'the')"),
        "grep_fixed": _where("contains(line, '2.0.')"),
        "grep_ignore_case": _where(f"regexp_matches(line, '{LITERAL}', 'i')"),
        "grep_smart_case": _where("regexp_matches(line, 'apache license', 'i')"),
        "grep_word": _where(_THE),
        "grep_line_regexp": _where(r"regexp_full_match(line, '[A-Z][a-z]+\.')"),
        "grep_multi_pattern": _where(f"regexp_matches(line, '{alternation}')"),
        "grep_alternation_ignore_case": _where(f"regexp_matches(line, '{alternation}', 'i')"),
        "grep_regex_required_literal": _where(f"regexp_matches(line, '{REQUIRED}')"),
        "grep_no_literal": _where(f"regexp_matches(line, '{DIGITS}')"),
        "grep_pcre2_lookbehind": _where("contains(line, 'the idiot')"),
        "grep_auto_engine": _where("contains(line, 'the idiot')"),
        "grep_unicode_class": _where(r"regexp_matches(line, '\p{Lu}ß|ß\p{Lu}|\p{Greek}|Z')"),
        "grep_invert": _where("NOT contains(line, 'e')"),
        "grep_max_count": f"{_L} SELECT doc_id, line_number, line FROM l WHERE contains(line, 'the') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_number) <= 2",
        "count_lines": f"{_L} SELECT doc_id, count(*) AS hits FROM l WHERE contains(line, 'the') GROUP BY doc_id",
        "count_matches": f"{_L} SELECT doc_id, CAST(sum(len(regexp_extract_all(line, 'the'))) AS BIGINT) AS hits FROM l WHERE contains(line, 'the') GROUP BY doc_id",
        "count_include_zero": f"{_L}, c AS (SELECT doc_id, count(*) AS hits FROM l WHERE contains(line, '{LITERAL}') GROUP BY doc_id) SELECT doc_id, coalesce(hits, 0) AS hits FROM documents LEFT JOIN c USING (doc_id)",
        "count_matches_include_zero": f"{_L}, c AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '{LITERAL}'))) AS BIGINT) AS hits FROM l GROUP BY doc_id) SELECT doc_id, coalesce(hits, 0) AS hits FROM documents LEFT JOIN c USING (doc_id)",
        "files_with_matches": f"SELECT doc_id FROM documents WHERE contains(text, '{LITERAL}')",
        "files_without_match": "SELECT doc_id FROM documents WHERE text IS NULL OR NOT contains(text, 'the')",
        "paths_listing": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS path FROM documents",
        "search_stats": f"{_L}, c AS (SELECT doc_id, count(*) AS n FROM l WHERE contains(line, 'the') GROUP BY doc_id) SELECT CAST((SELECT sum(n) FROM c) AS BIGINT) AS matches, (SELECT count(*) FROM c) AS files_with_matches, count(*) AS files_searched, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes_searched FROM documents",
        "only_matching": f"{_L}, m AS (SELECT doc_id, line_number, regexp_extract_all(line, '{DIGITS}') AS a FROM l) SELECT doc_id, line_number, CAST(unnest(generate_series(1, len(a))) AS BIGINT) AS match_number, unnest(a) AS matched FROM m WHERE len(a) > 0",
        "replace_captures": _L + r" SELECT doc_id, line_number, regexp_replace(line, '([a-z]+)\.([0-9]+)@', '<\2_\1>@', 'g') AS line FROM l WHERE regexp_matches(line, '([a-z]+)\.([0-9]+)@')",
        "byte_offsets": f"{_L}, o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1 AS BIGINT) AS byte_offset FROM l) SELECT doc_id, line_number, byte_offset, line FROM o WHERE contains(line, '{LITERAL}')",
        "match_columns": f"{_L} SELECT doc_id, line_number, CAST(strlen(substr(line, 1, strpos(line, '{LITERAL}') - 1)) + 1 AS BIGINT) AS col, line FROM l WHERE contains(line, '{LITERAL}')",
        "context_before_after": context,
        "passthru": f"{_L} SELECT doc_id, line_number, CASE WHEN {_THE} THEN 'match' ELSE 'other' END AS kind, line FROM l",
        "gram_index": identity,
        "gram_df": f"SELECT gram, count(*) AS df FROM ({lower}) GROUP BY gram",
        "narrowed_candidates": grams,
        "narrowed_search": _where(f"regexp_matches(line, '{REQUIRED}')"),
        "narrowed_ignore_case": _where(f"regexp_matches(line, '{LITERAL}', 'i')"),
        "lazy_merge": _where(f"contains(line, '{LITERAL}')"),
        "type_glob_filter": f"SELECT page_id, path FROM ({pages}) WHERE regexp_matches(path, '^[^/]*example[.]com/.+$') AND NOT regexp_matches(path, '(^|/)fr/[^/]+(/.*)?$') AND NOT regexp_matches(path, '(^|/)[.][^/]')",
        "scope_filter": f"SELECT page_id, split_part(path, '/', 2) || '/' || path AS path FROM ({pages}) WHERE split_part(path, '/', 2) = 'en'",
        "sort_path": pages,
        "conversation_grep": f"WITH p AS (SELECT conv_id * 1000 + turn AS turn_key, string_split(text, chr(10)) AS a FROM conversations), q AS (SELECT turn_key, unnest(a) AS line, unnest(generate_series(1, len(a))) AS k, len(a) AS n FROM p) SELECT turn_key, CAST(k AS BIGINT) AS line_number, line FROM q WHERE NOT (k = n AND line = '') AND {_THE}",
        "events_json_grep": "SELECT event_id, props AS line FROM events WHERE regexp_matches(props, '[0-9]{2}')",
        "multiline_spans": r"SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\.\n[A-Z][a-z]+ the')) AS BIGINT) AS hits FROM documents) WHERE hits > 0",
        "regex_find": f"WITH m AS (SELECT doc_id, text, regexp_extract(text, '{REQUIRED}') AS matched FROM documents) SELECT doc_id, CAST(strlen(substr(text, 1, strpos(text, matched) - 1)) AS BIGINT) AS first_byte, matched FROM m WHERE matched <> ''",
        "regex_find_iter": f"WITH m AS (SELECT doc_id, regexp_extract_all(text, '{DIGITS}') AS a FROM documents) SELECT doc_id, CAST(unnest(generate_series(0, len(a) - 1)) AS BIGINT) AS at, unnest(a) AS matched FROM m WHERE len(a) > 0",
        "regex_captures": r"WITH p AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '([a-z]+)\.([0-9]+)@')) SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+)\.([0-9]+)@', 0)) AS whole, unnest(regexp_extract_all(text, '([a-z]+)\.([0-9]+)@', 1)) AS name, unnest(regexp_extract_all(text, '([a-z]+)\.([0-9]+)@', 2)) AS number FROM p",
        "regex_split": r"WITH p AS (SELECT doc_id, string_split_regex(text, '[.!?]+[ \n]+') AS a FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(a) AS n_pieces, a[1] AS first_piece, array_to_string(a, '|') AS pieces FROM p",
        "regex_replacen": f"SELECT doc_id, regexp_replace(regexp_replace(text, '{LITERAL}(s?)', '<\\1>'), '{LITERAL}(s?)', '<\\1>') AS replaced FROM documents WHERE contains(text, '{LITERAL}')",
        "regex_set": f"SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, 'licen[sc]e') THEN '0' END, CASE WHEN contains(text, 'copyright') THEN '1' END, CASE WHEN contains(text, '{LITERAL}') THEN '2' END) AS patterns FROM documents) WHERE patterns <> ''",
        "vimgrep": f"{_L} SELECT doc_id, doc_id || ':' || line_number || ':' || (strlen(substr(line, 1, strpos(line, regexp_extract(line, '{REQUIRED}')) - 1)) + 1) || ':' || CASE WHEN strlen(line) > 40 THEN '[Omitted long matching line]' ELSE line END AS rendered FROM l WHERE regexp_matches(line, '{REQUIRED}')",
        "index_kinds_intersected": f"SELECT doc_id FROM documents WHERE text IS NULL OR strlen(text) < 3 OR contains(text, '{LITERAL}')",
        "exact_lines": f"{_L}, o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1 AS BIGINT) AS byte_offset FROM l) SELECT doc_id, line_number, byte_offset, line FROM o WHERE contains(line, '{LITERAL}')",
        "rendered_text": f"{_L}, o AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1 AS BIGINT) AS byte_offset FROM l) SELECT doc_id, doc_id || ':' || line_number || ':' || byte_offset || ':' || line AS rendered FROM o WHERE contains(line, '{LITERAL}')",
    }
