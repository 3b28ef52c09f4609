import os

import pytest

from gramscan.operators import exact, index, render
from gramscan.operators import search as S
from gramscan.options import BinaryMode, Case, Query
from gramscan.plans import planner
from gramscan.plans.planner import Coverage, Discovery, discover
from gramscan.sources.corpus import Corpus, decode, decompress
from gramscan.sources.filters import Filter, glob_regex, parse_size, walk
from gramscan.streaming import live

Q = Query.of
TEXTS = ["alpha\nbeta match\ngamma\n", "", None, "a\n", "foobar\n", "zzz\n", "f", "ab", "Kelvin\n", "h\nx\nh\n", "one\n\nfoo bar\nfoo", "aab\n", "tail\nno newline idiot", "É\nabc -2 foo\n"]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_table(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"), "id", "text")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_context(corpus):
    got = rows(S.context(corpus, Q("match", before=1, after=1)), "line_number", "kind", "line")
    assert got == [(1, "before", "alpha"), (2, "match", "beta match"), (3, "after", "gamma")]
    assert not any(r["breaks"] for r in S.context(corpus, Q("h", line=True, before=1)).collect())


@pytest.mark.parametrize("q", [Q("a|foobar"), Q("fo*"), Q("(foo)?"), Q("ab"), Q("kelvin", case=Case.INSENSITIVE), Q("foo"), Q("id[io]+t"), Q("match"), Q("É")], ids=lambda q: q.patterns[0])
def test_indexed_equals_scan(spark, corpus, q, tmp_path_factory):
    store = index.Store(spark, f"file://{tmp_path_factory.getbasetemp()}/idx")
    if not store.current:
        store.build(corpus)
    plan = planner.plan(corpus, q, store)
    full = rows(S.lines(corpus.df).where(S.hit(S.F.col("line"), q)), "file_id", "line_number")
    assert rows(S.grep(plan.narrowed(), q), "file_id", "line_number") == full
    assert rows(S.grep(corpus, q), "file_id", "line_number") == full
    assert rows(exact.scan(corpus, q).where("kind = 'match'"), "file_id", "line_number") == full


def test_store_rules(spark, corpus, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/i")
    with pytest.raises(index.IndexError_):
        store.update(corpus)
    first = store.build(corpus)
    with pytest.raises(index.IndexError_):
        store.build(corpus)
    assert store.update(corpus) != first and store.meta.covers({}, [])
    assert index.IndexRecord.parse("ngram:5-ascii-lower").name == "ngram-5-ascii-lower"
    assert planner.plan(corpus, Q("foobar"), store).explain()["narrowed"]


def test_discovery_table():
    meta = index.Meta()
    assert discover("streams", Coverage.POTENTIAL, True, True, meta, True, True)[0] is Discovery.EMPTY
    assert discover("index", Coverage.COMPLETE, True, True, index.Meta(coverage="lazy"), True, True)[0] is Discovery.WALK
    assert discover("index", Coverage.POTENTIAL, True, True, index.Meta(coverage="lazy"), True, True)[0] is Discovery.MERGE
    assert discover("index", Coverage.POTENTIAL, True, False, meta, True, True)[0] is Discovery.WALK
    assert discover("index", Coverage.COMPLETE, True, True, meta, True, False)[0] is Discovery.WALK
    assert discover("index", Coverage.POTENTIAL, True, True, meta, True, False) == (Discovery.INDEX, "indexed")


def one(q, data, explicit=False):
    return exact.Scan(q).file(data, explicit)


def test_exact_tier():
    assert sum(len(r[4]) for r in one(Q("a*"), b"aab\n")[0]) == 2
    assert len(one(Q(r"\s"), b"a b\n")[0][0][4]) == 1
    lines, nul = one(Q("foo\nbar", multiline=True), b"foo\nbar\n")
    assert [r[1] for r in lines] == [1, 2] and sum(len(r[4]) for r in lines) == 1 and nul is None
    assert [r[3] for r in one(Q("foo\nbar", multiline=True, replace="X"), b"foo\nbar\n")[0]] == ["X"]
    assert one(Q("start.end", multiline=True, dotall=True), b"start\nend\n")[0]
    assert one(Q("world$", crlf=True), b"hello world\r\n")[0]
    assert one(Q("later"), b"findme\0later\n") == ([], 6)
    rows_, nul = one(Q("findme", binary=BinaryMode.BINARY), b"findme\nmore\0stuff\n")
    assert len(rows_) == 1 and nul == 11
    assert one(Q("findme", binary=BinaryMode.TEXT), b"\0findme\n")[0]
    assert [r[3] for r in one(Q("needle", null_data=True), b"alpha\0needle\0omega\0")[0]] == ["needle"]
    wide = b"\xff\xfe" + "alpha\nneedle\n".encode("utf-16-le")
    assert one(Q("needle"), wide)[0] and not one(Q("needle", encoding="none", binary=BinaryMode.TEXT), wide)[0]
    assert one(Q("needle", encoding="utf-16-le"), wide[2:])[0]
    limited = one(Q("needle", max_count=1, after=1), b"needle\nneedle\nneedle\n")[0]
    assert [r[0] for r in limited] == ["match", "after"]
    assert [r[0] for r in one(Q("needle", passthru=True), b"keep\nneedle\n")[0]] == ["other", "match"]


def test_files(spark, tmp_path):
    for name, text in {"a/x.txt": "needle\n", "b/y.log": "needle\n", ".hid/z.txt": "needle\n", "skip/s.txt": "needle\n", "keep.txt": "other\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("skip/\n")
    names = lambda **k: [f.path for f in walk(str(tmp_path), k.pop("scopes", []), Filter(ignore_parent=False, **k))]
    assert names() == ["a/x.txt", "b/y.log", "keep.txt"]
    assert names(globs=["*.txt", "!keep*"]) == ["a/x.txt"]
    assert names(types=[("txt", True)]) == ["a/x.txt", "keep.txt"]
    assert names(scopes=["skip/s.txt"]) == ["skip/s.txt"] and names(max_depth=0) == ["keep.txt"]
    assert ".hid/z.txt" in names(hidden=True) and "skip/s.txt" in [f.path for f in walk(str(tmp_path), [], Filter(ignore_parent=False).unrestricted(1))]
    corpus = Corpus.from_files(spark, str(tmp_path), rules=Filter(ignore_parent=False))
    events = exact.scan(corpus, Q("needle"))
    assert rows(render.text(events), "rendered") == [("a/x.txt:1:needle",), ("b/y.log:1:needle",)]
    assert [r["seq"] for r in render.json_lines(events).where("file_id = 0").orderBy("seq").collect()] == [0, 1, 2]


def test_small_helpers():
    import gzip
    import re

    assert decompress("x.gz", gzip.compress(b"hi")) == b"hi" and decompress("x.txt", b"hi") == b"hi"
    assert decode(b"\xef\xbb\xbfhi") == b"hi" and parse_size("2K") == 2048
    assert re.search(glob_regex("a/**/b"), "a/x/y/b") and re.search(glob_regex("/top"), "top/x") and not re.search(glob_regex("/top"), "a/top")


def test_streaming_equals_batch(spark, corpus, tmp_path):
    corpus.df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(corpus.df.schema).parquet(f"{tmp_path}/in")
    q = Q("foo")
    run = live.grep(stream, q).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert rows(spark.table("found"), "file_id", "line_number") == rows(S.grep(corpus, q), "file_id", "line_number")
    store = index.Store(spark, f"file://{tmp_path}/live")
    live.refresh(stream, store, lambda: corpus, f"{tmp_path}/cp", once=True).awaitTermination(120)
    assert store.current


def test_queries_match_duckdb(spark):
    import duckdb

    from gramscan import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    known, sql = queries.queries(), queries.oracle_sql()
    for name in ("grep_literal", "grep_word", "count_include_zero", "context_before_after", "narrowed_candidates", "type_glob_filter", "rendered_text", "search_stats", "replace_captures"):
        got = known[name](spark, d)
        want = c.sql(sql[name])
        columns = sorted(got.columns)
        assert sorted(map(str, rows(got, *columns))) == sorted(map(str, want.project(",".join(f'"{x}"' for x in columns)).fetchall())), name
