import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramscan.operators import exact, index, render
from gramscan.operators import search as S
from gramscan.options import BinaryMode, Case, Mode, Query, config_arguments
from gramscan.plans import planner
from gramscan.sources.corpus import Corpus
from gramscan.sources.filters import Filter, ordered
from gramscan.streaming import live

Q = Query.of
ENCODINGS = ["utf-8", "utf-8-sig", "utf-16", "utf-16-le-mark", "utf-16-be-mark", "latin-1"]


def encoded(text, how):
    if how.endswith("-mark"):
        return ("﻿" + text).encode(how.removesuffix("-mark"))
    return text.encode(how)


def ids(df):
    return sorted(r["file_id"] for r in df.select("file_id").distinct().collect())


def test_narrowing_is_sound_over_encodings(spark, tmp_path):
    texts = ["a needle here\n", "NEEDLE\n", "\u212aelvin needle", "no\n", "", "née dle\n", "ne\nedle"]
    rows = [(k * 10 + j, f"f{k}-{j}", bytearray(encoded(t, e)), False) for j, t in enumerate(texts) for k, e in enumerate(ENCODINGS) if e != "latin-1" or t.isascii() or "é" in t]
    corpus = Corpus(spark.createDataFrame(rows, "file_id long, path string, content binary, explicit boolean"), text=False)
    store = index.Store(spark, f"file://{tmp_path}/i")
    store.build(corpus)
    text = {BinaryMode.QUIT, BinaryMode.TEXT}
    for q in [Q("needle"), Q("needle", case=Case.INSENSITIVE), Q("kelvin", case=Case.INSENSITIVE), Q("née"), *(Q("needle", encoding="none", binary=b) for b in text), Q(r"n\x00e", encoding="none", binary=BinaryMode.TEXT), Q("needle", encoding="latin-1")]:
        full = ids(exact.scan(corpus, q).where("kind = 'match'"))
        plan = planner.plan(corpus, q, store)
        assert ids(exact.scan(plan.narrowed(), q).where("kind = 'match'")) == full, q
    assert ids(exact.scan(corpus, Q("needle")).where("kind = 'match'")) == sorted(r[0] for r in rows if "needle" in texts[r[0] % 10])
    assert planner.plan(corpus, Q("needle"), store).candidates is not None


def test_repetitions_on_long_lines(spark):
    corpus = Corpus.from_table(spark.createDataFrame([(1, "ab" * 40_000), (2, "ba\nx" + "abcd" * 20_000 + "x"), (3, None)], "id long, text string"), "id", "text")
    for pattern in ("(?:ab|cd)+x?", "((a)(b))+$", "(?:[a-d]{2})+", "[a-d]+", "(?:a|b|cd)*x$"):
        want = {"(?:ab|cd)+x?": [1, 2], "((a)(b))+$": [1], "(?:[a-d]{2})+": [1, 2], "[a-d]+": [1, 2], "(?:a|b|cd)*x$": [2]}[pattern]
        q = Q(pattern)
        assert ids(S.grep(corpus, q)) == want and ids(S.files_with_matches(corpus, q)) == want, pattern
        assert ids(S.files_without_match(corpus, q)) == sorted({1, 2, 3} - set(want))
        assert S.stats(corpus, q).first()["files_with_matches"] == len(want)
        assert ids(S.count_lines(corpus, q, include_zero=True).where("hits = 0")) == sorted({1, 2, 3} - set(want))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab\n ", max_size=12), min_size=1, max_size=6), st.sampled_from(["a", "^b", "a$", r"\bab\b", "a+b", "[^a]b", r"a\s"]), st.integers(1, 3))
def test_limits_and_prefilters_equal_the_plain_scan(spark, texts, pattern, most):
    corpus = Corpus.from_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    q, limited = Q(pattern), Q(pattern, max_count=most)
    lines = S.lines(corpus.df).where(S.hit(F.col("line"), q))
    want = sorted((r["file_id"], r["line_number"]) for r in lines.collect())
    key = lambda df: sorted((r["file_id"], r["line_number"]) for r in df.collect())
    assert key(S.grep(corpus, q)) == want
    assert key(S.grep(corpus, limited)) == [(f, n) for k, (f, n) in enumerate(want) if sum(x == f for x, _ in want[:k]) < most]


def test_modes_and_sources():
    r = Mode.resolve
    assert r([]) is Mode.LINES and r(["only-matching"]) is Mode.ONLY_MATCHING
    assert r(["count", "files-with-matches"]) is Mode.FILES_WITH_MATCHES and r(["files-with-matches", "count"]) is Mode.COUNT_LINES
    assert r(["only-matching"], invert=True) is Mode.COUNT_LINES and r(["count", "only-matching"]) is Mode.COUNT_MATCHES
    with pytest.raises(ValueError, match="unknown mode"):
        r(["bogus"])
    assert Query.from_sources(["a"], ["b\n # no\n\n c \n"], "d").patterns == ("a", "b", "c") and Query.from_sources(positional="d").patterns == ("d",)
    nothing = Query.from_sources(files=["#\n"])
    assert nothing.compiled().java
    with pytest.raises(ValueError, match="no pattern"):
        Query.from_sources()
    assert config_arguments("--smart-case\n# x\n-n\n", ["p"]) == ["--smart-case", "-n", "p"] and config_arguments("-n", ["--no-config"]) == ["--no-config"]
    assert render.shows_filename(1, False) is False and render.shows_filename(2, False) and render.shows_line_number(json=True) and not render.shows_line_number(asked=False, context=True)


def test_pattern_files_without_patterns_match_nothing(spark):
    corpus = Corpus.from_table(spark.createDataFrame([(1, "a\n\nb")], "id long, text string"), "id", "text")
    assert S.grep(corpus, Query.from_sources(files=["#\n"])).count() == 0


def test_binary_and_summary_records(spark):
    corpus = Corpus.from_bytes(spark, [("b", b"findme\nmore\0stuff\n"), ("t", b"findme findme\n"), ("n", b"none\n")])
    said = [r["rendered"] for r in render.json_lines(exact.scan(corpus, Q("findme", binary=BinaryMode.BINARY))).orderBy("file_id", "seq").collect()]
    assert [x.split('"')[3] for x in said] == ["summary", "begin", "match", "binary", "end", "begin", "match", "end"]
    assert '"offset":11' in said[3] and '"binary_offset":11' in said[4] and '"matches":3' in said[0] and '"searches_with_match":2' in said[0]
    line = spark.createDataFrame([("a findme b",)], "line string").select(render.coloured(F.col("line"), "findme", "<", ">").alias("x"))
    assert line.first()["x"] == "a <findme> b"


def test_listing_types_and_sizes(spark, tmp_path):
    import os

    for k, name in enumerate(["z.py", "a.rs", "m.kt"]):
        (tmp_path / name).write_text("x" * (k + 1) * 10)
        os.utime(tmp_path / name, (1000 - k, 2000 + k))
    names = lambda df: [r["path"] for r in df.collect()]
    files = Corpus.listing(spark, str(tmp_path))
    assert names(ordered(files, "modified")) == ["z.py", "a.rs", "m.kt"] and names(ordered(files, "accessed", descending=True)) == ["z.py", "a.rs", "m.kt"]
    assert names(ordered(files)) == ["a.rs", "m.kt", "z.py"]
    rules = Filter(max_size=20, types=[("kotlin", False)])
    assert sorted(names(files.where(rules.column(F.col("path"), size=F.col("size"))))) == ["a.rs", "z.py"]
    with pytest.raises(ValueError, match="size"):
        rules.column(F.col("path"))


def test_store_is_safe(spark, tmp_path, monkeypatch):
    corpus = Corpus.from_table(spark.createDataFrame([(1, "alpha"), (2, ""), (3, None)], "id long, text string"), "id", "text")
    store = index.Store(spark, f"file://{tmp_path}/i")
    first = store.build(corpus)
    held = store.files(first)
    store.fs.createNewFile(store._path(f"{store.folder}/LOCK"))
    with pytest.raises(index.IndexError_, match="another writer"):
        store.update(corpus)
    monkeypatch.setattr(index, "STALE", -1)
    second = store.update(corpus)  # the lock was left behind
    assert second == store.current != first and held.count() == 3 and store.postings(index.IndexRecord()).count() == 3
    empty = index.Store(spark, f"file://{tmp_path}/e")
    empty.build(Corpus(corpus.df.limit(0)))
    assert planner.plan(corpus, Q("alpha"), empty, fresh=False).narrowed().df.count() == 3


def test_idle_streams_stop(spark, tmp_path):
    spark.createDataFrame([(1, "p", "foo", False)], "file_id long, path string, content string, explicit boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file_id long, path string, content string, explicit boolean").parquet(f"{tmp_path}/in")
    query = live.grep(stream, Q("foo")).writeStream.format("memory").queryName("idle").start()
    live.until_idle(query, seconds=2, step=0.5)
    assert not query.isActive and spark.table("idle").count() == 1
