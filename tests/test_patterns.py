import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from gramscan.functions import literals as L
from gramscan.functions import pattern as P
from gramscan.functions import template as T
from gramscan.options import Case, Engine, Query


def python(q):
    return regex.compile("(?V1)" + q.compiled().python)


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "[z-a]", r"\q", "*a", "a{2,1}", "(?P<n>a)(?P<n>b)"])
def test_rejects(bad):
    with pytest.raises(P.PatternError):
        Query.of(bad).compiled()


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        (r"(?U)a+", "aaa", ["a", "a", "a"]),
        ("[[:alpha:]]+", "z:9", ["z"]),
        ("[a-z--[aeiou]]+", "hello", ["h", "ll"]),
        ("[a-f~~c-h]+", "abcdefgh", ["ab", "gh"]),
        (r"\p{Greek}+", "xαβ", ["αβ"]),
        (r"\b{start}x", "x ax", ["x"]),
        (r"a(?i)b|c", "aB C", ["aB", "C"]),
        ("x{2}", "xxxx", ["xx", "xx"]),
    ],
)
def test_dialect(spark, pattern, text, found):
    q = Query.of(pattern)
    assert [m[0] for m in python(q).finditer(text)] == found
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(q.compiled().java), 0).alias("a"))
    assert df.first()["a"] == found


def test_word_line_and_smart_case():
    assert python(Query.of("-2", word=True)).search("abc -2 foo")
    assert not python(Query.of("oo", word=True)).search("foo")
    assert python(Query.of("foo", line=True, word=True)).search("foo") and not python(Query.of("foo", line=True)).search("a foo")
    assert [Query.of(p, case=Case.SMART).insensitive for p in ("err_sys", "ERR_SYS", r"\w", r"\Wa")] == [True, False, False, True]


def test_auto_engine_takes_look_around():
    assert Query.of("(?<=foo)bar", engine=Engine.AUTO).compiled().native_dialect
    assert not Query.of("foo", engine=Engine.AUTO).compiled().native_dialect


def test_templates():
    m = regex.search(r"(?P<n>foo)(\d+)", "foo123")
    assert T.expand("${1}_$2|$n|$$|$1_x|$9", m, {"n": 1}) == "foo_123|foo|$||"
    assert T.to_java("${1}0", 2, {}) == "$1\\0"


def holds(query, text):
    if query is None:
        return True
    kind, value = query
    return value in text if kind == "lit" else (all if kind == "and" else any)(holds(q, text) for q in value)


PART = st.recursive(
    st.sampled_from(["a", "b", "foo", "bar", ".", "[ab]", "[^a]", r"\w", "x?", "fo*", "(?i)K"]),
    lambda s: st.one_of(st.tuples(s, s).map("".join), st.tuples(s, s).map(lambda p: f"(?:{p[0]}|{p[1]})"), s.map(lambda p: f"(?:{p})?"), s.map(lambda p: f"(?:{p})+")),
    max_leaves=6,
)


@settings(max_examples=300, deadline=None)
@given(PART, st.text("abfoxkKrK ", max_size=12))
def test_literals_are_required(pattern, text):
    from gramscan.operators.search import requirement

    q = Query.of(pattern)
    query, folded = requirement(q)
    if python(q).search(text):
        assert holds(query, "".join(map(L.fold, text)) if folded else text)
