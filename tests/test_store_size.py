"""What a store costs to build, and that its coded lists say what the files hold."""

import functools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramscan.operators import index
from gramscan.options import Query
from gramscan.plans import planner
from gramscan.sources.corpus import Corpus

IDS = [-(2**63), -5, 0, 7, 7, 8, 300, 2**40, 2**63 - 1]


def prose(k, words=200):
    rng = random.Random(k)
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeio')}" for _ in range(words))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    df = spark.createDataFrame([(k, prose(k)) for k in range(1500)], "id long, text string").repartition(3)
    folder = f"file://{tmp_path_factory.mktemp('texts')}/t"
    df.write.parquet(folder)
    return Corpus.from_table(spark.read.parquet(folder), "id", "text")


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)


def bytes_of(texts):
    return texts.df.agg(F.sum(F.octet_length("content"))).first()[0]


def test_build_shuffles_nothing(spark, texts, tmp_path):
    """a build writes its lists where the files are read."""
    before, store = shuffled(spark), index.Store(spark, f"file://{tmp_path}/i")
    store.build(texts)
    assert shuffled(spark) - before < bytes_of(texts) / 20
    q = Query.of("dala mela|tuli")
    want = sorted(r["id"] for r in ({"id": k, "text": prose(k)} for k in range(1500)) if "dala mela" in r["text"] or "tuli" in r["text"])
    got = {r["file_id"] for r in planner.plan(texts, q, store).candidates.collect()}
    assert want and got.issuperset(want)


@pytest.mark.parametrize("width", [1, 3, 5, 7])
def test_lists_hold_each_gram_of_each_file_once(spark, tmp_path, monkeypatch, width):
    """any 64-bit ids, in any order and repeated; texts shorter than a gram; several runs."""
    data = ["abcabcabc", "", "éKelvin É", "ab", "abcdefgh xyz", None, "xyzxyz abcdefgh", "a", "zzzzzzzzzz"]
    corpus = Corpus.from_table(spark.createDataFrame(list(zip(IDS, data, strict=True))[::-1], "id long, text string").coalesce(1), "id", "text")
    record = index.IndexRecord(width)
    want = sorted({(int.from_bytes(b[k : k + width], "big"), i) for i, t in zip(IDS, data, strict=True) for b in [(t or "").encode()] for k in range(len(b) - width + 1)})
    for gathered in (1, 20, 8_000_000):
        monkeypatch.setattr(index, "GATHERED", gathered)
        store = index.Store(spark, f"file://{tmp_path}/{gathered}")
        store.build(corpus, index.Meta(kinds=[record.name]))
        flat = [sorted((r["gram"], r["file_id"]) for r in df.collect()) for df in (store.postings(record), index.postings(corpus, record))]
        assert sorted(set(flat[0])) == sorted(set(flat[1])) == want
        if gathered > 20:  # files of one id in one run
            assert flat[0] == flat[1] == want


def test_numbers_and_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1], np.uint64)
    data, sizes = index.varints(values)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 10, 10] and index.numbers(data.tobytes()).tolist() == values.tolist()
    assert not len(index.numbers(b"")) and not len(index.varints(values[:0])[0])


def test_store_is_small_beside_its_texts(spark, texts, tmp_path):
    """two kinds of trigrams, with the list of files, take less than half of the texts' bytes."""
    store = index.Store(spark, f"file://{tmp_path}/i")
    store.build(texts)
    assert size(tmp_path) < bytes_of(texts) / 2
    assert sorted((r["file_id"], r["path"], r["size"]) for r in store.files().collect()) == [(k, str(k), len(prose(k))) for k in range(1500)]


def test_two_widths_intersect_without_a_shuffle(spark, texts, tmp_path):
    """3-grams and 5-grams in one pass; more grams than the reader's IN filter takes."""
    before, store = shuffled(spark), index.Store(spark, f"file://{tmp_path}/i")
    store.build(texts, index.Meta(kinds=["trigram", "ngram-5"]))
    assert shuffled(spark) - before < bytes_of(texts) / 20
    for literal in ("dala ", prose(3)[20:60]):
        plan = planner.plan(texts, Query.of(literal, fixed=True), store)
        grams = {w: index._grams_of(literal, index.IndexRecord(w)) for w in (3, 5)}
        held = lambda t: all(set(index.file_grams(t.encode(), w).tolist()).issuperset(g) for w, g in grams.items())
        assert plan.kind == "ngram-3,ngram-5" and sorted(r["file_id"] for r in plan.candidates.collect()) == [k for k in range(1500) if held(prose(k))]


def test_update_equals_a_new_build(spark, texts, tmp_path):
    """half of the files, then all of them."""
    before, store, new = shuffled(spark), index.Store(spark, f"file://{tmp_path}/i"), index.Store(spark, f"file://{tmp_path}/n")
    store.build(Corpus(texts.df.where("file_id % 2 = 0")))
    store.update(texts)
    assert shuffled(spark) - before < bytes_of(texts) / 20
    new.build(texts)
    for record in index.DEFAULT:
        a, b = (s.postings(record) for s in (store, new))
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()


@functools.cache
def grams_of(k, width):
    return frozenset(index.file_grams(prose(k).encode(), width).tolist())


def brute(literals, width=3):
    """Ids of texts that hold all grams of one of the literals, or the whole of one a byte short."""
    grams = [frozenset(index.file_grams(x.encode(), width).tolist()) for x in literals]
    return [k for k in range(1500) if any(g <= grams_of(k, width) if g else x in prose(k) for x, g in zip(literals, grams, strict=True))]


def test_store_has_blocks_of_lists(spark, texts, tmp_path):
    """a row for each 16,000 postings, not one for each list of a gram."""
    store = index.Store(spark, f"file://{tmp_path}/i")
    store.build(texts, index.Meta(kinds=["trigram", "ngram-5"]))
    for record in (index.IndexRecord(3), index.IndexRecord(5)):
        blocks, n = store.lists(record).agg(F.count("*"), F.sum("n")).first()
        assert n == sum(len(grams_of(k, record.width)) for k in range(1500))
        assert blocks <= n // index.BLOCK + 6 and store.lists(record).where("lo > hi").isEmpty()


@pytest.mark.parametrize("width", range(1, 8))
def test_windows(width):
    """windows of each width in the smallest type that holds them."""
    data = bytes(random.Random(width).randbytes(300)) + b"\xff" * 9
    got = index._windows(np.frombuffer(data, np.uint8), width)
    assert got.tolist() == [int.from_bytes(data[k : k + width], "big") for k in range(len(data) - width + 1)]
    assert not len(index._windows(np.frombuffer(data[: width - 1], np.uint8), width))


def test_blocks_of_any_size_hold_the_same(spark, texts, tmp_path, monkeypatch):
    """blocks of one list, and one block for all; lookups of each."""
    record, found = index.IndexRecord(), {}
    for block in (1, 1 << 30):
        monkeypatch.setattr(index, "BLOCK", block)
        store = index.Store(spark, f"file://{tmp_path}/{block}")
        store.build(texts, index.Meta(kinds=[record.name]))
        rows = store.lists(record).count()
        found[block] = (rows, store.postings(record).agg(F.count("*"), F.sum(F.hash("gram", "file_id"))).first())
        for literals in (["la", "dala m"], [prose(5)[30:50], prose(6)[30:50]]):
            query = ("or", [("lit", x) for x in literals])
            got = index.candidates(store.lists(record), store.files(), query, record)
            assert sorted(r["file_id"] for r in got.collect()) == brute(literals), (block, literals)
    assert found[1][0] > found[1 << 30][0] and found[1][1] == found[1 << 30][1]


def test_update_with_edits_and_removals(spark, texts, tmp_path):
    """more grams than ranges of a lookup, after an update that edits some files and drops others; no wider Arrow batches."""
    store = index.Store(spark, f"file://{tmp_path}/i")
    store.build(texts)
    edited = F.when(F.col("file_id") % 3 == 0, F.lit("nothing yet")).otherwise(F.col("content"))
    now = Corpus(texts.df.where("file_id % 5 > 0").withColumn("content", edited))
    store.update(now)
    literals = [prose(k)[10 * k : 10 * k + 24] for k in range(1, 30)]
    plan = planner.plan(now, Query.of(*literals, fixed=True), store)
    grams, _, _ = index.lookup(("or", [("lit", x) for x in literals]), index.IndexRecord())
    assert len(grams) > index.RANGES
    assert sorted(r["file_id"] for r in plan.candidates.collect()) == [k for k in brute(literals) if k % 5 and k % 3]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
