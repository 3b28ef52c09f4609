"""Benchmark decontamination by greedy string tiling over joined seeds.

1. Seeds are hashes of ``least`` words in a row; an item of fewer words is one seed.  A bitmap of
   all items' seeds, of bounded size, is a sieve: only a text's seeds that pass it are shuffled.
2. Seeds of texts and items are joined by their hash.  The item words that shared seeds cover
   bound the coverage from above, so where only a verdict is asked for, pairs below the
   threshold go without a loss.
3. The pairs left are tiled: the longest common stretch of unmarked words is found by running
   Karp-Rabin hashes (a binary search over its length), compared word by word and marked, again
   and again, down to ``least`` words.  Of equally long ones the first of the text, then of the
   item, is marked.  Marked words over the item's words is the coverage; tiles may stand in any
   order, so reordered passages are found too.

A text is known by its SHA-256, so copies are tiled once and each row gets its text's result.  The
benchmark may be of any size: its seeds are broadcast only if their counted rows are few, and
no step depends on how items or texts are dealt.

Words: letters, digits and non-ASCII characters after lower-casing A-Z.  Null and empty texts are
clean; null and empty items are found nowhere.  Items of equal text are each reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, small
from .textops import NOT_ALNUM, Words, raw, shingles, signed, word_runs, words_of

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of the sieve: 16 a seed, within these powers of two (the larger is 16 MB).
LEAST_BITS, MOST_BITS = 16, 27


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Running:
    """Karp-Rabin hashes of all windows of a word sequence."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(words * _powers(_BASE, self.n), out=self.sums[1:])
        self.back = _powers(_INVERSE, self.n)

    def windows(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows whose words are all free, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[size:] == taken[:-size]) if size <= self.n else np.zeros(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


def tiles(text: np.ndarray, item: np.ndarray, least: int, equal=None) -> int:
    """Marked words of the item.  text, item: hashes of words; equal(i, j): whether text word i is item word j."""
    least = min(least, len(item))
    if not least or len(text) < least:
        return 0
    one, two = Running(text), Running(item)
    free_item = np.ones(len(item), bool)
    at, h = one.windows(np.isin(text, item), least)
    at = at[np.isin(h, two.windows(free_item, least)[1])]
    edge = np.zeros(len(text) + 1, np.int64)  # tiles lie within shared windows of the least size
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    free_text = np.cumsum(edge[:-1]) > 0

    def common(size: int) -> tuple[int, int] | None:
        a, x = one.windows(free_text, size)
        b, y = two.windows(free_item, size)
        order = np.argsort(y, kind="stable")
        b, y = b[order], y[order]
        lo, hi = np.searchsorted(y, x), np.searchsorted(y, x, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            for i in b[lo[k] : hi[k]].tolist():
                if (text[a[k] : a[k] + size] == item[i : i + size]).all() and (equal is None or all(equal(int(a[k]) + d, i + d) for d in range(size))):
                    return int(a[k]), i
        return None

    marked, longest = 0, len(item)
    while True:
        low, high, place = least, longest, common(least)
        if place is None:
            return marked
        while low < high:  # a common stretch holds common stretches of every smaller size
            middle = (low + high + 1) // 2
            found = common(middle)
            if found is None:
                high = middle - 1
            else:
                low, place = middle, found
        a, b = place
        free_text[a : a + low] = free_item[b : b + low] = False
        marked, longest = marked + low, low
        if not free_item.any():
            return marked


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _seeds(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = shingles(w, size)
    return signed(h), at


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """h, item, place, n of each seed of (item, text); n: the item's words."""

    def run(batches):
        for batch in batches:
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                n, ids = np.diff(w.first), batch.column("item").slice(lo, hi - lo)
                for size in range(1, least + 1):
                    h, at = _seeds(w, size)
                    own = n[w.row[at]] >= least if size == least else n[w.row[at]] == size
                    h, at = h[own], at[own]
                    row = w.row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(h), ids.take(pa.array(row)), pa.array(at - w.first[row]), pa.array(n[row])], names=["h", "item", "place", "n"])

    return items.mapInArrow(run, "h long, item binary, place long, n long")


def sieve_of(seeds: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds' high bits, and how many bits that are."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * count).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    words = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(h, {64 - bits}), 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(_U), bits


def text_seeds(rows: DataFrame, sizes: list[int], sieve: np.ndarray, bits: int) -> DataFrame:
    """t, h: the seeds of each text (t, text) that pass the sieve."""

    def run(batches):
        for batch in batches:
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                ids = batch.column("t").slice(lo, hi - lo)
                for size in sizes:
                    h, at = shingles(w, size)
                    place = h >> _U(64 - bits)
                    passed = (sieve[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1
                    h, row = h[passed], w.row[at[passed]]
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    if len(h):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[new])), pa.array(signed(h[new]))], names=["t", "h"])

    return rows.mapInArrow(run, "t binary, h long")


def covered(places: Column, least: int) -> Column:
    """Words of an item that seeds at the given places cover."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-least).cast("long").alias("last"))
    step = lambda s, p: F.struct((s["words"] + F.least(F.lit(least).cast("long"), p - s["last"])).alias("words"), p.alias("last"))
    return F.aggregate(F.array_sort(places), start, step, lambda s: s["words"])


def _tiled(pairs: DataFrame, least: int) -> DataFrame:
    """t, item, coverage of each (t, item, text, wording)."""

    def words(x) -> Words:
        return words_of(*raw(pa.array([x.as_py()], pa.large_string())), NOT_ALNUM)

    def run(batches):
        for batch in batches:
            out = []
            for text, wording in zip(batch.column("text"), batch.column("wording"), strict=True):
                a, b = words(text), words(wording)
                same = lambda i, j, a=a, b=b: a.buf[a.start[i] : a.end[i]].tobytes() == b.buf[b.start[j] : b.end[j]].tobytes()
                out.append(tiles(a.hash, b.hash, least, same) / len(b.hash))
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("item"), pa.array(out, pa.float64())], names=["t", "item", "coverage"])

    return pairs.mapInArrow(run, "t binary, item binary, coverage double")


def matches(docs: DataFrame, benchmark: DataFrame, least: int, floor: float) -> DataFrame:
    """t (SHA-256 of a text), item_id, coverage: every text with each item of a coverage of at least ``floor``, and over 0."""
    scratch = Scratch(docs.sparkSession, "tiling")
    named = fresh(benchmark, "item_id", "text").where("text is not null").withColumn("item", digest(F.col("text")))
    items = scratch.write(named.groupBy("item").agg(F.first("text").alias("text")))
    seeds = scratch.write(item_seeds(items, least))
    sizes = {r["size"]: r["count"] for r in seeds.groupBy(F.least("n", F.lit(least)).alias("size")).count().collect()}
    count = sum(sizes.values())
    sieve, bits = sieve_of(seeds, count)
    rows = fresh(docs, "text").where("text is not null").select(digest(F.col("text")).alias("t"), "text")
    hits = text_seeds(rows, sorted(sizes), sieve, bits).distinct()
    shared = hits.join(small(seeds, count, 64), "h").groupBy("t", "item", "n").agg(F.collect_set("place").alias("places"))
    reach = F.when(F.col("n") < least, F.col("n")).otherwise(covered(F.col("places"), least))
    pairs = scratch.write(shared.where(reach / F.col("n") >= floor).select("t", "item"))
    wanted = pairs.select("t").distinct()
    texts = rows.join(small(wanted, wanted.count(), 32), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    full = pairs.join(texts, "t").join(items.select("item", F.col("text").alias("wording")), "item").select("t", "item", "text", "wording")
    found = _tiled(full, least).where((F.col("coverage") >= floor) & (F.col("coverage") > 0))
    return scratch.write(found.join(named.select("item", "item_id"), "item").select("t", "item_id", "coverage"))


def find(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, contaminated, coverage (largest), item_id (that item, the smallest of several), items (all of coverage >= threshold) of every row."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    found = matches(docs, benchmark, least, 0.0)
    best = found.groupBy("t").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("m"), F.array_sort(F.collect_set(F.when(F.col("coverage") >= threshold, F.col("item_id")))).alias("items"))
    best = best.select("t", (-F.col("m.c")).alias("coverage"), F.col("m.item_id").alias("item_id"), "items")
    rows = fresh(docs, "doc_id", "text").select("doc_id", digest(F.col("text")).alias("t"))
    joined = rows.join(small(best, found.count(), 64), "t", "left")
    coverage = F.coalesce("coverage", F.lit(0.0))
    return joined.select("doc_id", (coverage >= threshold).alias("contaminated"), coverage.alias("coverage"), "item_id", F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows without a contaminating item, with all their columns."""
    bad = matches(docs, benchmark, least, threshold).select("t").distinct()
    return docs.join(small(bad, bad.count(), 32), digest(docs["text"]) == bad["t"], "left_anti")
