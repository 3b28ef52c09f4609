"""Near-duplicate detection by min-max hashing.

A document's set holds its distinct word shingles.  Each permutation of the 32-bit shingle
hashes gives two signature values, the minimum and the maximum, so ``2 * permutations``
values cost half the hash evaluations that minima alone need.  Bands of ``rows`` values,
minima or maxima, put documents into buckets.  At similarity 0.8 and with 44 bands of 5 a
pair of documents shares no bucket with probability (1 - 0.8^5)^44 < 3e-8.

Documents of equal sets are one vertex from the start (by a 128-bit digest of the set); doc_ids come
in only at the end, as the smallest one of a component.
Buckets never emit all their pairs: a bucket's members are compared with one of them, links are confirmed on the full sets, and components are contracted.  Members of
buckets that then still hold several components go through an exact prefix filter, which
compares only sets of different components that share one of their rarest elements: by
candidate pairs where few sets share it, in blocks that emit links only where many do.

Null and empty texts have an empty set and are linked with nothing.  A text of fewer words
than a shingle has one element, its whole sequence.  Rows that repeat a doc_id each get a
row, with the component of their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, fresh, small
from .textops import SPACE, mix, shingles, signed, word_runs

_U = np.uint64


def shingle_sets(column: pa.Array, size: int):
    """Sorted distinct shingle hashes of each row, in order."""
    for lo, hi, w in word_runs(column, SPACE):
        h, at = shingles(w, size)
        first = np.searchsorted(at, w.first)
        short = {}
        count = np.diff(w.first)
        for r in np.flatnonzero((count > 0) & (count < size)).tolist():
            x = np.array([count[r]], _U)
            for i in range(w.first[r], w.first[r + 1]):
                x = mix((x ^ w.hash[i]) * _U(0x9FB21C651E98DF25) + _U(1))
            short[r] = x
        for r in range(hi - lo):
            yield short[r] if r in short else np.unique(h[first[r] : first[r + 1]])


def permutations(bands: int, rows: int) -> np.ndarray:
    """Odd multipliers: bijections of 32 bits.  Two bands, one of minima and one of maxima, share ``rows`` of them."""
    return (np.random.default_rng(20).integers(0, 1 << 31, (-(-bands // 2), rows), np.int64) * 2 + 1).astype(np.uint32)


def band_keys(s: np.ndarray, odd: np.ndarray, bands: int) -> np.ndarray:
    """The 64-bit bucket keys of a set."""
    x = (s >> _U(32)).astype(np.uint32)
    flat = odd.reshape(-1, 1)
    low, high = np.full(len(flat), 0xFFFFFFFF, np.uint32), np.zeros(len(flat), np.uint32)
    for lo in range(0, len(x), 2048):
        values = x[None, lo : lo + 2048] * flat
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    values = np.concatenate([low.reshape(odd.shape), high.reshape(odd.shape)])[:bands].astype(_U)
    key = np.arange(len(values), dtype=_U)
    for k in range(values.shape[1]):
        key = mix((key * _U(0x9E3779B97F4A7C15)) ^ values[:, k])
    return signed(key)


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ _U(0x5BD1E9955BD1E995))).view(np.int64))


def _signed_documents(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    odd = permutations(bands, per_band)

    def run(batches):
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                if len(s):
                    x, y = digest(s)
                    high.append(x)
                    low.append(y)
                    keys.append(band_keys(s, odd, bands))
                else:
                    high.append(None)
                    low.append(None)
                    keys.append(None)
            for lo in range(0, len(n), 2000):
                part = slice(lo, lo + 2000)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, 2000) for c in ("doc_id", "mark")), pa.array(n[part], pa.int64()), pa.array(high[part], pa.int64()), pa.array(low[part], pa.int64()), pa.array(keys[part], pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "s1", "s2", "keys"])

    return rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, s1 long, s2 long, keys array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """s1, s2, n_shingles and set of each text that has one."""

    def run(batches):
        names = ["s1", "s2", "n_shingles", "s"]
        for batch in batches:
            sets, of, total = [], [], 0
            for s in shingle_sets(batch.column("text"), size):
                if len(s):
                    sets.append(signed(s))
                    of.append((*digest(s), len(s)))
                    total += len(s)
                if total > 500_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*of, strict=True)), pa.array(sets, pa.list_(pa.int64()))], names=names)
                    sets, of, total = [], [], 0
            if sets:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*of, strict=True)), pa.array(sets, pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(run, "s1 long, s2 long, n_shingles long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            x, y = batch.column("sa"), batch.column("sb")
            x_all, x_at = x.values.to_numpy(), x.offsets.to_numpy()
            y_all, y_at = y.values.to_numpy(), y.offsets.to_numpy()
            for k in range(len(batch)):
                p, q = x_all[x_at[k] : x_at[k + 1]], y_all[y_at[k] : y_at[k + 1]]
                both = np.isin(p, q, assume_unique=True).sum() if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                keep.append(100 * int(both) >= percent * (len(p) + len(q) - int(both)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


#: Elements that more prefixes than this share are compared in blocks, not by emitted pairs.
CROWD = 16
#: Sets of a block, about.
BLOCK = 200


def prefixes(vertices: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """h, v, label, n: the elements by which a set can still be found.

    Sets that reach the similarity share an element among the first n - ceil(n * percent / 100) + 1
    of either, with elements in the order of their frequency.  Elements that only one set has
    come first and are of no use, so copies that differ by changes of their own drop out."""
    each = sets.join(vertices, "v").select("v", "label", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    by_set = Window.partitionBy("v")
    placed = each.join(often, "h").select("v", "label", "n", "h", F.row_number().over(by_set.orderBy("df", "h")).alias("at"), F.count("*").over(by_set).alias("shared"))
    return placed.where(f"n - shared + at <= n - cast(ceil(n * {percent} / 100.0) as int) + 1").select("h", "v", "label", "n")


def _linked(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        """Links between the sets of two blocks, or within one."""
        v, label, block = (table.column(c).to_numpy() for c in ("v", "label", "block"))
        s = table.column("s").combine_chunks()
        values, at = s.values.to_numpy(), s.offsets.to_numpy()
        values, size = values[at[0] : at[-1]], np.diff(at)
        row = np.repeat(np.arange(len(v)), size)
        _, element, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = times[element] > 1
        row, element = row[shared], np.unique(element[shared], return_inverse=True)[1]
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        both = np.zeros((len(one), len(two)), np.float32)
        order = np.argsort(element, kind="stable")
        row, element = row[order], element[order]
        for lo in range(0, int(element[-1]) + 1 if len(element) else 0, 4096):
            i, j = np.searchsorted(element, [lo, lo + 4096])
            has = np.zeros((len(v), 4096), np.float32)
            has[row[i:j], element[i:j] - lo] = 1
            both += has[one] @ has[two].T
        union = size[one][:, None] + size[two][None, :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (label[one][:, None] != label[two][None, :]))
        x, y = v[one[x]], v[two[y]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return compare


def settle(vertices: DataFrame, sets: DataFrame, tried: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between vertices of different labels, exactly.

    Elements of few prefixes give candidate pairs, at most CROWD / 2 a prefix row.  Prefixes that
    share a crowded element belong to one family; a family's sets are dealt into blocks, and
    each pair of blocks is compared by one product of their membership matrices, which emits
    links only."""
    prefix = scratch.write(prefixes(vertices, sets, percent))
    width = prefix.groupBy("h").agg(F.count("*").alias("c"), F.min("v").alias("head"))
    few = prefix.join(width.where(f"c between 2 and {CROWD}").select("h"), "h")
    one, two = (few.select("h", F.col("v").alias(x), F.col("label").alias(f"label_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    alike = f"a < b and label_a <> label_b and 100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a"
    pairs = one.join(two, "h").where(alike).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = confirmed(scratch.write(pairs), sets, percent)
    crowds = scratch.write(prefix.join(width.where(f"c > {CROWD}").select("h", "head"), "h").select(F.col("v").alias("a"), F.col("head").alias("b")).distinct())
    if not crowds.limit(1).count():
        return links
    families = components(crowds, scratch).select(F.col("node").alias("v"), F.col("label").alias("family"))
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("v", "family", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    rows = dealt.join(vertices, "v").join(sets, "v").select("family", "i", "j", "block", "v", "label", "s")
    return links.union(rows.groupBy("family", "i", "j").applyInArrow(_linked(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, bands: int = 44, per_band: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; doc_id must be an integer."""
    spark = docs.sparkSession
    rows = fresh(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "mark": F.xxhash64("text")})
    scratch = Scratch(spark, "near")
    signed_docs = scratch.write(_signed_documents(rows, size, bands, per_band))
    key = ["s1", "s2", "n_shingles"]
    same = signed_docs.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("least"), F.min(F.struct("mark", "doc_id")).alias("pick"), F.first("keys").alias("keys"))
    same = scratch.write(same.withColumn("v", F.monotonically_increasing_id()))
    members = same.select(F.col("v"), F.explode("keys").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("v").alias("pivot"), F.max("v").alias("other")).where("pivot < other").select("bucket", "pivot")
    buckets = scratch.write(members.join(crowded, "bucket").select("bucket", "v", "pivot"))
    wanted = buckets.select("v").distinct()
    n_wanted = wanted.count()
    chosen = same.select(*key, "pick", "v").join(small(wanted, n_wanted, 16), "v")
    pick = chosen.select(F.col("pick.mark").alias("m"), F.col("pick.doc_id").alias("i")).distinct()
    one = (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("i"))  # a row of each set; others that share its id and hash cost time only
    texts = rows.join(small(pick, n_wanted, 24), one).select("text")
    sets = scratch.write(_sets(texts, size).dropDuplicates(key).join(small(chosen.select(*key, "v"), n_wanted, 48), key).select("v", "s"))

    tried = scratch.write(buckets.where("v <> pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b")).distinct())
    links = scratch.write(confirmed(tried, sets, percent))
    labels = components(links, scratch)
    placed = buckets.select("bucket", "v").join(labels, F.col("v") == F.col("node"), "left").select("bucket", "v", F.coalesce("label", "v").alias("label"))
    unsettled = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
    left = scratch.write(placed.join(unsettled, "bucket").select("v", "label").distinct())
    labels = components(links.union(settle(left, sets, tried, percent, scratch)), scratch)
    found = same.select(*key, "least", "v").join(labels, F.col("v") == F.col("node"), "left").select(*key, "least", "label")
    first = scratch.write(found.where("label is not null").groupBy("label").agg(F.min("least").alias("first")))
    placed = found.join(small(first, first.count(), 24), "label", "left").select(*key, F.coalesce("first", "least").alias("component"))
    placed = scratch.write(placed)
    joined = signed_docs.select("doc_id", *key).join(small(placed, placed.count(), 40), key, "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
