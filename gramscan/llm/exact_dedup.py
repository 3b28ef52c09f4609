"""Exact dedup by a Golomb-coded exchange of fingerprints.

1. Each partition normalises its texts, hashes them and sends every owner one sorted,
   Golomb-Rice coded list of the 64-bit fingerprints in the owner's range.
2. An owner answers each list with a bitmap: which of its fingerprints another list has too.
3. A partition marks as suspects the rows whose bit is set or whose fingerprint it holds twice.
   Only suspects' texts are shuffled: grouped by the whole text, hence compared byte by byte,
   with a map-side aggregation, so a group of any size leaves each task as one row.

Texts are equal when identical after each run of space and 0x09-0x0D became one space; null
is an empty text.  The row with the smallest doc_id stays.  Rows that repeat a doc_id count
one by one in group_size and share their document's fate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, small
from .textops import SPACE, raw, runs


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The rows' bytes with single spaces, and their offsets."""
    gap = SPACE[buf]
    drop = np.zeros(len(buf), bool)
    drop[1:] = gap[1:] & gap[:-1]
    first = offsets[:-1][offsets[:-1] < len(buf)]
    drop[first] = False
    out = np.where(gap, np.uint8(0x20), buf)[~drop]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return out.tobytes(), kept[offsets]


def golomb(sorted_values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice parameter, unary quotients and fixed-width remainders of the steps between sorted uint64."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    k = max(0, int(np.log2(float(steps.astype(float).mean()) + 1)))
    q = (steps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = (steps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def ungolomb(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)


_COLUMNS = "part int, owner int, sha binary, fingerprint long, n int, k int, unary binary, rest binary, list int"


def _hashed(rows: DataFrame, owners: int) -> DataFrame:
    """A row for each document (list 0) and, at a partition's end, one for each owner's list (list 1)."""
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, {_COLUMNS}"

    def run(batches):
        part, all_prints, kind = TaskContext.get().partitionId(), [], None
        names = ["doc_id", *[c.split()[0] for c in _COLUMNS.split(", ")]]
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            kind = ids.type
            buf, offsets = raw(column)
            for lo, hi in runs(offsets, 8 << 20):
                data, at = normalised(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                view, n = memoryview(data), hi - lo
                sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                prints = np.frombuffer(b"".join(sha), ">u8")[::4].astype(np.uint64)
                all_prints.append(prints)
                none = lambda t: pa.nulls(n, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array([part] * n, pa.int32()), none(pa.int32()), pa.array(sha, pa.binary()), pa.array(prints.view(np.int64)), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary()), pa.array([0] * n, pa.int32())], names=names)
        if all_prints:
            mine = np.unique(np.concatenate(all_prints))
            of = ((mine >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            for o in np.unique(of):
                own = mine[of == o]
                k, unary, rest = golomb(own)
                one = lambda v, t: pa.array([v], t)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), one(part, pa.int32()), one(int(o), pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), one(len(own), pa.int32()), one(k, pa.int32()), one(unary, pa.binary()), one(rest, pa.binary()), one(1, pa.int32())], names=names)

    return rows.mapInArrow(run, schema)


def _answers(table: pa.Table) -> pa.Table:
    """Of one owner's lists: a bitmap for each."""
    lists = [ungolomb(*x) for x in zip(*(table.column(c).to_pylist() for c in ("n", "k", "unary", "rest")), strict=True)]
    seen, times = np.unique(np.concatenate(lists), return_counts=True)
    twice = seen[times > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pa.table({"part": table.column("part"), "owner": table.column("owner"), "n": table.column("n"), "bits": pa.array(maps, pa.binary())})


def _marks(docs: pa.Table, maps: pa.Table) -> pa.Table:
    """Of one partition: which of its documents are suspects."""
    prints = docs.column("fingerprint").to_numpy().view(np.uint64)
    mine, back, times = np.unique(prints, return_inverse=True, return_counts=True)
    order = np.argsort(maps.column("owner").to_numpy())
    bits, n = maps.column("bits").to_pylist(), maps.column("n").to_pylist()
    twice = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8))[: n[i]] for i in order] or [np.zeros(0, np.uint8)]).astype(bool)
    if len(docs) == 0:
        suspect = np.zeros(0, bool)
    else:
        suspect = (twice | (times > 1))[back]
    return pa.table({"doc_id": docs.column("doc_id"), "sha": docs.column("sha"), "suspect": pa.array(suspect)})


def normalised_text(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", " ")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    spark = docs.sparkSession
    rows = fresh(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(spark, "exact")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())  # so an owner has what a partition sends
    hashed = scratch.write(_hashed(rows, owners), "list")
    lists = hashed.where("list = 1").select("part", "owner", "n", "k", "unary", "rest")
    maps = lists.groupBy("owner").applyInArrow(_answers, "part int, owner int, n int, bits binary")
    each = hashed.where("list = 0").select("doc_id", "part", "sha", "fingerprint")
    marked = scratch.write(each.groupBy("part").cogroup(maps.groupBy("part")).applyInArrow(_marks, f"doc_id {kind}, sha binary, suspect boolean"))
    suspects = marked.where("suspect").select(F.col("doc_id").alias("id")).distinct()
    texts = rows.join(small(suspects, suspects.count(), 16), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    same = texts.groupBy(normalised_text(F.col("text")).alias("t")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("size"))
    same = scratch.write(same.select(F.unhex(F.sha2("t", 256)).alias("sha"), "keep", "size"))
    joined = marked.join(small(same, same.count(), 64), "sha", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``dropped``; its size decides on the join."""
    ids = dropped.select(F.col("doc_id").alias("dropped_id")).distinct()
    ids = Scratch(docs.sparkSession, "dropped").write(ids)
    return docs.join(small(ids, ids.count(), 16), docs["doc_id"].eqNullSafe(ids["dropped_id"]), "left_anti")
