"""N-gram inverted index: grams of each file, snapshots in Parquet, candidate lookup.

A snapshot is ``snapshots/<id>/{files,postings}``; ``CURRENT`` names the live one and is
replaced by one atomic rename after the tables are complete and their rows were counted.  A writer
holds ``LOCK``, which names its time; one older than ``STALE`` seconds is taken over.  A
reader that holds a snapshot's name keeps it through one later update.  Every path goes through Hadoop's file
systems, so a store that only Spark reaches will do.  A task writes the posting lists of its
files, sorted by kind and gram within runs of about 8 MB of text, as blocks of about 16,000 postings, and
nothing is shuffled: a lookup reads, of each run, the blocks whose range fits.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import fold
from ..sources.corpus import Corpus, decode

VERSION = 3
MOST_GRAMS = 24
#: Postings of a block, up to the end of the last list that begins in it: the least that a lookup reads of a run.
BLOCK = 1 << 14
#: Seconds after which a writer's lock counts as left behind.
STALE = 6 * 3600


class IndexError_(ValueError):
    pass


@dataclass(frozen=True)
class IndexRecord:
    width: int = 3
    norm: str = "identity"  # or ascii-lower

    @property
    def name(self) -> str:
        return f"ngram-{self.width}" + ("-ascii-lower" if self.norm == "ascii-lower" else "")

    @staticmethod
    def parse(name: str) -> IndexRecord:
        if name == "trigram":
            return IndexRecord()
        lower = name.endswith("-ascii-lower")
        body = name.removesuffix("-ascii-lower").replace(":", "-")
        kind, _, width = body.partition("-")
        if kind != "ngram" or not width.isdigit() or not 1 <= int(width) <= 7:
            raise IndexError_(f"unknown index {name!r}")
        return IndexRecord(int(width), "ascii-lower" if lower else "identity")


DEFAULT = (IndexRecord(), IndexRecord(norm="ascii-lower"))


@dataclass
class Meta:
    version: int = VERSION
    root: str = ""
    include: list[str] = field(default_factory=list)
    coverage: str = "complete"  # or lazy
    walk: dict = field(default_factory=dict)
    kinds: list[str] = field(default_factory=lambda: [r.name for r in DEFAULT])

    def covers(self, walk: dict, scopes: list[str]) -> bool:
        inside = not self.include or bool(scopes) and all(any(s == i or s.startswith(i + "/") for i in self.include) for s in scopes)
        return self.walk == walk and inside


def file_grams(data: bytes, width: int) -> np.ndarray:
    """Distinct big-endian windows of a file."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < width:
        return np.zeros(0, np.int64)
    g = np.zeros(len(b) - width + 1, np.int64)
    for k in range(width):
        g = (g << 8) | b[k : len(b) - width + 1 + k]
    return np.unique(g)


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def folded(data: bytes) -> bytes:
    """``literals.fold`` of UTF-8 bytes."""
    return data.translate(_FOLD).replace("\u212a".encode(), b"k").replace("\u017f".encode(), b"s")


#: Bytes of text that a task gathers to one run before it emits their grams.
GATHERED = 8_000_000


def _windows(b: np.ndarray, width: int) -> np.ndarray:
    """Big-endian windows of bytes, in as few bytes as hold them."""
    if width == 1:
        return b
    half = width // 2
    high, low = _windows(b, width - half), _windows(b, half)
    g = high[: max(0, len(b) - width + 1)].astype(np.uint16 if width == 2 else np.uint32 if width < 5 else np.int64)
    g <<= 8 * half
    g |= low[width - half :]
    return g


def _changes(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before; the first does."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _joined_grams(files: list[bytes], width: int, rank: np.ndarray, bits: int) -> np.ndarray:
    """Distinct ``gram << bits | rank of the file`` of all windows within a file, in order."""
    b = np.frombuffer(b"".join(files), np.uint8)
    sizes = np.array([len(f) for f in files], np.int64)
    n = len(b) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    g = _windows(b, width).astype(np.int64)
    g <<= bits
    g |= np.repeat(rank.astype(np.int32), sizes)[:n]
    ends = np.cumsum(sizes)
    for k in range(1, width):
        at = ends - k
        g[at[(at >= 0) & (at < n)]] = -1  # a window over the end of a file
    g.sort()
    new = _changes(g)
    new[0] = g[0] >= 0
    return g[new]


def _runs(batches, records: list[IndexRecord], text: bool):
    """(kind, grams, index into ids, ids) of each run of files and kind, sorted; ids: the run's, sorted, each once.

    Decodes each file once, as a search does."""
    most = 1 << (63 - 8 * max(r.width for r in records))  # a gram and a file share a 63-bit key

    def flush():
        ids, rank = np.unique(np.array([i for i, _ in held], np.int64), return_inverse=True)
        bits = int(len(ids) - 1).bit_length()
        forms = {}
        for k, record in enumerate(records):
            if record.norm not in forms:
                forms[record.norm] = [data if record.norm == "identity" else folded(data) for _, data in held]
            keys = _joined_grams(forms[record.norm], record.width, rank, bits)
            if len(keys):
                at = keys & ((1 << bits) - 1)
                keys >>= bits
                yield k, keys, at, ids

    held, n = [], 0
    for batch in batches:
        for i, data in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
            data = data.as_buffer().to_pybytes()
            data = data if text else decode(data)
            held.append((i, data))
            n += len(data)
            if n >= GATHERED or len(held) >= most:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit numbers as LEB128: the bytes, and how many each number has."""
    n = np.ones(len(values), np.int8)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        n += more
    if n.max(initial=1) == 1:
        return values.astype(np.uint8), n
    at = np.cumsum(n, dtype=np.int64) - n
    out = np.zeros(int(at[-1] + n[-1]), np.uint8)
    out[at] = values.astype(np.uint8) & 127 | (n > 1).view(np.uint8) << 7
    for k in range(1, int(n.max())):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(n[has] > k + 1, 128, 0).astype(np.uint8)
    return out, n


def numbers(data: bytes) -> np.ndarray:
    """What ``varints`` wrote."""
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        has = np.flatnonzero(first + k <= last)
        out[has] |= (b[first[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _contents(corpus: Corpus) -> DataFrame:
    """Python reads them in batches of about 4 MB, which bounds executors' memory outside the heap; a session
    that sets another bound than Spark's default keeps it."""
    conf = corpus.df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, "4m")
    return corpus.df.select("file_id", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))


LISTS = "lo long, hi long, n long, base long, heads binary, gaps binary"


def posting_lists(corpus: Corpus, records: list[IndexRecord]) -> DataFrame:
    """kind and LISTS: blocks of lists, one list for each gram of a run of files, each run by kind and gram.

    A block has the lists of grams from ``lo`` to ``hi`` with n file ids in all.  Its heads are the gaps between
    grams, the first from ``lo``, and then the lists' lengths; the file ids are gaps from the one before, the first
    of a list from ``base`` (the run's least id).  All are in LEB128.  One pass takes the grams of all kinds."""
    text = corpus.text

    def run(batches):
        for kind, gram, at, ids in _runs(batches, records, text):
            past = (ids - ids[0]).view(np.uint64)[at]  # wraps where ids are more than 63 bits apart, and back
            new, gaps = np.flatnonzero(_changes(gram)), past.copy()
            gaps[1:] -= past[:-1]
            gaps[new] = past[new]
            n, gram = np.diff(np.append(new, len(gram))), gram[new]
            cuts = np.append(np.flatnonzero(np.diff(new // BLOCK, prepend=-1)), len(new))
            first = np.append(new, len(gaps))[cuts]
            heads, lists = [], []
            for k, (lo, hi) in enumerate(itertools.pairwise(cuts.tolist())):
                heads.append(varints(np.concatenate([np.diff(gram[lo:hi], prepend=gram[lo]), n[lo:hi]]).view(np.uint64))[0].tobytes())
                lists.append(varints(gaps[first[k] : first[k + 1]])[0].tobytes())
            columns = [np.full(len(heads), kind, np.int32), gram[cuts[:-1]], gram[cuts[1:] - 1], np.diff(first), np.full(len(heads), ids[0])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(heads, pa.binary()), pa.array(lists, pa.binary())], names=["kind", "lo", "hi", "n", "base", "heads", "gaps"])

    return _contents(corpus).mapInArrow(run, f"kind int, {LISTS}")


def listed(lists: DataFrame, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """gram, file_id of posting lists; wanted: which of some grams, None all."""

    def run(batches):
        for batch in batches:
            for lo, base, heads, gaps in zip(batch.column("lo").to_pylist(), batch.column("base").to_numpy().view(np.uint64), batch.column("heads"), batch.column("gaps"), strict=True):
                head = numbers(heads.as_buffer()).view(np.int64)
                gram, n = lo + np.cumsum(head[: len(head) // 2]), head[len(head) // 2 :]
                keep = wanted(gram) if wanted else np.ones(len(gram), bool)
                if not keep.any():
                    continue
                past = numbers(gaps.as_buffer())
                first, total = np.cumsum(n) - n, np.cumsum(past)
                ids = (total + np.repeat(base - total[first] + past[first], n)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram[keep], n[keep])), pa.array(ids[np.repeat(keep, n)])], names=["gram", "file_id"])

    return lists.select("lo", "base", "heads", "gaps").mapInArrow(run, "gram long, file_id long")


def postings(corpus: Corpus, record: IndexRecord) -> DataFrame:
    """gram, file_id: each once."""
    text = corpus.text

    def run(batches):
        for _, gram, at, ids in _runs(batches, [record], text):
            for lo in range(0, len(gram), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(gram[part]), pa.array(ids[at[part]])], names=["gram", "file_id"])

    return _contents(corpus).mapInArrow(run, "gram long, file_id long")


def files_of(corpus: Corpus) -> DataFrame:
    """file_id, path, size and mark (of the content) of every file."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return corpus.df.select("file_id", "path", F.octet_length(content).cast("long").alias("size"), F.xxhash64(content).alias("mark"))


def _grams_of(literal: str, record: IndexRecord) -> list[int]:
    data = ("".join(map(fold, literal)) if record.norm == "ascii-lower" else literal).encode("utf-8")
    grams = file_grams(data, record.width).tolist()
    return grams[:: max(1, -(-len(grams) // MOST_GRAMS))]  # a long literal needs no more: a superset of candidates is sound


def lookup(query, record: IndexRecord) -> tuple[set[int], list[tuple[int, int]], object] | None:
    """(grams, covering 2-byte ranges, plan) of a literal query; None if the index can't restrict it.

    plan: ("and"|"or", parts), ("all", grams) or ("near", prefix): a literal one byte short of the
    width, found by grams that begin or end with it."""
    kind, value = query
    if kind == "lit":
        data = ("".join(map(fold, value)) if record.norm == "ascii-lower" else value).encode("utf-8")
        if len(data) >= record.width:
            grams = _grams_of(value, record)
            return set(grams), [], ("all", grams)
        if len(data) == record.width - 1 and len(data) > 0:
            p = int.from_bytes(data, "big")
            return set(), [p], ("near", p)
        return None
    parts = [lookup(q, record) for q in value]
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return set().union(*(p[0] for p in parts)), [x for p in parts for x in p[1]], (kind, [p[2] for p in parts])


def _evaluate(plan, record: IndexRecord) -> Column:
    kind, value = plan
    if kind == "all":
        return F.array_contains("grams", value[0]) if len(value) == 1 else F.size(F.array_intersect("grams", F.array(*map(F.lit, value)))) == len(value)
    if kind == "near":
        return F.exists("grams", lambda g: (F.shiftright(g, 8) == value) | (F.pmod(g, F.lit(1 << 8 * (record.width - 1))) == value))
    parts = [_evaluate(p, record) for p in value]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p
    return out


#: Ranges of grams that a lookup gives the Parquet reader; more grams share ranges.
RANGES = 48


def candidates(lists: DataFrame, files: DataFrame, query, record: IndexRecord) -> DataFrame | None:
    """file_id of every file that can match, by posting lists; files shorter than a gram always can.  None: all files."""
    found = lookup(query, record) if query is not None else None
    if found is None:
        return None
    grams, near, plan = found
    order, ends, wide = np.array(sorted(grams), np.int64), np.array(sorted(set(near)), np.int64), 1 << 8 * (record.width - 1)

    def wanted(gram):
        return np.isin(gram, order) | np.isin(gram >> 8, ends) | np.isin(gram % wide, ends)

    rule = F.lit(bool(near))  # what ends with a literal stands anywhere
    for part in np.array_split(order, min(RANGES, len(order))) if len(order) and not near else []:
        rule = rule | ((F.col("lo") <= int(part[-1])) & (F.col("hi") >= int(part[0])))
    hits = listed(lists.where(rule), wanted).groupBy("file_id").agg(F.collect_set("gram").alias("grams")).where(_evaluate(plan, record)).select("file_id")
    return hits.unionByName(files.where(F.col("size") < record.width).select("file_id")).distinct()


class Store:
    """Snapshots under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        data = stream.readAllBytes()
        stream.close()
        return bytes(data).decode()

    @property
    def current(self) -> str | None:
        return self._read(f"{self.folder}/CURRENT")

    @property
    def meta(self) -> Meta | None:
        text = self._read(f"{self.folder}/meta.json")
        if text is None:
            return None
        meta = Meta(**json.loads(text))
        if meta.version != VERSION:
            raise IndexError_(f"store version {meta.version} is not {VERSION}")
        return meta

    def build(self, corpus: Corpus, meta: Meta | None = None) -> str:
        if self.current is not None:
            raise IndexError_("an index exists already; update it")
        return self._publish(corpus, meta or Meta())

    def update(self, corpus: Corpus) -> str:
        if self.current is None:
            raise IndexError_("there is no index to update")
        return self._publish(corpus, self.meta)

    def _lock(self) -> None:
        path = self._path(f"{self.folder}/LOCK")
        if not self.fs.createNewFile(path):
            if time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000 < STALE:
                raise IndexError_("another writer holds the index")
            self.fs.delete(path, False)
            if not self.fs.createNewFile(path):
                raise IndexError_("another writer holds the index")

    def _replace(self, name: str, text: str) -> None:
        """One rename over the old file: a reader finds the old text or the new one."""
        self._write(f"{self.folder}/{name}.tmp", text)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = hadoop.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(f"{self.folder}/{name}.tmp"), self._path(f"{self.folder}/{name}"), how)

    def _publish(self, corpus: Corpus, meta: Meta) -> str:
        self.fs.mkdirs(self._path(self.folder))
        self._lock()
        try:
            stamp = time.time_ns()
            name = f"{stamp // 10**9:x}-{stamp % 10**9:x}"
            tmp = f"{self.folder}/snapshots/tmp-{name}"
            records = [IndexRecord.parse(k) for k in meta.kinds]
            files_of(corpus).write.parquet(f"{tmp}/files")
            kind = F.element_at(F.array(*[F.lit(r.name) for r in records]), F.col("kind") + 1)
            seen = Observation()
            lists = posting_lists(corpus, records).withColumn("kind", kind).observe(seen, F.sum("n").alias("n"))
            lists.write.option("compression", "zstd").option("parquet.page.row.count.limit", 1).parquet(f"{tmp}/postings")
            wanted, there = seen.get.get("n") or 0, self._lists(f"{tmp}/postings").agg(F.sum("n")).first()[0] or 0
            if there != wanted:
                raise IndexError_(f"{there} of {wanted} postings were written")
            self.fs.rename(self._path(tmp), self._path(f"{self.folder}/snapshots/{name}"))
            old = self.current
            self._replace("meta.json", json.dumps(asdict(meta)))
            self._replace("CURRENT", name)
            for status in self.fs.listStatus(self._path(f"{self.folder}/snapshots")):
                if status.getPath().getName() not in (name, old):
                    self.fs.delete(status.getPath(), True)
            return name
        finally:
            self.fs.delete(self._path(f"{self.folder}/LOCK"), False)

    def files(self, snapshot: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/snapshots/{snapshot or self.current}/files")

    def _lists(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"kind string, {LISTS}").parquet(path)

    def lists(self, record: IndexRecord, snapshot: str | None = None) -> DataFrame:
        """Blocks of the posting lists of a kind; a gram has a list for each run of files."""
        return self._lists(f"{self.folder}/snapshots/{snapshot or self.current}/postings").where(F.col("kind") == record.name)

    def postings(self, record: IndexRecord, snapshot: str | None = None) -> DataFrame:
        return listed(self.lists(record, snapshot))
