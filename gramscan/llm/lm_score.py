"""Cross-entropy difference between a target and a background bigram model of words.

The target is counted over the documents whose ids are in the target table, the background over all
others.  Both share one vocabulary, all words of the corpus, and its distribution P0(w) = n(w) / n, and have
the same form and size:

    P(w)     = (r c(w) + k P0(w)) / (r c + k)
    P(w | h) = (r c(h w) + k P(w)) / (r c(h) + k)

with k = ``LEAN``, P(w) for a text's first word, and r the smaller model's tokens over the model's own,
so both lean on their backoff alike though one has more text.  A document's score is the mean over its
tokens of ``-log P_target + log P_background``; lower means closer to the target.  No document vouches
for itself: its own counts are taken off the model that it belongs to first.

Tables of words and pairs grow with the corpus, so no task ever holds them all:

1. Tasks cut their rows into chunks of about ``CHUNK`` bytes of text.  A chunk sends each owner one
   sorted list of the hashes in the owner's range (words and pairs) with its counts.
2. An owner adds up its lists and answers each with the totals, in the list's order.  There are three
   times as many owners as input partitions, so an owner has a third of what a partition sends.
3. Answers meet the chunk's texts, whose tokens look their totals up by position.

Texts travel as one compressed block a chunk beside the lists, and nothing else is stored.  If a
task runs again after the loss of an executor, it must cut the same chunks: rows come from a
file scan or a written table, whose order is fixed.  Should a list and its texts differ all the
same, the job fails and gives no wrong score.

A frequent word or pair occurs once in a list, however often the chunk holds it, so no key is hot.
Hashes have 63 bits; a collision, of which a trillion keys have some 60,000, merges two counts.
Lists travel as steps between keys, and all numbers by byte planes, whose high ones are mostly 0
and vanish in the shuffle's compression.

Null and empty texts have no tokens and get the score 0.  Without target rows, or
without others, that model is P0.  Rows that repeat a doc_id count one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, fresh, small
from .textops import NOT_ALNUM, mix, word_runs

_U = np.uint64
#: What the backoff weighs, in tokens.
LEAN = 50.0
#: Bytes of text.
CHUNK = 6 << 20


def pack(x: np.ndarray) -> bytes:
    """By byte planes."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def layout(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row; the sorted keys of all words and pairs; [3, tokens]: places of each token's word, history and pair.

    A text's first word has no history and no pair; their place is the number of keys."""
    got = [(w.hash, np.diff(w.first)) for _, _, w in word_runs(column, NOT_ALNUM)]
    word = np.concatenate([x for x, _ in got]) if got else np.zeros(0, _U)
    size = np.concatenate([x for _, x in got]) if got else np.zeros(0, np.int64)
    later = np.ones(len(word), bool)
    later[(np.cumsum(size) - size)[size > 0]] = False
    words, at_word = np.unique(word & ~_U(1), return_inverse=True)
    second = np.flatnonzero(later)
    pairs, at_pair = np.unique(mix(mix(word[second - 1]) ^ word[second]) | _U(1), return_inverse=True)
    keys = np.concatenate([words, pairs])
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    at = np.full((3, len(word)), len(keys), np.int32)
    at[0] = place[at_word]
    at[1, second] = at[0, second - 1]
    at[2, second] = place[len(words) + at_pair]
    return size, keys[order], at


_FLOW = "lane long, chunk long, owner int, keys binary, n binary, m binary, texts binary"
_NAMES = [c.split()[0] for c in _FLOW.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _flow(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _lists(batches: list[pa.RecordBatch], chunk: int, owners: int) -> pa.Table:
    """A row for each owner, and one with the texts."""
    table = pa.Table.from_batches(batches).combine_chunks()
    block = pa.BufferOutputStream()
    with pa.ipc.new_stream(block, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    size, keys, at = layout(table.column("text"))
    held = lambda of: np.bincount(of[[0, 2]].ravel(), minlength=len(keys))[: len(keys)].astype(np.uint32)
    n, m = held(at), held(at[:, np.repeat(table.column("wanted").to_numpy(), size)])
    owner = (((keys >> _U(32)) * _U(owners)) >> _U(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(owner, prepend=-1, append=owners)).tolist()
    rows = [(-1 - chunk, chunk, None, None, None, None, block.getvalue().to_pybytes())]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        rows.append((int(owner[a]), chunk, int(owner[a]), pack(np.diff(keys[a:b], prepend=_U(0))), pack(n[a:b]), pack(m[a:b]), None))
    return _flow(rows)


def _listed(rows: DataFrame, owners: int) -> DataFrame:
    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            step = max(1, len(batch) * CHUNK // max(batch.column("text").nbytes, 1))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                if held and size + part.column("text").nbytes > CHUNK * 3 // 2:
                    yield from _lists(held, chunk, owners).to_batches()
                    chunk, held, size = chunk + 1, [], 0
                held.append(part)
                size += part.column("text").nbytes
        if held:
            yield from _lists(held, chunk, owners).to_batches()

    return rows.mapInArrow(run, _FLOW)


def _totals(table: pa.Table) -> pa.Table:
    """Of one owner's lists: the sums over all lists, for each list.  Texts pass."""
    if table.column("lane")[0].as_py() < 0:
        return table
    keys = [np.cumsum(unpack(x, _U), dtype=_U) for x in table.column("keys").to_pylist()]
    end = np.cumsum([len(k) for k in keys])
    at = np.unique(np.concatenate(keys), return_inverse=True)[1]
    back = []
    for c in ("n", "m"):
        sums = np.bincount(at, np.concatenate([unpack(x, np.uint32) for x in table.column(c).to_pylist()])).astype(np.int64)[at]
        back.append([pack(sums[a:b]) for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)])
    return _flow([(o, k, o, None, n, m, None) for o, k, n, m in zip(table.column("owner").to_pylist(), table.column("chunk").to_pylist(), *back, strict=True)])


def losses(n: np.ndarray, n_all: float, target: np.ndarray, of_target: np.ndarray, background: np.ndarray, of_background: np.ndarray, ratio: tuple[float, float]) -> np.ndarray:
    """-log P_target + log P_background of tokens.

    n: counts of their words, of n_all; target, background: [3, tokens] counts of word, history, pair, and the models' tokens."""

    def model(c: np.ndarray, total: np.ndarray, r: float) -> np.ndarray:
        lower = (r * c[0] + LEAN * n / n_all) / (r * total + LEAN)
        return np.log((r * c[2] + LEAN * lower) / (r * c[1] + LEAN))

    return model(background, of_background, ratio[1]) - model(target, of_target, ratio[0])


def own_counts(at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often the document itself holds the word, history and pair of each of its tokens."""
    out = np.zeros(at.shape, np.int64)
    later = np.flatnonzero(row[1:] == row[:-1]) + 1
    for k, some in ((0, np.arange(len(row))), (2, later)):
        _, back, times = np.unique(row[some] << 32 | at[k, some], return_inverse=True, return_counts=True)
        out[k, some] = times[back]
    out[1, later] = out[0, later - 1]
    return out


def _scored(n_all: int, m_all: int):
    rest = n_all - m_all
    ratio = (min(1.0, rest / m_all) if m_all and rest else 1.0, min(1.0, m_all / rest) if m_all and rest else 1.0)

    def run(table: pa.Table) -> pa.Table:
        blocks = [x for x in table.column("texts").to_pylist() if x is not None]
        docs = pa.ipc.open_stream(blocks[0]).read_all().combine_chunks()
        size, keys, at = layout(docs.column("text"))
        answers = table.filter(pa.compute.is_valid(table.column("owner"))).sort_by("owner")
        n, m = (np.concatenate([*(unpack(x, np.int64) for x in answers.column(c).to_pylist()), [0]]) for c in ("n", "m"))
        if len(blocks) != 1 or len(n) != len(keys) + 1:
            raise RuntimeError("a chunk's lists aren't those of its texts: the rows' order changed between attempts")
        row = np.repeat(np.arange(len(size)), size)
        own, wanted = own_counts(at, row), docs.column("wanted").to_numpy()[row]
        target, background = m[at], (n - m)[at]
        target -= own * wanted
        background -= own * ~wanted
        each = losses(n[at[0]], max(n_all, 1), target, m_all - wanted * size[row], background, rest - ~wanted * size[row], ratio)
        mean = np.bincount(row, each, len(size)) / np.maximum(size, 1)
        return pa.table([docs.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(mean)], names=["doc_id", "n_tokens", "ce_diff"])

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    """Tokens of all rows and of the target's."""

    def run(batches):
        for batch in batches:
            n, m, wanted = 0, 0, batch.column("wanted").to_numpy(zero_copy_only=False)
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                n += len(w.hash)
                m += int(np.diff(w.first)[wanted[lo:hi]].sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m])], names=["n", "m"])

    return rows.mapInArrow(run, "n long, m long").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_diff for every row; target: doc_id of the documents that are wanted more of."""
    spark, rows = docs.sparkSession, fresh(docs, "doc_id", "text")
    owners = 3 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = target.select(F.col("doc_id"), F.lit(True).alias("wanted")).where("doc_id is not null").distinct()
    n_ids = ids.count()
    rows = rows.join(small(ids, n_ids, 16), "doc_id", "left").select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    if n_ids * 16 > BROADCAST_BYTES:  # the join shuffled the rows: fix their order
        rows = Scratch(spark, "lm").write(rows)
    total = _sizes(rows).first()
    answers = _listed(rows, owners).groupBy("lane").applyInArrow(_totals, _FLOW)
    return answers.groupBy("chunk").applyInArrow(_scored(total["n"] or 0, total["m"] or 0), f"doc_id {kind}, n_tokens long, ce_diff double")
