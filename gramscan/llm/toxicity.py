"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary labelled texts, give each
document two log-likelihoods.  Their difference a word is the only input of the score, which
grows with it along a logistic curve.

    P_c(w | h) = max(c_c(h w) - D, 0) / (c_c(h .) + K) + g_c(h) P_c(w)
    P_c(w)     = max(N_c(. w) - D, 0) / N_c(. .) + l_c P(w)

``N_c`` counts distinct predecessors within a class (the text's start is one) and ``c_c`` the documents that
hold an expression, so that one long text that repeats itself counts once.  ``l_c`` is the share
that discounting frees.  The shared backoff ``P`` comes from both classes together.

An expression has counts of its own in the class models only if these show that it is at least
``RATIO`` times as likely in one class as in the other; a rare or even one goes to the shared backoff
in both models, and cancels.  "Show" means that the probability of such counts under a lesser
preference is below 1 / (number of expressions), by Chernoff's bound, so about one expression passes by
chance however many there are.  For a pair the preference is measured against that of its history.  A word without counts of its own goes to its longest beginning (``STEMS`` bytes, whole
characters) that has them, counted over such words, so inflected and compounded forms share
the counts of their stem; then to the shared backoff.

The classifier is fitted on a bounded sample: at most ``rows_per_class`` labelled rows of each class
(the smallest hashes of doc_id); every expression of their whole texts is counted.  Three
quarters of them are counted, the others place the curve.  Expressions are counted and tested where they
are; only those with counts of their own reach the driver and go to the executors, and
every row of the table is scored over its whole text, without a shuffle.

Inputs of a score: the text only.  Null and empty texts have no words and get the score of a text without
expressions of its own counts.  Without labels of both classes each score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, keep_rows, small
from .textops import NOT_ALNUM, Words, mix, signed, word_runs

DISCOUNT = 0.75
#: How many sightings of a history weigh as much as its backoff.
SHARED = 5.0
#: How much likelier in one class an expression must be, to have counts of its own.
RATIO = 2.0
#: Of the logistic curve, for each row.
RIDGE = 1e-3
#: Lengths in bytes of the beginnings that words back off to, the longest first.
STEMS = (9, 8, 7, 6, 5, 4, 3)
#: Differences a word below this are near 0 to the curve: it bends there.
UNIT = 1e-3
#: The history of a text's first word.
START = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def stems(w: Words, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of the given words, and which of them have a whole character end there."""
    end = w.start[at] + size
    at = at[(end == w.end[at]) | (end < w.end[at]) & (w.buf[np.minimum(end, len(w.buf) - 1)] & 0xC0 != 0x80)]
    return mix(w.span(w.start[at], w.start[at] + size) ^ np.uint64(size)), at


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands; the number of sorted keys for others."""
    v = len(sorted_keys)
    if not v:
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), v - 1)
    return np.where(sorted_keys[at] == keys, at, v)


@dataclass
class Model:
    vocab: np.ndarray  # sorted hashes of words and beginnings
    own: np.ndarray  # [words + 1]: whether it has counts of its own, the last is false
    word: np.ndarray  # [2, words + 1]: P_c(w), the last over P(w) for unknown words
    back: np.ndarray  # [2, words + 1]: g_c(h)
    pairs: np.ndarray  # sorted h * (words + 1) + w
    pair: np.ndarray  # [2, pairs + 1]: the share beside the backoff, the last is 0
    curve: np.ndarray  # of 1 and bend()

    @property
    def base(self) -> float:
        """The difference a word of texts without expressions of their own."""
        return float(np.log(self.word[1, -1]) - np.log(self.word[0, -1]))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its size for unknown ones."""
        return place(self.vocab, h)

    def units(self, w: Words, ids: np.ndarray) -> np.ndarray:
        """Of each word its place, or that of its longest beginning with counts of its own if it has none."""
        out = ids.copy()
        for size in STEMS:
            h, at = stems(w, size, np.flatnonzero(~self.own[out] & (w.end - w.start >= size)))
            found = self.ids(h)
            out[at] = np.where(self.own[found], found, out[at])
        return out

    def likelihoods(self, w: Words) -> np.ndarray:
        """[2, words]: log P_c of each word; of unknown words less log P(w)."""
        v, ids = len(self.vocab), self.ids(w.hash)
        p = self.word[:, self.units(w, ids)]
        first = w.first[:-1][np.diff(w.first) > 0]
        history = np.append(v, ids[:-1]) if len(ids) else ids
        history[first] = self.ids(np.array([START]))[0]
        at = place(self.pairs, history * (v + 1) + ids)
        return np.log(self.pair[:, at] + self.back[:, history] * p)

    def difference(self, w: Words) -> np.ndarray:
        """By row: log-likelihood toxic less ordinary, a word."""
        each = self.likelihoods(w)
        sums = np.append(0, np.cumsum(each[1] - each[0] - self.base))
        return (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(np.diff(w.first), 1) + self.base

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, w in word_runs(column, NOT_ALNUM):
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(bend(self.difference(w) - self.base) @ self.curve, -500, 500)))
        return out


def bend(difference: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(difference), np.arcsinh(difference / UNIT)], axis=1)


def _documents(h: np.ndarray, x: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (h, x) with the ordinary and the toxic documents that hold them."""
    order = np.lexsort((rows, x, h))
    h, x, rows = h[order], x[order], rows[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (rows[1:] != rows[:-1])
    h, x, y = h[once], x[once], toxic[rows[once]]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]))) if len(h) else np.zeros(0, np.int64)
    n, n1 = np.diff(np.append(at, len(h))), np.add.reduceat(y, at) if len(at) else y
    return h[at], x[at], (n - n1).astype(np.int64), n1.astype(np.int64)


_COUNTS = "h long, w long, n0 long, n1 long"


def _summed(sample: DataFrame, expressions) -> DataFrame:
    """h, w, n0, n1 over (text, toxic); expressions(words) gives arrays (h or None, w, index of the word)."""

    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                for h, x, at in expressions(w):
                    a, b, n0, n1 = _documents(np.zeros(len(x), np.uint64) if h is None else h, x, w.row[at], toxic[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if h is None else pa.array(signed(a)), *map(pa.array, (signed(b), n0, n1))], names=["h", "w", "n0", "n1"])

    return sample.select("text", "toxic").mapInArrow(run, _COUNTS).groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def words_and_pairs(w: Words):
    history = np.append(START, w.hash[:-1])[: len(w.hash)]
    history[w.first[:-1][np.diff(w.first) > 0]] = START
    every = np.arange(len(w.hash))
    yield None, w.hash, every
    yield history, w.hash, every


def beginnings(known: np.ndarray):
    """Of the words that aren't known."""

    def of(w: Words):
        rest = np.flatnonzero(place(known, w.hash) == len(known))
        for size in STEMS:
            x, at = stems(w, size, rest[(w.end - w.start)[rest] >= size])
            yield None, x, at

    return of


def shown(odds: Column, expressions: int) -> Column:
    """Whether counts n0, n1 show a preference of RATIO over the given odds of n1."""
    n = F.col("n0") + F.col("n1")
    f = F.col("n1") / n

    def unlikely(odds: Column) -> Column:
        p = odds / (1 + odds)
        part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
        return n * (part(f, p) + part(1 - f, 1 - p)) > F.log(F.lit(float(max(expressions, 2))))

    more, less = odds * RATIO, odds / RATIO
    return (f > more / (1 + more)) & unlikely(more) | (f < less / (1 + less)) & unlikely(less)


def _frame(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def lower_order(seen: np.ndarray, totals: np.ndarray, types: np.ndarray) -> np.ndarray:
    """[2, expressions]: P_c from their counts [2, expressions], the counts of all, and how many have any."""
    totals = np.maximum(totals.astype(float), 1)
    shared = seen.sum(0) / totals.sum()
    return np.maximum(seen - DISCOUNT, 0) / totals[:, None] + (DISCOUNT * np.maximum(types, 1) / totals)[:, None] * shared


def higher_order(counts: np.ndarray, history: np.ndarray) -> np.ndarray:
    """[2, pairs]: shares of pairs from their counts and those of their histories."""
    return np.maximum(counts - DISCOUNT, 0) / (history + SHARED)


def assemble(words: dict, beginning: dict, pairs: dict) -> Model:
    """words, beginning: w, p ([2, n]); pairs: h, w, share ([2, n])."""
    keys = [x.view(np.uint64) for x in (words["w"], beginning["w"], pairs["h"], pairs["w"])]
    vocab = np.unique(np.concatenate(keys))
    v = len(vocab)
    own, word = np.zeros(v + 1, bool), np.zeros((2, v + 1))
    for x in (words, beginning):
        at = place(vocab, x["w"].view(np.uint64))
        own[at], word[:, at] = True, x["p"]
    left = np.maximum(1 - word.sum(1), 1e-6)[:, None]  # for all other words together
    word[:, ~own] = left
    h, x = place(vocab, keys[2]), place(vocab, keys[3])
    even = ~own[x]
    word[:, x[even]] = left * pairs["shared"][even]
    key = h * (v + 1) + x
    by = np.argsort(key)
    back, share = np.ones((2, v + 1)), np.zeros((2, len(key) + 1))
    share[:, :-1] = pairs["share"][:, by]
    for c in (0, 1):
        np.subtract.at(back[c], h, pairs["share"][c])
    return Model(vocab, own, word, back, key[by], share, np.zeros(2))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Newton steps of a weighted logistic regression with a small ridge."""
    mean, width = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.column_stack([x[:, 0], (x[:, 1:] - mean) / width])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(b)), z.T @ (weight * (y - p)) - ridge * len(y) * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    b[1:] /= width
    b[0] -= (b[1:] * mean).sum()
    return b

def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 5000) -> Model | None:
    """None unless both classes have labelled rows with a text.  A doc_id labelled more than once is toxic if any label says so."""
    scratch = Scratch(docs.sparkSession, "toxic")
    known = fresh(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    chosen = some[0].union(some[1]).withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) == 0)
    sample = scratch.write(fresh(docs, "doc_id", "text").join(small(chosen, 2 * rows_per_class, 64), "doc_id").select("text", "toxic", "curve"))
    counted = sample.where("not curve")
    counts = scratch.write(_summed(counted, words_and_pairs))
    single, pairs = counts.where("h is null"), counts.where("h is not null")
    each = single.agg(F.count("*").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    of_pairs = pairs.agg(F.count("*").alias("n"), F.sum((F.col("n0") > 0).cast("long")).alias("n0"), F.sum((F.col("n1") > 0).cast("long")).alias("n1")).first()
    if not (each["n0"] and each["n1"]):
        return None
    before = pairs.groupBy("w").agg(F.sum((F.col("n0") > 0).cast("long")).alias("d0"), F.sum((F.col("n1") > 0).cast("long")).alias("d1"))
    types = single.agg(F.sum((F.col("n0") > 0).cast("long")).alias("n0"), F.sum((F.col("n1") > 0).cast("long")).alias("n1")).first()
    both = lambda row: np.array([row["n0"], row["n1"]], float)
    odds = F.lit(each["n1"] / each["n0"])
    words = _frame(single.where(shown(odds, each["n"])).drop("h").join(before, "w").select("w", "d0", "d1"))
    words["p"] = lower_order(np.stack([words["d0"], words["d1"]]).astype(float), both(of_pairs), both(types))
    starts = scratch.write(_summed(counted, beginnings(np.sort(words["w"].view(np.uint64)))))
    beginning = _frame(starts.where(shown(odds, starts.count())).select("w", "n0", "n1"))
    beginning["p"] = lower_order(np.stack([beginning["n0"], beginning["n1"]]).astype(float), both(each), both(types))

    history = pairs.groupBy("h").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    prior = each["n1"] / (each["n0"] + each["n1"])
    expected = (F.col("s1") + prior) / (F.col("s0") + 1 - prior)
    placed = pairs.join(history, "h").where(shown(expected, of_pairs["n"])).join(before, "w")
    found = _frame(placed.select("h", "w", "n0", "n1", "s0", "s1", "d0", "d1"))
    found["share"] = higher_order(*(np.stack([found[f"{c}0"], found[f"{c}1"]]).astype(float) for c in "ns"))
    found["shared"] = (found["d0"] + found["d1"]) / both(of_pairs).sum()
    model = assemble(words, beginning, found)

    def measure(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                yield pa.RecordBatch.from_arrays([pa.array(model.difference(w)), pa.array(toxic[lo:hi])], names=["x", "y"])

    seen = _frame(sample.where("curve").select("text", "toxic").mapInArrow(measure, "x double, y double"))
    if not {0.0, 1.0} <= set(seen["y"]):
        return None
    y = seen["y"]
    weight = np.where(y == 1, share[1] / max(y.sum(), 1), share[0] / max((1 - y).sum(), 1))
    model.curve = logistic(bend(seen["x"] - model.base), y, weight / weight.mean())
    model.curve[1] = max(model.curve[1], 0.0)  # a likelier toxic text never scores lower
    return model


def _scores(model: Model | None):
    if model is None:
        return lambda column: np.zeros(len(column))
    return model.scores


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row; no shuffle."""
    of = _scores(model)

    def run(batches):
        for batch in batches:
            x = of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x), pa.array((x >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = fresh(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    of = _scores(model)
    return keep_rows(docs, lambda batch: of(batch.column("text")) < threshold)
