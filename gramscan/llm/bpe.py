"""Byte-level BPE with word ends, encoded through a pair occurrence index.

All new words of a block of a partition's texts are laid out in one row of symbols, and an index maps each
pair that a merge exists for, by the merge's rank, to all its positions.  The lowest active rank
is taken next: it is applied at its positions from left to right, and each merge adds the pairs that it makes with its
neighbours to their lists.  A position whose pair another merge has taken is passed over.  Should
a merge make a pair of a lower rank than its own, that comes first, as in a queue of single merges.

Words repeat, so results are kept in a bounded table, which a task gives back at its end; a
batch encodes only words that the table lacks.  Texts are read whole; null is an empty text.  There is no shuffle.

Text before BPE, as the tokenizer file prescribes: special tokens are cut out, then NFC,
runs of white space as one space, lower case, words by the file's pattern, bytes as printable
characters.  All of it acts within a stretch without white space, so stretches are the unit
that is looked up.  Decoding without a decoder in the file joins the tokens by a space.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import fresh
from .textops import raw, release, runs

#: Stretches of a generation that a task remembers; it has two, and what is met again moves to the young one.
REMEMBERED = 100_000
#: Texts that are encoded together, about; a longer text stands alone.
BLOCK_BYTES = 1 << 19
_NONE = np.int32(2**31 - 1)
_GAP = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.digits = {i: str(i) for i in self.names}
        self.end = model["end_of_word_suffix"] or ""
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault(self.vocab[x] << 20 | self.vocab[y], (rank, self.vocab[x + y]))
        self.merges = {key: rank for key, (rank, _) in merges.items()}
        self.left, self.right, self.made = ([0] * len(model["merges"]) for _ in range(3))
        for key, (rank, made) in merges.items():
            self.left[rank], self.right[rank], self.made[rank] = key >> 20, key & 0xFFFFF, made
        self.pair_keys = np.array(sorted(merges), np.int64)
        self.pair_ranks = np.array([merges[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.inner, self.final = (np.array([self.vocab[c + e] for c in byte_characters()], np.int32) for e in ("", self.end))
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = "[\\p{L}]+" in self.pattern.pattern.split("|")  # a run of letters is a word
        self.remembered = REMEMBERED
        self.forget()

    def split(self, stretch: str, special: bool = True) -> list[str | int]:
        """Words of a stretch without white space; special tokens, if it may hold any, as their ids."""
        out: list[str | int] = []
        for part in self.cut.split(stretch) if special and self.cut else [stretch]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                if self.letters and part.isalpha():
                    out.append(part.lower())
                elif part:
                    out += self.pattern.findall(part.lower())
            else:
                out += self.pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", part))))
        return out

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        if not words:
            return []
        data = [w.encode("utf-8") for w in words]
        buf = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        symbols = self.inner[buf]
        symbols[ends - 1] = self.final[buf[ends - 1]]
        rank = self.ranks(symbols)
        rank[ends - 1] = _NONE
        at = np.flatnonzero(rank != _NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at], prepend=-1))
        index = dict(zip(rank[at[cut]].tolist(), (x.tolist() for x in np.split(at, cut[1:])), strict=True)) if len(at) else {}
        active = list(index)  # ascending, hence a heap
        sym = symbols.tolist()
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        for x in ends.tolist():
            after[x - 1] = -1
            if x < len(sym):
                before[x] = -1
        ranks, made, left, right = self.merges, self.made, self.left, self.right
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            places.sort()
            x, y, new = left[r], right[r], made[r]
            for k, p in enumerate(places):
                q = after[p]
                if sym[p] != x or q < 0 or sym[q] != y:
                    continue
                sym[p], sym[q] = new, -1
                n, b, lower = after[q], before[p], False
                after[p] = n
                if n >= 0:
                    before[n] = p
                    got = ranks.get(new << 20 | sym[n])
                    if got is not None:
                        lower = got < r
                        if got in index:
                            index[got].append(p)
                        else:
                            index[got] = [p]
                            heapq.heappush(active, got)
                if b >= 0:
                    got = ranks.get(sym[b] << 20 | new)
                    if got is not None:
                        lower |= got < r
                        if got in index:
                            index[got].append(b)
                        else:
                            index[got] = [b]
                            heapq.heappush(active, got)
                if lower and k + 1 < len(places):
                    rest = index.setdefault(r, [])
                    if not rest:
                        heapq.heappush(active, r)
                    rest += places[k + 1 :]
                    break
        out, lo = [], 0
        for hi in ends.tolist():
            out.append([s for s in sym[lo:hi] if s >= 0])
            lo = hi
        return out

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of the pair at each position; _NONE where no merge fits."""
        key = np.append(symbols[:-1].astype(np.int64) << 20 | symbols[1:], -1)
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], _NONE)

    def forget(self) -> None:
        self.known: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.old_known, self.old_words = {}, {}

    def lacking(self, of: set[str], known: dict, old: dict) -> set[str]:
        """Those that neither table has; what only the old one has moves to the other."""
        rest = of - known.keys()
        again = rest & old.keys()
        known.update((x, old[x]) for x in again)
        return rest - again

    def learn(self, stretches: list[str]) -> None:
        joined = "\n".join(stretches)
        special = any(x in joined for x in self.special)
        parts = [self.split(s, special) for s in stretches]
        new = list(self.lacking({w for p in parts for w in p if isinstance(w, str)}, self.words, self.old_words))
        names, digits, words, known = self.names, self.digits, self.words, self.known
        for w, ids in zip(new, self.merge(new), strict=True):
            words[w] = len(ids), " ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids])
        for s, p in zip(stretches, parts, strict=True):
            if len(p) == 1 and isinstance(p[0], str):
                known[s] = words[p[0]]
            else:
                got = [words[w] if isinstance(w, str) else (1, digits[w], names[w]) for w in p]
                n, ids, text = zip(*got, strict=True) if got else ((), (), ())
                known[s] = sum(n), " ".join(ids), " ".join(text)

    def encode(self, texts: list[str], simple: bool = False) -> list[tuple[int, str, str]]:
        """(tokens, ids by spaces, decoded text) of each text; simple: Python's own split is exact here."""
        cut = [t.split() if simple else [s for s in _GAP.split(t) if s] for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.old_known = {}, self.known
        if len(self.words) > self.remembered:
            self.words, self.old_words = {}, self.words
        new = self.lacking(set().union(*cut), self.known, self.old_known)
        if new:
            self.learn(list(new))
        known, out = self.known, []
        for stretches in cut:
            if stretches:
                n, ids, text = zip(*map(known.__getitem__, stretches), strict=True)
                out.append((sum(n), " ".join(ids), " ".join(text)))
            else:
                out.append((0, "", ""))
        return out


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids: and ids, decoded.

    path: the tokenizer file, at the same place on every executor; remembered: stretches of a
    generation, which trades memory for time and changes no result."""
    rows = fresh(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        collecting = gc.isenabled()
        gc.disable()  # the tables hold no cycles, and walking them again and again takes a fifth of the time
        try:
            yield from encoded(batches)
        finally:
            if collecting:
                gc.enable()

    def encoded(batches):
        bpe = loaded(path)
        bpe.remembered = remembered
        for batch in batches:
            column = batch.column("text")
            buf, offsets = raw(column)
            for lo, hi in runs(offsets, BLOCK_BYTES):
                block = buf[offsets[lo] : offsets[hi]]
                # white space to split() but not to Unicode: 0x1C-0x1F
                simple = not bool(((block >= 0x1C) & (block <= 0x1F)).any())
                got = bpe.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()], simple)
                n = pa.array([g[0] for g in got], pa.int64())
                columns = [batch.column("doc_id").slice(lo, len(got)), n, *[pa.array([hashlib.sha256(g[k].encode("utf-8")).hexdigest() for g in got], pa.string()) for k in (1, 2)]]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
