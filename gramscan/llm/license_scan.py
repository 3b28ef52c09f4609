"""Licence scans: base phrases, and templates compiled into token automata.

A template is wording with marks: ``[words]`` may be missing, ``<n>`` stands for up to n
words of any kind (a name, a year), also within an optional region.  It is compiled into an automaton over word
hashes that accepts a stretch of text only if all mandatory words occur, exactly and in order, with nothing else
between them; its states are the bits of one number.  Whole licence texts and the notices that licences prescribe
are templates (``licenses``).  Every place where a template can begin is tried, in rows that hold its longest mandatory word.

Base labels come from phrases whose words stand consecutively; each place counts.  Base
phrases and templates are few and fixed, so there is no shuffle; texts are read whole.
Words: letters, digits and non-ASCII characters after lower-casing A-Z.  Null and empty texts have no words.

score: 1 if a template is accepted, otherwise places / (places + 1).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .licenses import TEMPLATES
from .shared import fresh
from .textops import NOT_ALNUM, Words, hash_of, word_runs

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_PART = re.compile(r"\[|\]|<\d+>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Bit i of a state number says that the first i items of the template are done."""

    def __init__(self, template: str):
        self.words: list[str] = []  # "" for any word
        jumps: list[tuple[int, int]] = []  # items from one place to another may be left out
        open_at: list[int] = []
        optional: set[int] = set()
        for part in _PART.findall(re.sub("[A-Z]", lambda m: m[0].lower(), template)):
            at = len(self.words)
            if part == "[":
                open_at.append(at)
            elif part == "]":
                begin = open_at.pop()
                jumps.append((begin, at))
                optional |= set(range(begin, at))
            elif part[0] == "<":
                n = int(part.strip("<>"))
                self.words += [""] * n
                jumps += [(k, at + n) for k in range(at, at + n)]
            else:
                self.words.append(part)
        self.last = len(self.words)
        self.jumps = sorted(jumps)
        self.leaving = sum({1 << a for a, _ in jumps})
        self.any = sum(1 << k for k, w in enumerate(self.words) if not w)
        self.after: dict[int, int] = {}
        named = [k for k, w in enumerate(self.words) if w]
        for k, h in zip(named, hash_of([self.words[k] for k in named]).tolist(), strict=True):
            self.after[h] = self.after.get(h, 0) | 1 << k
        self.mandatory = [self.words[k] for k in named if k not in optional]
        self.start = self.closed(1)
        self.first = {h for h, bits in self.after.items() if bits & self.start}
        self.begins_anyhow = bool(self.start & self.any)

    def closed(self, states: int) -> int:
        """With what can be reached without a word; jumps only lead ahead."""
        if states & self.leaving:
            for a, b in self.jumps:
                if states >> a & 1:
                    states |= 1 << b
        return states

    def accepts(self, hashes: list[int], at: int) -> int | None:
        """End of the longest accepted stretch that begins at ``at``."""
        states, best = self.start, None
        for i in range(at, len(hashes) + 1):
            if states >> self.last & 1:
                best = i
            if i == len(hashes) or not states:
                break
            states = self.closed((states & (self.any | self.after.get(hashes[i], 0))) << 1)
        return best


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(hash_of(p.split()), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, t in templates.items()]
        self.keys = [hash_of([max(a.mandatory, key=len)])[0] for _, a in self.automata]

    def scan(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]], list[set[str]]]:
        places, lowest, highest = np.zeros(w.rows, np.int64), np.full(w.rows, -1), np.full(w.rows, -1)
        base: list[set[str]] = [set() for _ in range(w.rows)]
        more: list[set[str]] = [set() for _ in range(w.rows)]
        n = len(w.hash)
        for phrase, label in self.phrases:
            k = len(phrase)
            if n < k:
                continue
            at = np.flatnonzero(w.hash[: n - k + 1] == phrase[0])
            for j in range(1, k):
                at = at[w.hash[at + j] == phrase[j]]
            at = at[w.row[at] == w.row[at + k - 1]]
            rows = w.row[at]
            places += np.bincount(rows, minlength=w.rows)
            word = at - w.first[rows]
            for r, x in zip(rows.tolist(), word.tolist(), strict=True):
                base[r].add(label)
                lowest[r] = x if lowest[r] < 0 else min(lowest[r], x)
                highest[r] = max(highest[r], x)
        for (label, automaton), key in zip(self.automata, self.keys, strict=True):
            has = np.unique(w.row[w.hash == key])
            first = np.array(list(automaton.first), np.uint64)
            for r in has.tolist():
                hashes = w.hash[w.first[r] : w.first[r + 1]]
                words = hashes.tolist()
                start = range(len(words)) if automaton.begins_anyhow else np.flatnonzero(np.isin(hashes, first)).tolist()
                if any(automaton.accepts(words, x) is not None for x in start):
                    more[r].add(label)
        return places, lowest, highest, base, more


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    rows = fresh(docs, "doc_id", "text")

    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for lo, hi, w in word_runs(batch.column("text"), NOT_ALNUM):
                places, lowest, highest, base, more = scanner.scan(w)
                none = places == 0
                score = np.where([bool(m) for m in more], 1.0, places / (places + 1))
                labels = [",".join(sorted(a | b)) for a, b in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(places), pa.array(lowest, pa.int64(), mask=none), pa.array(highest, pa.int64(), mask=none), pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
