"""The exact tier: whole files, byte offsets, multiline matches, other terminators, binary rules.

One Arrow function a file set; every file is scanned within one row, so limits and context
need no window and also work on streams.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import template
from ..options import BinaryMode, Query
from ..sources.corpus import Corpus, decode
from .search import prefiltered

SCHEMA = "file_id long, path string, seq long, kind string, line_number long, byte_offset long, line string, spans array<struct<start:int,end:int,text:string,replacement:string>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("replacement", pa.string())]))


class Scan:
    """Lines, hits and spans of one file."""

    def __init__(self, q: Query):
        self.q, c = q, q.compiled()
        self.names = c.names
        self.pattern = regex.compile("(?V1)" + c.python)

    def spans(self, text: str) -> list:
        """Leftmost-first; an empty match that touches the match before it is skipped."""
        out, last = [], -1
        for m in self.pattern.finditer(text):
            if m.start() == m.end() == last:
                continue
            out.append(m)
            last = m.end()
        return out

    def file(self, data: bytes, explicit: bool) -> tuple[list[tuple], int | None]:
        """Rows (kind, line_number, byte_offset, line, spans) and the offset of the first NUL."""
        q = self.q
        data = decode(data, q.encoding)
        nul = None
        if not q.null_data and q.binary is not BinaryMode.TEXT:
            at = data.find(b"\0")
            if at >= 0:
                nul = at
                if q.binary is BinaryMode.QUIT and not explicit:
                    data = data[: data.rfind(b"\n", 0, at) + 1]
                else:
                    data = data.replace(b"\0", b"\n")
        text = data.decode("utf-8", "surrogateescape")
        end = "\0" if q.null_data else "\n"
        lines = text.split(end)
        if lines[-1] == "":
            lines.pop()
        size = lambda s: len(s.encode("utf-8", "surrogateescape"))
        starts, chars, at, char = [], [], 0, 0
        for line in lines:
            starts.append(at)
            chars.append(char)
            at += size(line) + 1
            char += len(line) + 1
        found: list[list] = [[] for _ in lines]
        hits = [False] * len(lines)
        skip: set[int] = set()
        if q.multiline:
            import bisect

            count, covered = 0, -1
            for m in self.spans(text):
                if not lines or q.max_count and count >= q.max_count:
                    break
                count += 1
                first = max(bisect.bisect_right(chars, m.start()) - 1, 0)
                last = max(bisect.bisect_left(chars, max(m.end(), m.start() + 1)) - 1, first)
                found[first].append(m)
                for k in range(first, last + 1):
                    hits[k] = True
                    if q.replace is not None and k > first and k > covered:
                        skip.add(k)
                covered = max(covered, last)
            if q.invert:
                hits = [not h for h in hits]
                found = [[] for _ in lines]
        else:
            for k, line in enumerate(lines):
                body = line[:-1] if q.crlf and line.endswith("\r") else line
                found[k] = [] if q.invert else self.spans(body)
                hits[k] = (self.pattern.search(body) is None) if q.invert else bool(found[k])
        rows, accepted, before, open_after, last_row = [], 0, [], 0, -1
        for k, line in enumerate(lines):
            if k in skip:
                continue
            taken = hits[k] and (q.multiline or not q.max_count or accepted < q.max_count)
            kind = None
            if taken:
                accepted += 1
                rows += [("before", j + 1, starts[j], lines[j], []) for j in before if j > last_row]
                before, open_after, kind = [], q.after, "match"
            elif q.passthru:
                kind = "other"
            elif open_after > 0:
                open_after -= 1
                kind = "after"
            elif q.before:
                before = [*before, k][-q.before :]
            if kind:
                base = chars[k] if q.multiline else 0
                shown = [(size(text[chars[k] : m.start()] if q.multiline else line[: m.start()]), 0, m) for m in found[k]] if kind == "match" else []
                spans = [{"start": a, "end": a + size(m[0]), "text": m[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace"), "replacement": template.expand(q.replace, m, self.names) if q.replace is not None else None} for a, _, m in shown]
                out = line
                if spans and q.replace is not None:
                    stop = max(found[k][-1].end() - base, 0)
                    whole, out, at = text[chars[k] :] if q.multiline else line, "", 0
                    for m, s in zip(found[k], spans, strict=True):
                        out += whole[at : m.start() - base] + s["replacement"]
                        at = m.end() - base
                    tail = whole[stop:]
                    out += tail.split(end)[0] if q.multiline and not whole[:stop].endswith(end) else "" if q.multiline else tail
                rows.append((kind, k + 1, starts[k], out.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), spans))
                last_row = k
        return rows, nul


def scan(corpus: Corpus, q: Query) -> DataFrame:
    """The event rows of every file; a binary file with hits gets one more row of kind ``binary``, whose offset is the NUL's."""

    def run(batches):
        scanner = Scan(q)
        for batch in batches:
            out = []
            for i, path, data, explicit in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content", "explicit")), strict=True):
                if data is None:
                    continue
                rows, nul = scanner.file(data, explicit)
                out += [(i, path, n, *r) for n, r in enumerate(rows)]
                if nul is not None and any(r[0] == "match" for r in rows):
                    out.append((i, path, len(rows), "binary", None, nul, None, []))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _TYPE]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    source = corpus.df if q.passthru or q.null_data or not corpus.text else prefiltered(corpus, q)  # a file without hits has no rows
    df = source.select("file_id", "path", F.col("content").cast("binary").alias("content"), F.coalesce("explicit", F.lit(False)).alias("explicit"))
    return df.mapInArrow(run, SCHEMA)


def count_lines(corpus: Corpus, q: Query) -> DataFrame:
    return scan(corpus, q).where("kind = 'match'").groupBy("file_id").agg(F.count("*").alias("hits"))


def count_spans(corpus: Corpus, q: Query) -> DataFrame:
    return scan(corpus, q).where("kind = 'match'").groupBy("file_id").agg(F.sum(F.size("spans")).cast("long").alias("hits")).where("hits > 0")
