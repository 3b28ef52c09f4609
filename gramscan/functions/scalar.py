"""The pattern dialect as column functions: match, find, captures, split, replace, pattern sets.

Offsets count bytes.  A group that took no part in a match is an empty string.  Everything is a
native expression, except that patterns which can match the empty string and replacements of the
first n matches go through an Arrow function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.exact import Scan
from ..options import Query
from . import template


class Regex:
    def __init__(self, pattern: str, **options):
        self.q = Query.of(pattern, **options)
        self.c = self.q.compiled()
        self.java = F.lit(self.c.java)

    def is_match(self, text: Column) -> Column:
        return text.rlike(self.c.java)

    def find(self, text: Column) -> Column:
        """start, end and text of the leftmost match, or null."""
        at, found = F.regexp_instr(text, self.java), F.regexp_extract(text, self.c.java, 0)
        start = F.octet_length(F.substring(text, F.lit(1), at - 1))
        return F.when(self.is_match(text), F.struct(start.alias("start"), (start + F.octet_length(found)).alias("end"), found.alias("text")))

    def find_iter(self, text: Column) -> Column:
        """Texts of all matches; an empty match that touches the one before it is skipped."""
        if not self.c.can_be_empty:
            return F.regexp_extract_all(text, self.java, 0)
        q = self.q

        @F.pandas_udf("array<string>")
        def every(texts: pd.Series) -> pd.Series:
            scan = Scan(q)
            return texts.map(lambda t: None if t is None else [m[0] for m in scan.spans(t)])

        return every(text)

    def captures(self, text: Column) -> Column:
        """Groups of the leftmost match, the whole match first, or null."""
        groups = [F.regexp_extract(text, self.c.java, k) for k in range(self.c.groups + 1)]
        return F.when(self.is_match(text), F.array(*groups))

    def captures_iter(self, text: Column) -> Column:
        """Groups of every match; the pattern must not match the empty string."""
        groups = [F.regexp_extract_all(text, self.java, F.lit(k)) for k in range(self.c.groups + 1)]
        return F.transform(groups[0], lambda _, i: F.array(*[F.get(g, i) for g in groups]))

    def split(self, text: Column, pieces: int = -1) -> Column:
        """The texts between matches; at most ``pieces`` of them, the last with the rest, if that is positive."""
        return F.split(text, self.c.java, pieces)

    def replace(self, text: Column, new: str, times: int = 0) -> Column:
        """Every match replaced, or the first ``times``; $1, $name, ${name} and $$ as in searches."""
        if not times and not self.c.can_be_empty:
            return F.regexp_replace(text, self.java, F.lit(template.to_java(new, self.c.groups, self.c.names)))
        q, names = self.q, self.c.names

        @F.pandas_udf("string")
        def some(texts: pd.Series) -> pd.Series:
            scan = Scan(q)

            def change(t: str | None) -> str | None:
                if t is None:
                    return None
                out, at = [], 0
                for m in scan.spans(t)[: times or None]:
                    out += [t[at : m.start()], template.expand(new, m, names)]
                    at = m.end()
                return "".join([*out, t[at:]])

            return texts.map(change)

        return some(text)


def matching(text: Column, *patterns: str, **options) -> Column:
    """Of a set of patterns, the positions of those that match, in order."""
    return F.array_compact(F.array(*[F.when(Regex(p, **options).is_match(text), F.lit(k)) for k, p in enumerate(patterns)]))
