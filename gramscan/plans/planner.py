"""Which files a search looks at: discovery, narrowing, and an account of both."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import search as S
from ..options import Query
from ..sources.corpus import Corpus


class Discovery(Enum):
    EMPTY = "empty"
    WALK = "walk"
    INDEX = "index"
    MERGE = "merge"


class Coverage(Enum):
    COMPLETE = "complete"
    POTENTIAL = "potential matches"


def coverage_of(mode: str, include_zero: bool = False) -> Coverage:
    return Coverage.COMPLETE if mode in ("files_without_match", "paths") or include_zero else Coverage.POTENTIAL


def discover(scope: str, need: Coverage, indexed: bool, narrowing: bool, meta: I.Meta | None, covers: bool, fresh: bool) -> tuple[Discovery, str]:
    """(source, admission): full rules, or only those that an index hasn't applied."""
    if scope == "streams":
        return Discovery.EMPTY, "full"
    if scope == "walk" or not indexed:
        return Discovery.WALK, "full"
    if need is Coverage.POTENTIAL and not narrowing:
        return Discovery.WALK, "full"
    if meta is None:
        return Discovery.INDEX, "full"
    if not covers:
        return Discovery.WALK, "full"
    if need is Coverage.COMPLETE:
        return (Discovery.WALK, "full") if meta.coverage == "lazy" or not fresh else (Discovery.INDEX, "indexed")
    return (Discovery.INDEX if meta.coverage == "complete" else Discovery.MERGE), "indexed"


@dataclass
class Plan:
    corpus: Corpus
    q: Query
    discovery: Discovery = Discovery.WALK
    admission: str = "full"  # or "indexed": hidden and ignore rules were applied when the index was built
    kind: str | None = None
    literals: object = None
    candidates: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def narrowed(self) -> Corpus:
        """The corpus that is left to scan."""
        if self.candidates is None:
            return self.corpus
        return Corpus(self.corpus.df.join(self.candidates, "file_id", "left_semi"), self.corpus.text)

    def explain(self) -> dict:
        return {"discovery": self.discovery.value, "admission": self.admission, "kind": self.kind, "literals": self.literals, "tier": "native" if S.is_native(self.corpus, self.q) else "exact", "narrowed": self.candidates is not None, "notes": self.notes}


def plan(corpus: Corpus, q: Query, store: I.Store | None = None, mode: str = "lines", include_zero: bool = False, walk: dict | None = None, scopes: list[str] | None = None, fresh: bool = True, transformed: bool = False) -> Plan:
    need = coverage_of(mode, include_zero)
    literals, folded = S.requirement(q, corpus.text)
    narrowing = literals is not None and not transformed
    meta = store.meta if store and store.current else None
    how, admission = discover("index", need, bool(store and store.current), narrowing, meta, bool(meta and meta.covers(walk or {}, scopes or [])), fresh)
    out = Plan(corpus, q, how, literals=literals, admission=admission)
    if how in (Discovery.INDEX, Discovery.MERGE) and need is Coverage.POTENTIAL:
        norm = "ascii-lower" if folded else "identity"
        sets = []
        for record in map(I.IndexRecord.parse, meta.kinds if meta else [r.name for r in I.DEFAULT]):
            if record.norm == norm and (got := I.candidates(store.lists(record), store.files(), literals, record)) is not None:
                sets.append((record.name, got))
        if not sets:
            out.notes.append("no index kind restricts the pattern")
        else:
            ids = sets[0][1]
            for _, other in sets[1:]:
                ids = ids.join(other, "file_id", "left_semi")
            if how is Discovery.MERGE or not fresh:
                # unknown files, and if the snapshot may be stale those whose content changed since
                key = ["file_id"] if fresh else ["file_id", "mark"]
                now = I.files_of(corpus) if not fresh else corpus.df
                ids = ids.unionByName(now.select(*key).join(store.files().select(*key), key, "left_anti").select("file_id")).distinct()
            out.candidates, out.kind = ids, ",".join(n for n, _ in sets)
    return out


def narrow_in_place(corpus: Corpus, q: Query, record: I.IndexRecord | None = None) -> DataFrame | None:
    """Candidates by an index that is computed on the fly (no store)."""
    literals, folded = S.requirement(q, corpus.text)
    if literals is None:
        return None
    record = record or I.IndexRecord(norm="ascii-lower" if folded else "identity")
    files = corpus.df.select("file_id", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"))
    return I.candidates(I.posting_lists(corpus, [record]), files, literals, record)
