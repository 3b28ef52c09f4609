"""Structured Streaming: search of arriving rows, and index refresh after bursts of changes."""

from __future__ import annotations

import hashlib
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import exact
from ..operators import search as S
from ..operators.index import Store
from ..options import Query
from ..sources.corpus import Corpus


def grep(stream: DataFrame, q: Query) -> DataFrame:
    """Matching lines of a stream of (file_id, path, content, explicit); no state.  Limits and context
    take the exact tier, which works within a row."""
    corpus = Corpus(stream)
    if q.max_count or q.before or q.after or q.passthru or not S.is_native(corpus, q):
        return exact.scan(corpus, q)
    return S.grep(corpus, q)


def refresh(stream: DataFrame, store: Store, load, checkpoint: str, debounce: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
    """Updates the index whenever rows arrive: a trigger gathers a burst, batches never overlap.

    load() gives the corpus to index."""

    def rebuild(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            (store.update if store.current else store.build)(load())

    writer = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def fingerprint(root: str) -> str:
    """Of a tree's names, sizes and times: tells edits and removals, which file streams don't."""
    h = hashlib.sha256()
    for folder, names, files in os.walk(root):
        names.sort()
        for f in sorted(files):
            s = os.stat(os.path.join(folder, f))
            h.update(f"{folder}/{f}|{s.st_size}|{s.st_mtime_ns}\n".encode())
    return h.hexdigest()


class Freshness:
    """A snapshot is fresh if it is the current one and the tree hasn't changed since it was taken."""

    def __init__(self, store: Store, root: str):
        self.store, self.root = store, root
        self.snapshot, self.seen = store.current, fingerprint(root)

    def valid(self) -> bool:
        return self.snapshot is not None and self.snapshot == self.store.current and self.seen == fingerprint(self.root)

    def poll(self, load) -> bool:
        """Rebuilds if the tree changed; says whether it did."""
        if self.valid():
            return False
        self.seen = fingerprint(self.root)
        self.snapshot = (self.store.update if self.store.current else self.store.build)(load())
        return True


def stream_counts(stream: DataFrame, q: Query) -> DataFrame:
    """Running hits by file, for update or complete output."""
    return S.grep(Corpus(stream), q).groupBy("file_id").agg(F.count("*").alias("hits"))


def until_idle(query: StreamingQuery, seconds: float = 120.0, step: float = 1.0) -> None:
    """Stops a query that has seen no row for so long; 0: never, it then runs until it ends."""
    last, seen = time.monotonic(), None
    while query.isActive:
        if query.awaitTermination(step):
            return
        busy = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
        if busy[-1:] != seen:
            seen, last = busy[-1:], time.monotonic()
        elif seconds and time.monotonic() - last >= seconds:
            query.stop()
