"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs to a ``noop`` sink twice; the second time counts."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gramscan import queries
from gramscan.operators import index
from gramscan.operators import search as S
from gramscan.options import Query
from gramscan.plans import planner
from gramscan.sources.corpus import Corpus

HEADLINE = ["grep_literal", "grep_word", "grep_regex_required_literal", "grep_multi_pattern", "grep_alternation_ignore_case", "grep_unicode_class", "grep_no_literal", "files_with_matches", "count_lines", "only_matching", "context_before_after", "byte_offsets", "search_stats", "gram_index"]


def timed(df) -> float:
    begin = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, out = queries.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            out[name] = round(timed(known[name](spark, sf)), 3)
    corpus = Corpus.from_table(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    store = index.Store(spark, f"file://{tempfile.mkdtemp()}/index")
    begin = time.perf_counter()
    store.build(corpus)
    out["index_build"] = round(time.perf_counter() - begin, 3)
    for name, q in (("indexed_literal", Query.of("idiot")), ("indexed_regex", Query.of(r"[a-z]+ (?:MIT|Apache) License"))):
        for _ in range(2):
            out[name] = round(timed(S.grep(planner.plan(corpus, q, store).narrowed(), q)), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
