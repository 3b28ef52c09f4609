"""Text lines and JSON Lines of event rows, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unescape(text: str) -> str:
    r"""Separators may hold \n, \t, \0 and \\."""
    return text.replace("\\\\", "\1").replace("\\n", "\n").replace("\\t", "\t").replace("\\0", "\0").replace("\1", "\\")


def text(events: DataFrame, filename: bool = True, line_number: bool = True, offset: bool = False, column: bool = False, heading: bool = False, null: bool = False, match_separator: str = ":", context_separator: str = "-", break_separator: str | None = "--", trim: bool = False, max_columns: int | None = None, preview: bool = False) -> DataFrame:
    """file_id, seq, rendered: one row for each printed line, in (file_id, seq) order."""
    sep = F.when(F.col("kind") == "match", F.lit(unescape(match_separator))).otherwise(F.lit(unescape(context_separator)))
    body: Column = F.regexp_replace("line", r"^[ \t\n\x0B\f\r]+", "") if trim else F.col("line")
    if max_columns:
        short = F.concat(F.substring(body, 1, max_columns), F.lit(" [... omitted end of long line]")) if preview else F.when(F.col("kind") == "match", F.lit("[Omitted long matching line]")).otherwise(F.lit("[Omitted long context line]"))
        body = F.when(F.octet_length(body) > max_columns, short).otherwise(body)
    parts: list[Column] = []
    if filename and not heading:
        parts += [F.col("path"), F.lit("\0") if null else sep]
    if line_number:
        parts += [F.col("line_number").cast("string"), sep]
    if offset:
        parts += [F.col("byte_offset").cast("string"), sep]
    if column:
        first = F.try_element_at("spans", F.lit(1))["start"]
        parts.append(F.when(F.col("kind") == "match", F.concat((F.coalesce(first, F.lit(0)) + 1).cast("string"), sep)).otherwise(F.lit("")))
    binary = F.concat(F.col("path"), F.lit(": binary file matches (found NUL byte around offset "), F.col("byte_offset").cast("string"), F.lit(")"))
    w = Window.partitionBy("file_id").orderBy("seq")
    suppressed = F.max((F.col("kind") == "binary").cast("int")).over(Window.partitionBy("file_id")) == 1
    gap = (F.col("line_number") - F.lag("line_number").over(w)) > 1
    line = F.when(F.col("kind") == "binary", binary).otherwise(F.concat(*parts, body))
    if break_separator is not None:
        has_context = F.max(F.col("kind").isin("before", "after").cast("int")).over(Window.partitionBy("file_id")) == 1
        line = F.when(has_context & gap, F.concat(F.lit(unescape(break_separator) + "\n"), line)).otherwise(line)
    if heading:
        line = F.when(F.col("seq") == 0, F.concat(F.col("path"), F.lit("\n"), line)).otherwise(line)
    out = events.withColumn("rendered", line).withColumn("_hidden", suppressed & (F.col("kind") != "binary"))
    return out.where("not _hidden").select("file_id", "seq", "rendered")


def json_lines(events: DataFrame) -> DataFrame:
    """file_id, seq, rendered: begin, match, context, binary and end in order, for files with output; then a summary (file_id null)."""
    said = lambda c: F.struct(c.alias("text"))
    spans = F.transform("spans", lambda s: F.struct(said(s["text"]).alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    data = F.struct(said(F.col("path")).alias("path"), said(F.concat("line", F.lit("\n"))).alias("lines"), "line_number", F.col("byte_offset").alias("absolute_offset"), spans.alias("submatches"))
    body = events.where("kind <> 'binary'").select("file_id", (F.col("seq") + 1).alias("seq"), F.to_json(F.struct(F.when(F.col("kind") == "match", "match").otherwise("context").alias("type"), data.alias("data"))).alias("rendered"))
    per_file = events.groupBy("file_id", "path").agg(F.max("seq").alias("last"), F.max(F.when(F.col("kind") == "binary", F.col("byte_offset"))).alias("binary_offset"), F.sum((F.col("kind") == "match").cast("long")).alias("matched_lines"), F.sum(F.when(F.col("kind") == "match", F.size("spans")).otherwise(0)).alias("matches"))
    begin = per_file.select("file_id", F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(said(F.col("path")).alias("path")).alias("data"))).alias("rendered"))
    end = per_file.select("file_id", (F.col("last") + 2).alias("seq"), F.to_json(F.struct(F.lit("end").alias("type"), F.struct(said(F.col("path")).alias("path"), "binary_offset", F.struct("matched_lines", "matches").alias("stats")).alias("data"))).alias("rendered"))
    binary = events.where("kind = 'binary'").select("file_id", (F.col("seq") + 1).alias("seq"), F.to_json(F.struct(F.lit("binary").alias("type"), F.struct(said(F.col("path")).alias("path"), F.col("byte_offset").alias("offset")).alias("data"))).alias("rendered"))
    totals = per_file.where("matched_lines > 0").agg(F.count("*").alias("searches_with_match"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched_lines", "matches")])
    stats = F.struct(F.struct("searches_with_match", "matched_lines", "matches").alias("stats"))
    summary = totals.select(F.lit(None).cast("long").alias("file_id"), F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("summary").alias("type"), stats.alias("data"))).alias("rendered"))
    return begin.unionByName(body).unionByName(binary).unionByName(end).unionByName(summary)


def shows_filename(streams: int, files: bool, asked: bool | None = None) -> bool:
    """Whether lines carry the file's name: as asked for, otherwise unless only streams are searched."""
    return asked if asked is not None else files or streams > 1


def shows_line_number(context: bool = False, json: bool = False, column: bool = False, asked: bool | None = None) -> bool:
    """Context, columns and JSON imply line numbers."""
    return asked if asked is not None else context or json or column


def counts(hits: DataFrame, filename: bool = True, separator: str = ":", null: bool = False) -> DataFrame:
    """file_id, rendered of (file_id, path, hits)."""
    name = [F.col("path"), F.lit("\0" if null else unescape(separator))] if filename else []
    return hits.select("file_id", F.concat(*name, F.col("hits").cast("string")).alias("rendered"))


def path_records(files: DataFrame, null: bool = False, root: str | None = None, separator: str = "/") -> DataFrame:
    """file_id, rendered of (file_id, path); null: NUL ends each; root: paths are shown from it on."""
    shown = F.col("path") if root is None else F.concat(F.lit(root.rstrip("/") + "/"), F.col("path"))
    shown = shown if separator == "/" else F.translate(shown, "/", separator)
    return files.select("file_id", F.concat(shown, F.lit("\0" if null else "")).alias("rendered"))


def stats_text(stats: DataFrame) -> DataFrame:
    """rendered, in the order of line: the statistics as lines of text."""
    said = [("matches", "matches"), ("files_with_matches", "files contained matches"), ("files_searched", "files searched"), ("bytes_searched", "bytes searched")]
    each = F.posexplode(F.array(*[F.concat(F.col(c).cast("string"), F.lit(" " + text)) for c, text in said]))
    return stats.select(each.alias("line", "rendered"))


def coloured(line: Column, java: str, start: str = "\x1b[1m\x1b[31m", stop: str = "\x1b[0m") -> Column:
    """The line with its matches between terminal codes."""
    return F.regexp_replace(line, F.lit(java), F.lit(f"{start}$0{stop}"))
