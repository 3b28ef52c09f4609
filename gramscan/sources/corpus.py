"""Corpora: DataFrames of (file_id, path, content, explicit)."""

from __future__ import annotations

import bz2
import codecs
import fnmatch
import gzip
import lzma
import os
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import Filter, walk

_TOOLS = {".lz4": ["lz4", "-dc"], ".zst": ["zstd", "-dqc"], ".zstd": ["zstd", "-dqc"], ".br": ["brotli", "-dc"], ".z": ["uncompress", "-c"], ".Z": ["uncompress", "-c"]}


def decompress(path: str, data: bytes) -> bytes:
    """By suffix; bytes stay as they are if there is no tool for it."""
    low = path.lower()
    if low.endswith((".gz", ".tgz")):
        return gzip.decompress(data)
    if low.endswith((".bz2", ".tbz2")):
        return bz2.decompress(data)
    if low.endswith((".xz", ".txz", ".lzma")):
        return lzma.decompress(data)
    for suffix, tool in _TOOLS.items():
        if path.endswith(suffix):
            if shutil.which(tool[0]):
                return subprocess.run(tool, input=data, capture_output=True, check=True).stdout
            if suffix.startswith(".zst"):
                import zstandard

                return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


_BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decode(data: bytes, encoding: str = "auto") -> bytes:
    """UTF-8 bytes.  auto: only a byte-order mark transcodes; none: raw; a label: the mark wins over it."""
    if encoding == "none":
        return data
    for mark, name in _BOMS:
        if data.startswith(mark):
            rest = data[len(mark) :]
            return rest if name == "utf-8" else rest.decode(name, "replace").encode("utf-8")
    return data if encoding == "auto" else data.decode(encoding, "replace").encode("utf-8")


@dataclass
class Corpus:
    """df: file_id long, path string, content string or binary, explicit boolean; text: content is valid text."""

    df: DataFrame
    text: bool = True

    @staticmethod
    def from_table(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> Corpus:
        path = F.col(path_col) if path_col else F.col(id_col).cast("string")
        return Corpus(df.select(F.col(id_col).cast("long").alias("file_id"), path.alias("path"), F.col(text_col).alias("content"), F.lit(False).alias("explicit")))

    @staticmethod
    def from_bytes(spark: SparkSession, streams: list[tuple[str, bytes]]) -> Corpus:
        rows = [(i, label, bytearray(data), True) for i, (label, data) in enumerate(streams)]
        return Corpus(spark.createDataFrame(rows, "file_id long, path string, content binary, explicit boolean"), text=False)

    @staticmethod
    def from_files(spark: SparkSession, root: str, scopes: list[str] | None = None, rules: Filter | None = None) -> Corpus:
        """Lists the tree on the driver under the ignore rules; executors read the contents."""
        found = walk(root, scopes or [], rules or Filter())
        paths = [os.path.join(root, f.path) for f in found]
        if not paths:
            return Corpus(spark.createDataFrame([], "file_id long, path string, content binary, explicit boolean"), text=False)
        names = spark.createDataFrame([(i, f.path, f"file:{p}", f.explicit) for i, (f, p) in enumerate(zip(found, map(os.path.abspath, paths), strict=True))], "file_id long, path string, uri string, explicit boolean")
        data = spark.read.format("binaryFile").load([f"file://{os.path.abspath(p)}".replace("{", "\\{").replace("[", "\\[") for p in paths])
        data = data.select(F.regexp_replace("path", "^file:/+", "file:/").alias("uri"), "content")
        return Corpus(names.join(data, "uri", "left").select("file_id", "path", "content", "explicit"), text=False)

    @staticmethod
    def listing(spark: SparkSession, root: str, scopes: list[str] | None = None, rules: Filter | None = None) -> DataFrame:
        """file_id, path, size, explicit, modified, accessed, created of the files that ``from_files`` reads, under the same ids."""
        rows = [(i, f.path, f.size, f.explicit, f.modified, f.accessed, f.created) for i, f in enumerate(walk(root, scopes or [], rules or Filter()))]
        return spark.createDataFrame(rows, "file_id long, path string, size long, explicit boolean, modified double, accessed double, created double")

    def transformed(self, change: Callable[[str, bytes], bytes]) -> Corpus:
        """Contents through a function of (path, bytes): decompression, a preprocessor, decoding."""

        def run(batches):
            for batch in batches:
                out = [None if d is None else change(p, d) for p, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("path"), pa.array(out, pa.binary()), batch.column("explicit")], names=["file_id", "path", "content", "explicit"])

        df = self.df.select("file_id", "path", F.col("content").cast("binary"), "explicit")
        return Corpus(df.mapInArrow(run, "file_id long, path string, content binary, explicit boolean"), text=False)

    def decompressed(self) -> Corpus:
        return self.transformed(decompress)

    def preprocessed(self, command: list[str] | Callable[[str, bytes], bytes], globs: list[str] | None = None) -> Corpus:
        """A command that gets the content on its standard input, or a function; it fails the job if it fails."""

        def change(path: str, data: bytes) -> bytes:
            if globs and not any(fnmatch.fnmatch(path, g) or fnmatch.fnmatch(os.path.basename(path), g) for g in globs):
                return data
            return command(path, data) if callable(command) else subprocess.run([*command, path], input=data, capture_output=True, check=True).stdout

        return self.transformed(change)

    def union(self, other: Corpus) -> Corpus:
        a, b = (c.df.withColumn("content", F.col("content").cast("binary")) if self.text != other.text else c.df for c in (self, other))
        return Corpus(a.unionByName(b), self.text and other.text)


