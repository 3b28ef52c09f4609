"""Tables in the folder that driver and executors share, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side whose measured size is at most this is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="gramscan-"))
        folder = _own[0]
    return folder.rstrip("/")


class Scratch:
    """Written tables of one run of an operator.  They survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame, *partition: str) -> DataFrame:
        path, schema = self.path(), df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes the table that ``write`` gave, once nothing reads it any more."""
        jvm, files = self.spark.sparkContext._jvm, df.inputFiles()
        if files:
            cut = files[0].index(self.root.rsplit("/", 1)[1])
            parts = files[0][cut:].split("/")
            path = jvm.org.apache.hadoop.fs.Path(files[0][:cut] + "/".join(parts[:2]))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns with clashing names can't disturb.

    Python reads them in batches of about 4 MB of text, which bounds executors' memory outside the heap;
    a session that sets another bound keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # Spark's default
        conf.set(_BATCH, "4m")
    return df.select(*[F.col(f"`{n}`") for n in names])


def keep_rows(df: DataFrame, mask) -> DataFrame:
    """The rows of ``df`` for which ``mask(batch)`` is true; all columns stay as they are."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(mask(batch)))

    return df.mapInArrow(run, df.schema)
