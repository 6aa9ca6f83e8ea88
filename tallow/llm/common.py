"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the folder of setCheckpointDir, or, in local mode alone, a temporary one."""
    global _own_dir
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage with a table that outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of at most n rows and about BATCH_BYTES from Spark to Python for what runs inside: texts and sets are long, and a batch is held whole on both sides."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    rows, size = map(spark.conf.get, names)
    spark.conf.set(names[0], str(min(n, int(rows)) if int(rows) > 0 else n))
    spark.conf.set(names[1], str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(names[0], rows)
        spark.conf.set(names[1], size)


def give_back() -> None:
    """Hand freed memory to the system at the end of a task: its Python process lives on, and the allocators keep what is free."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed by place, so that no working column can clash with them, and their new names by the old."""
    names = {c: f"given_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def most_frequent(counts: DataFrame, col: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most `most` and as many as steps of a 64th of an octave allow; rows of one step come together or not at all.

    The steps' sizes, a few thousand rows, give the bound, so nothing is sorted in one task.
    """
    step = F.floor(F.log2(col) * 64).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    return counts.where(step >= least) if least is not None else counts.where(F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Number of words of a string column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
