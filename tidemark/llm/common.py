"""Reading, shared-folder tables and hashing used by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
WS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read; a local one is made only where none is configured and there are no other machines (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables that ``written`` makes, for each ``recorded`` that is open.
_open: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder as Parquet and read them back.

    Unlike a local checkpoint the files outlive any executor.  They lie in a folder named by the
    application, which goes when the driver ends; ``discarded`` removes a table before that.
    """
    spark = df.sparkSession
    run = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"
    path = f"{run}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, run)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    for paths in _open:
        paths.append(path)
    return out


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add the paths of all tables written inside to the list."""
    _open.append(paths)
    try:
        yield
    finally:
        _open.pop()


def swept(reads: DataFrame, paths: list[str]) -> None:
    """Remove the recorded tables but those that ``reads`` is made from, and the shuffle files of finished steps.

    The list keeps what stays.  The caller answers for every other plan over these tables.
    """
    spark = reads.sparkSession
    read = {part for file in reads.inputFiles() for part in file.split("/")[-2:]}
    gone = [path for path in paths if path.rsplit("/", 1)[1] not in read]
    for path in gone:
        fs, where = _file_system(spark, path)
        fs.delete(where, True)
    paths[:] = [path for path in paths if path not in gone]
    released(spark)


def discarded(*tables: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in tables:
        fs, where = _file_system(df.sparkSession, df._written_at)
        fs.delete(where, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows come from, as the optimiser states them; 0 where it cannot tell (no files, joins)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if plan.collectLeaves().size() == 1 and size < 1 << 60 else 0


#: Column that numbers the rows of a written table.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, written once so that every later read sees the same numbers."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()))


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's JVM has collected their owners."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that travel to a Python worker at a time, where the session sets no number of its own.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker holds at once: it makes several arrays of each byte of a batch of texts.  Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def tidy() -> None:
    """Give free memory of this Python worker back to the system: Spark keeps workers for later tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, followed by ``tidy`` at the end of each task."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return both


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
