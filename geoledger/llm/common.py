"""What the training-data operators share: tables, shared scratch space, hold-out splits, text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from weakref import WeakKeyDictionary

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.spread import spread

#: Rows of an Arrow batch that are worked on together; bounds a Python worker's memory.
SLICE_ROWS = 256
#: Text of one slice, in characters; a longer document makes a slice of its own.
SLICE_CHARS = 4_000_000


#: Rows of a batch that goes to a Python worker: with 10,000 rows, a batch of long texts makes byte arrays of tens of MB in
#: the executor, which the collector handles badly.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS. Only the registered queries and the pipeline's stages do this."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, spread over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary one, which goes at the end; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="geoledger-")
        spark.sparkContext.setCheckpointDir(base)
        keep(spark, base)
    return base


#: Folders to remove: path to the file system's and the path's handles, which outlive a stopped session.
_KEPT: dict[str, tuple] = {}
_FOLDER_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(spark: SparkSession, path: str) -> str:
    """Note a folder for removal by release()."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _KEPT[path] = (target.getFileSystem(spark._jsc.hadoopConfiguration()), target)
    return path


def release(*frames: DataFrame) -> None:
    """Remove the folders behind these frames of written(), or all intermediate folders: call it once results are consumed.

    It is called without frames when the driver's Python ends.
    """
    _remove([_FOLDER_OF.pop(f) for f in frames if f in _FOLDER_OF] if frames else list(_KEPT))


def _remove(paths: Iterable[str]) -> None:
    for system, target in [_KEPT.pop(path) for path in paths if path in _KEPT]:
        with suppress(Py4JError, OSError):  # the JVM may have gone before
            system.delete(target, True)


atexit.register(release)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. Its folder stays until release()."""
    spark = df.sparkSession
    path = keep(spark, f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _FOLDER_OF[back] = path
    return back


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make() gives, written; the folders that making it took go."""
    scratch(spark)
    before = set(_KEPT)
    out = written(make(), tag)
    _remove(set(_KEPT) - before - {_FOLDER_OF[out]})
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate table."""
    return written(df, "cut")


#: The name under which a Python worker gets the text, beside columns of any name.
TEXT = "(text)"


def with_text(docs: DataFrame, names: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs, under names that any function takes (c0, c1, ...), and last the text as TEXT."""
    return docs.select(*(F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)), F.col(f"`{text_col}`").alias(TEXT))


def split_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


#: Empty what this Python worker remembers of words. Workers are reused, and a memo that fills would stay through later stages.
MEMOS: list[Callable[[], None]] = []


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", memos: bool = False, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts as Python strings, null as empty. Without ``memos`` the worker's MEMOS are emptied first."""
    if not memos:
        for forget in MEMOS:
            forget()
    for batch in batches:
        at, n = 0, batch.num_rows
        texts = batch.column(batch.schema.get_field_index(column))
        while at < n:
            here, chars, end = [], 0, at
            while end < n and end - at < rows and (chars < SLICE_CHARS or end == at):
                here.append(texts[end].as_py() or "")
                chars += len(here[-1])
                end += 1
            yield batch.slice(at, end - at), here
            at = end
