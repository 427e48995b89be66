"""What several operators share: the shared folder, written tables, Arrow blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; bounds both sides' memory.
ARROW_ROWS = 400
#: Bytes of text that a numpy kernel works on at once (a longer text is one block).
BLOCK_BYTES = 1 << 19

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    A local temporary folder is used only where the setting is unset and the
    master is local (tests); a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("tetrad.shared.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tetrad-")
        spark.conf.set("tetrad.shared.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and
    outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_since(first: int | None = None) -> int | list[str]:
    """How many tables have been written; or with that number, the paths since
    then, which the caller now owns."""
    if first is None:
        return len(_written)
    paths = _written[first:]
    del _written[first:]
    return paths


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables whose readers are done."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def folder_files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder, for files that workers write themselves."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _thrifty() -> None:
    """Let this process give large arrays back as soon as they are freed: the C
    library would otherwise learn to keep ever larger ones, and Arrow all of its own."""
    with contextlib.suppress(OSError, AttributeError):
        c = ctypes.CDLL(None)
        for name, value in ((-3, 8 << 20), (-1, 16 << 20), (-8, 2)):  # thresholds to map and to trim, arenas
            c.mallopt(name, value)
        pa.set_memory_pool(pa.system_memory_pool())


_thrifty()
_released = 0.0


def release() -> None:
    """Give memory that this process no longer uses back to the machine, every other second at most."""
    global _released
    if time.monotonic() - _released < 2:
        return
    _released = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ARROW_ROWS rows, unless the user has set a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(ARROW_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """That name, or one like it that no column has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text as string, null text as empty; other columns go."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and its n + 1 offsets."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``most`` bytes together, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
