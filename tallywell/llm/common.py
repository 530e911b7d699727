"""What the operators of this package share: where intermediate tables go, how
text reaches Python, and how results come back.

Intermediate tables are Parquet files below the folder in ``spark.checkpoint.dir``,
which every executor and the driver can read, so a lost executor costs only the
tasks that it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Spark puts into one Arrow batch.  Long texts make the byte
#: limit the one that counts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: States that the driver's SQL parser keeps for its next texts, some 10 KB each.  Without a bound
#: every new order of a cascade's rules would leave several MB there.
PARSER_STATES = 2000


#: Applications whose executors have this package.
_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, wherever the driver has it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, f"{top.name}.zip")  # the driver serves it from here until it ends
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> None:
    """Ship the package, and bound what one Arrow batch can hold, whatever the lengths
    of the texts."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    with contextlib.suppress(Exception):  # older versions have no byte limit
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset, a local
    master (tests) gets one below /tmp, and a cluster gets an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


class Workspace:
    """Intermediate tables of one run of an operator.

    ``save`` writes a DataFrame and returns one that reads the files, which cuts
    the lineage there; ``drop`` removes tables that nothing needs any more.  What is
    left goes when the driver ends, as results are computed from it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.parser.manageParserCaches", "true")
        spark.conf.set("spark.sql.parser.parserDfaCacheFlushThreshold", PARSER_STATES)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        top.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(top)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the named tables, and let Spark delete the shuffle files of
        finished steps, which it does once the driver has collected its garbage."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


@functools.lru_cache(maxsize=1)
def _trim():
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        return ctypes.CDLL(None).malloc_trim
    return lambda _: 0


def tidy() -> None:
    """Give back to the system what a Python worker has freed: workers serve many tasks, and
    allocators would keep the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``.  A batch
    holds one row at least, so a single longer text comes alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
