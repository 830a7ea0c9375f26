"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch: a batch of very long texts stays in tens of MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table, with Arrow batches kept small for what follows."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(n: int, which: int, column: str = "doc_id") -> Column:
    """Whether the remainder is ``which``; a null id isn't held out."""
    return F.coalesce(remainder(n, column) == which, F.lit(False))


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


_frozen: list[bool] = []
#: What a worker keeps from one task to the next, by the name under which only tasks of the same kind ask for it.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What tasks run by ``lean(..., keeps=name)`` keep in their worker, made by the first; a task of another kind lets it go."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def _begin(keeps: str) -> None:
    """A worker's first task leaves what has been imported out of later collections, and Arrow takes its memory from the system, so that all of it can be given back."""
    if not _frozen:
        gc.freeze()
        pa.set_memory_pool(pa.system_memory_pool())
        _frozen.append(True)
    for name in [x for x in _kept if x != keeps]:
        del _kept[name]


def _end() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """The driver, its JVM and its Python, gives back the memory that it no longer uses. Else its heap keeps what plans left behind, and what native code has
    freed (compilers, collectors, network buffers) stays in the C library's arenas, of which a JVM of hundreds of threads has many."""
    _end()
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is closed to reflection
    what = new_array(jvm.java.lang.Object, 4)
    what[0], what[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # only a JVM on Linux with glibc, from 17.0.9 on, has it
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), what)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which Spark keeps for later tasks, gives back the memory that it no longer uses."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keeps)
        yield from run(batches)
        _end()

    return through


class WordIndex(dict):
    """Words to rows of ``self.rows``; ``make`` gives new words' rows, many at a time. It is emptied when it holds ``most`` words."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], width: int, most: int = 250_000):
        super().__init__()
        self.make, self.most = make, most
        self.rows = np.zeros((4096, width), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        new = [w for w in {*words} if w not in self]
        if new:
            first = len(self)
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.make(new)
            self.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def gather(self, words: list[bytes]) -> np.ndarray:
        """The words' rows; ``of`` may replace the table, so it comes first."""
        at = self.of(words)
        return self.rows[at]


def chosen(df: DataFrame, key: str, n: int, *, salt: int = 0) -> list:
    """The keys of at most ``n`` rows with the smallest hash of the key: a bounded sample, the same on every run."""
    rows = df.select(key).where(F.col(key).isNotNull()).select(key, F.xxhash64(F.lit(salt), F.col(key)).alias("_h")).orderBy("_h", key).limit(n)
    return [r[0] for r in rows.collect()]


def local(spark: SparkSession, schema: str, *columns: Iterable) -> DataFrame:
    """A small frame of the driver's values, without a Python worker on the executors."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array(list(x), f.type) for x, f in zip(columns, kind, strict=True)], kind), schema)


def summed(rows: DataFrame, tasks: int, kind: type) -> np.ndarray | None:
    """The sum of the arrays in the binary column ``n`` of the ``tasks`` partitions: eight at a time on the executors, the last few on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("n").to_pylist():
                total = np.frombuffer(x, kind).copy() if total is None else total + np.frombuffer(x, kind)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    while tasks > 8:
        tasks = -(-tasks // 8)
        rows = rows.repartition(tasks).mapInArrow(lean(add), "n binary")
    found = [np.frombuffer(r[0], kind) for r in rows.collect()]
    return np.sum(found, axis=0, dtype=kind) if found else None


def with_keys(df: DataFrame, key: str, keys: Iterable) -> DataFrame:
    """The rows whose key is one of the given ones; ``keys`` is a bounded list."""
    few = local(df.sparkSession, f"{key} {df.schema[key].dataType.simpleString()}", keys)
    return df.join(F.broadcast(few), key, "left_semi")
