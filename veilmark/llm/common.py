"""Helpers shared by the training-data operators: the shared folder, written intermediates and worker tasks."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the package lives, so that Python workers can import it whatever their working directory is.
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's; a new local one where the executors are the driver's threads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilmark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Intermediates written so far, for ``release``.
_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all intermediates that this process has written: for callers whose results are written and read again."""
    while _written:
        drop_path(spark, _written.pop())


_tidied = 0.0


def _tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files that written tables no longer need: Spark removes them once the driver has collected its garbage, which an idle driver puts off."""
    global _tidied
    if time.monotonic() - _tidied > 3:
        _tidied = time.monotonic()
        spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, *by: str) -> str:
    """Write ``df`` to the shared folder, by the values of columns ``by`` if any; its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    _tidy(df.sparkSession)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def alone(df: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``df`` returns, written and read back; whatever it has written on the way is removed."""
    at = len(_written)
    out = df()
    out = materialise(out, name)
    for path in _written[at:-1]:
        drop_path(out.sparkSession, path)
    del _written[at:-1]
    return out


#: Rows and bytes of an Arrow batch, where the session leaves them as they are: what a worker holds then depends on neither's number.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def task(fn: Callable, **params) -> Callable:
    """``fn(batches, **params)`` of an importable module as a ``mapInArrow`` function.

    Only the module's name travels, so that what it caches at module level lives as long as the worker.
    """
    module, name, root = fn.__module__, fn.__name__, ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        from veilmark.llm.common import give_back

        try:
            yield from getattr(importlib.import_module(module), name)(batches, **params)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system: workers wait for tasks of other stages, and what they keep adds up."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, fn: Callable, schema, **params) -> DataFrame:
    """``mapInArrow`` with ``task(fn, **params)`` over batches of bounded rows and bytes."""
    conf, prefix = df.sparkSession.conf, "spark.sql.execution.arrow."
    if conf.get(prefix + "maxRecordsPerBatch") == "10000":  # the default
        conf.set(prefix + "maxRecordsPerBatch", BATCH_ROWS)
        conf.set(prefix + "maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(task(fn, **params), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Words of the contracts: maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}_{i}" for i in range(len(taken) + 1)) if n.lower() not in taken)


#: Bits of a bitmap of values that are looked for: 256 KB, whatever their number.
BITMAP = 1 << 21


def among(values: DataFrame, inside: bool = False) -> Callable[[Column], Column] | None:
    """Whether a value may be one of ``values`` (one column), by a bitmap of fixed size: true for all of them, and for few others as long as there are
    fewer than bits; None if there are none.  ``inside``: it is asked inside a higher-order function, where a subquery can't stand."""
    slot = lambda v: F.pmod(F.xxhash64(v), F.lit(BITMAP))
    at = values.select(slot(F.col(values.columns[0])).alias("s"))
    words = at.groupBy((F.col("s") / 64).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("w")).collect()  # BITMAP / 64 rows at most
    if not words:
        return None
    held = {r["i"]: r["w"] for r in words}
    if inside:
        bits = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(BITMAP // 64))), ",").cast("array<bigint>")
    else:  # as a literal it would be written out wherever the plan is described, which the driver keeps
        bits = materialise(values.sparkSession.createDataFrame([([held.get(i, 0) for i in range(BITMAP // 64)],)], "bits array<long>"), "bitmap").scalar()
    return lambda v: F.getbit(F.get(bits, (slot(v) / 64).cast("int")), (slot(v) % 64).cast("int")) == 1


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a document by its id and text, in 128 bits: equal rows share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")))
