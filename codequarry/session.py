"""Session helpers shared by every analysis."""

from __future__ import annotations

import atexit
import os
import pickle
import traceback
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows whose results a table function holds before it hands them over.
ROWS_AT_A_TIME = 1000

#: What this process wrote below the shared folder.
_MADE: list[str] = []


def clean() -> None:
    """Delete the scratch tables of this process. Results that still read them must be gone; at the end of the process they are."""
    while _MADE:
        uri = _MADE.pop()
        try:
            system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
            system.delete_dir(path)
        except (OSError, pa.ArrowException):  # already gone, or a file system that only the JVM knows
            continue


atexit.register(clean)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver uses."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    if path := spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = f"file:///tmp/codequarry-{os.getpid()}"
        sc.setCheckpointDir(own)
        _MADE.append(own)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that the loss of an executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder as Parquet and read it back: columnar, compressed and pruned on later reads."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal the rows of a small table to all cores, by keys that differ: its file may be a single partition, whose rows one task would work on."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def forget(spark: SparkSession, mark: int, *kept: str) -> None:
    """Delete the scratch tables made since there were `mark`, other than those kept."""
    for path in _MADE[mark:]:
        if path not in kept:
            remove(spark, path)


def in_child(function: Callable[[list[tuple]], Iterable[tuple]], rows: list[tuple]) -> list[tuple]:
    """`function` of the rows, from a child that ends with it: what an interpreter never gives back goes with the child."""
    read, write = os.pipe()
    child = os.fork()
    if not child:
        code = 1
        try:
            os.close(read)
            try:
                answer = (list(function(rows)), None)
            except Exception:  # raised again by the parent
                answer = (None, traceback.format_exc())
            with os.fdopen(write, "wb") as f:
                pickle.dump(answer, f, pickle.HIGHEST_PROTOCOL)
            code = 0
        finally:
            os._exit(code)
    os.close(write)
    with os.fdopen(read, "rb") as f:
        data = f.read()
    _, status = os.waitpid(child, 0)
    if status:
        raise RuntimeError(f"the child ended with status {status}")
    found, fault = pickle.loads(data)
    if fault:
        raise RuntimeError(fault)
    return found


def map_rows(df: DataFrame, function: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, whole: bool = False) -> DataFrame:
    """A table function: rows of `df`, as tuples, to rows of `schema`, some at a time, or with `whole` a partition at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batch: pa.RecordBatch) -> Iterable[tuple]:
        return zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def pack(found: Iterable[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole:
            yield pack(function(r for b in batches for r in rows(b)))
        else:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                    yield pack(function(rows(batch.slice(at, ROWS_AT_A_TIME))))

    return df.mapInArrow(run, schema)
