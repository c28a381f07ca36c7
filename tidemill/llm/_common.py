"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word separators: blank and the control characters 9 to 13.
SEPARATOR = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one where that is unset and one machine does all."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemill-{os.getuid()}"
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``drop`` removes a table as soon as nothing reads it any more; what a returned
    DataFrame still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the driver is ending; the folder's own retention takes what is left
            pass


def utf8(column: pa.Array) -> list:
    """The values of a string column as bytes, without decoding them."""
    return column.cast(pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lean(run: Callable) -> Callable:
    """A function over batches that hands freed memory back to the system when it is done: idle workers stay, and would keep it."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def slices(batches, rows: int = 1000):
    """The batches in parts of at most so many rows, to bound what a task holds of them in Python."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
