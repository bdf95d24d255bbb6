"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Documents worked on at once. Texts can be long, so a step takes some hundreds of rows; Spark bounds the bytes of an Arrow batch.
BATCH_ROWS = 256


def slices(batches: Iterator[pd.DataFrame], rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """The batches (tables or columns, of pandas or Arrow) in parts of so many rows; the session's own batch size stays as it is."""
    for b in batches:
        for s in range(0, len(b), rows):
            yield b[s : s + rows]


def let_go() -> None:
    """Gives freed memory back to the system: Python workers are used again by later stages, and what all of them still hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all workers; the name under which shipped() finds it there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def shipped(name: str) -> str:
    return SparkFiles.get(name)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name the table doesn't have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
