"""Small helpers around mapInArrow."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None



def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would keep it while it waits."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def annotate(df: DataFrame, text_col: str, kernel: Callable[[pa.Array], Sequence[pa.Array]], fields: T.StructType, name: str) -> DataFrame:
    """df with one more struct column ``name`` that kernel computes from a batch of the text column.

    All other columns pass through untouched, whatever their names.  Batches stream, so memory is bounded by one batch.
    """
    names = fields.names
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            made = pa.StructArray.from_arrays(list(kernel(batch.column(at))), names)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, fields)]))
