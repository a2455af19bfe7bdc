"""Python workers that give memory back: a worker outlives its task, and would keep what the largest batch took."""

from __future__ import annotations

import ctypes
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to trim
        return lambda pad: 0


def release() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run):
    """Wrap a mapInArrow function so that free memory goes back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with a lean function, for DataFrame.transform.

    Local workers find this package wherever the driver found it; on a cluster it is shipped with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df.mapInArrow(lean(run), schema)
