"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch to a Python worker: texts have any length, so that rows alone bound nothing.
BATCH_BYTES = "8m"
DEFAULT = "67108864b"


def release() -> None:
    """Give a worker's freed memory back, which stays with it else while Spark keeps it for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context, and bound the Arrow batches unless the session already does."""
    sc = spark.sparkContext
    if not getattr(sc, "_larkspur_shipped", False):
        root = Path(__file__).parents[1]
        at = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(at)
        sc._larkspur_shipped = True
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT) == DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
