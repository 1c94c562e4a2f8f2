"""Gives the executors this package, where they don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of rows that go to a Python task at once, whatever their number: rows here are texts and reads of any length.
BATCH = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the Python path of all tasks, once an application, and bounds the batches that they get."""
    if spark.conf.get(_LIMIT, str(BATCH)) == str(BATCH):  # unless the session has its own
        spark.conf.set(_LIMIT, str(BATCH))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tandem-")) / "tandem.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
