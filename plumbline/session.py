"""What a session needs to run this package's Python on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="plumbline-", suffix=".zip")
        with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
