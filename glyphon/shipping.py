"""Getting this package to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, whose Python needn't find it otherwise; once a context."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(), "glyphon.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((top / "glyphon").rglob("*.py")):
                z.write(f, f.relative_to(top))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
