"""Sending this package to the executors, for sessions whose workers cannot import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """``spark``, once its executors have this package's code; done once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="changelode-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path(root.name) / path.relative_to(root))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark
