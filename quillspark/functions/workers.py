"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application.

    Functions that workers run are then importable there by name, and what
    their modules remember lasts as long as a worker.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix=f"{root.name}-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
