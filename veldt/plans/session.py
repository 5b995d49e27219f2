"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def _on_path() -> bool:
    """Whether workers started here find the package by themselves."""
    own = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and os.path.realpath(p) == str(ROOT) for p in own)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, unless they have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and not _on_path():
        to = os.path.join(tempfile.mkdtemp(), "package.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted((ROOT / "veldt").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)
    return spark
