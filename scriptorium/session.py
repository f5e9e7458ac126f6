"""Making the package importable for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless their path has it anyway."""
    root = Path(__file__).resolve().parent.parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in [*paths, Path.cwd().resolve()] or app in _shipped:
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="scriptorium-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/scriptorium", "zip", root, "scriptorium"))
