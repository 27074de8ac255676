"""Ships the package to the executors, so Python workers find it wherever the driver runs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session as a Python archive, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tallyframe-")) / "tallyframe.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("tallyframe") / path.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
