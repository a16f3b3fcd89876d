"""What a session needs before Python runs on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python path, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_factweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="factweave-")) / "factweave-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._factweave_shipped = True
