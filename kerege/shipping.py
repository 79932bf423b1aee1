"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    target = os.path.join(tempfile.mkdtemp(prefix="kerege-"), "kerege_package.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)
