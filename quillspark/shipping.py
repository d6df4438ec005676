"""Brings the package to executors that can't import it from a path of their own."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from quillspark.scratch import delete_at_end, shared_root, write_bytes

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to all executors by the shared folder, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    path = f"{shared_root(spark)}/quillspark-{context.applicationId}.zip"
    write_bytes(spark, path, packed.getvalue())
    delete_at_end(spark, path)
    context.addPyFile(path)
    _shipped.add(context.applicationId)
