"""Session set-up shared by queries, tests and the bench."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(PACKAGE.parent))
    folder = tempfile.mkdtemp()
    archive_path = os.path.join(folder, "tracelake.zip")
    Path(archive_path).write_bytes(buffer.getvalue())
    context.addPyFile(archive_path)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
