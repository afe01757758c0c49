"""What a Spark session needs to run this package's Python functions on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once for each context, so that none has to have it installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_locusframe_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="locusframe-")) / "locusframe.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("locusframe") / p.relative_to(root)))
    context.addPyFile(str(archive))
    context._locusframe_shipped = True
