"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application.

    Nothing is sent where the executors' Python path names this checkout
    already (``PYTHONPATH`` of the driver), as in tests.
    """
    sc = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT.parent) in known or getattr(sc, "_loomquery_shipped", False):
        return
    path = Path(os.path.realpath(tempfile.mkdtemp(prefix="loomquery-"))) / "loomquery_sources.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._loomquery_shipped = True
