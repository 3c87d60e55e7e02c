"""Makes the package importable on executors that do not share this folder."""

from __future__ import annotations

import os
import sys
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package with the session, once, unless workers find it by themselves."""
    home = str(ROOT.parent)
    if os.getcwd() == home or home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in home:
        return
    context = spark.sparkContext
    if any(p.endswith("/biblion.zip") for p in context._python_includes or []) or "biblion.zip" in context._python_includes:
        return
    import tempfile

    path = Path(tempfile.mkdtemp(prefix="biblion-")) / "biblion.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(str(path))
    sys.path_importer_cache.clear()
