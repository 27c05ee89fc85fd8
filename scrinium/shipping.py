"""The package on executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of ``spark``, once, unless their Python path has it already."""
    package = Path(__file__).resolve().parent
    paths = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(package.parent) in paths or context.applicationId in _SENT:
        return
    folder = tempfile.mkdtemp(prefix="scrinium-code-")
    target = os.path.join(folder, "scrinium.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
