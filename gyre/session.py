"""Sends this package to the executors of a session, as spark-submit's --py-files would."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application; Python workers then find the package wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gyre-code-")), "gyre-package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark
