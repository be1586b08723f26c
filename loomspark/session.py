"""Spark session and shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build(app: str = "loomspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow, checkpoints that go with their last reference)."""
    b = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make Python workers able to import this package, wherever they run (once a context), and
    bound Arrow batches: a batch of very long texts stands in the JVM and in the worker at once."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="loomspark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark
