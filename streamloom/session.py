"""Session factory and shipping of this package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings the library relies on for results; sizes and parallelism are the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
_shipped: set[str] = set()


def get_session(app: str = "streamloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; `conf` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to executors once an application (Spark's file server; no shared disk needed)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        Path(path).write_bytes(buffer.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
