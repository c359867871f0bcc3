"""Sessions, and how this package reaches the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", name: str = "loomtext") -> SparkSession:
    """A session for tests, benchmarks and the command line."""
    spark = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors once per application, for those that can't import it."""
    # Rows can be whole documents: small batches, in rows and in bytes, bound what scans, the exchange with Python and Python hold.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    # Spark serves the file from here for as long as the application runs.
    folder = os.path.realpath(tempfile.mkdtemp(prefix=f"{top.name}-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
