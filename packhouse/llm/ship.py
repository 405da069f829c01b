"""The package's code for executors that do not have it installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

import packhouse
from packhouse.sources.shared import new_folder

_shipped: set[str] = set()
#: Rows of an Arrow batch; whole texts are larger than the rows that Spark's default of 10 000 is meant for.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def packed() -> bytes:
    """The Python files of the package as a ZIP file."""
    root = Path(packhouse.__file__).parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for path in sorted(root.rglob("*.py")):
            package.write(path, str(Path(root.name) / path.relative_to(root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package to the session, as spark-submit's --py-files would, once per application; and keep Arrow batches of
    texts small, unless the session sets their size itself."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{new_folder(spark, 'code')}/packhouse.zip")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path, True)
    out.write(packed())
    out.close()
    context.addPyFile(system.makeQualified(path).toString())
    _shipped.add(context.applicationId)


def shipped(job: Callable) -> Callable:
    """A job (spark, ...) that first makes sure that executors have the package."""
    @wraps(job)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return job(spark, *rest)

    return run
