"""What Python workers need: the package itself, and bounds on what they hold at a time."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context, so that they can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # else it was imported from an archive that Spark sent itself
        fd, archive = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        atexit.register(_gone, archive)  # workers fetch it as long as the driver lives
    context._tessera_shipped = True


def _gone(path: str) -> None:
    with contextlib.suppress(OSError):
        os.unlink(path)


def small_batches(spark: SparkSession) -> None:
    """Make the workers ready for long texts: they get the package, and Arrow batches are bounded in rows and bytes.

    Spark's default of 10,000 rows is tens of megabytes of text in each of several
    copies.  Smaller settings of the session's own are kept.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
