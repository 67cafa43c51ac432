"""Session factory, and shipping of this package to executors."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "cairnql", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; ``conf`` (dots as ``__``) overrides.

    Partition counts are left to the cluster: adaptive execution coalesces small shuffle
    partitions and splits skewed ones of joins.
    """
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings and "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session, which driver and executors share; None on one machine without it.

    A cluster must name one: what a machine writes into a folder of its own, others cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/") if named else None


_shipped: set[str] = set()
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    Python workers import the functions they run from it, so it need not be installed there.
    The archive lies in the shared folder of the session, or where none is named (tests on
    one machine) in a temporary one.  Python workers get ``ARROW_ROWS`` rows at a time,
    unless the session names a number of its own, as texts may be long.
    """
    if spark.conf.get(ARROW, None) in (None, "10000"):
        spark.conf.set(ARROW, str(ARROW_ROWS))
    context = spark.sparkContext
    app = context.applicationId
    if app in _shipped:
        return
    top = Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    shared = shared_folder(spark)
    if shared:
        at = f"{shared}/cairnql-modules-{app}.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        out = files.create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        files.deleteOnExit(path)
    else:
        at = str(Path(tempfile.mkdtemp(prefix="cairnql-ship-")) / "cairnql-modules.zip")
        Path(at).write_bytes(data.getvalue())
    context.addPyFile(at)
    _shipped.add(app)
