"""Session settings and the shared folder that jobs may write stages to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_shipped: set[str] = set()


def build_session(app: str = "heliospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and the zone the library reckons in.

    Partition counts and memory are left to the cluster's own defaults; pass
    them in ``conf`` (dots written as ``__``) where a run needs others.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark application.

    Functions that run in Python workers are pickled by reference, so workers
    must be able to import the package wherever they were started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="run-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has run to its end, on whatever file system it lies."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
