"""Session helper and the one folder every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting that names the folder for written intermediates where spark.checkpoint.dir is unset.
SCRATCH_DIR = "parley.scratch.dir"


def local_session(cores: int | str = 8, app: str = "parley", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates.

    The one that the cluster names in `spark.checkpoint.dir`, else the one given as
    `parley.scratch.dir`. A local session, where one machine does all, may name
    neither and gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH_DIR, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set spark.checkpoint.dir or {SCRATCH_DIR} to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="parley-"))
    return _own_dir[0]


_used: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _used.append(path)
    return path


def clean_scratch(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Delete what this program wrote aside; frames that read it are gone with it."""
    for path in [p for p in _used if p not in keep]:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        _used.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written aside within the block is deleted at its end."""
    before = list(_used)
    try:
        yield
    finally:
        clean_scratch(spark, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, where it need not be installed: one archive per application.

    The archive lies with the driver; Spark's own file service gives it to the executors.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = f"{tempfile.mkdtemp(prefix='parley-')}/parley-modules.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The frame as a parquet table in the shared folder.

    For results that several later steps read: they are computed once, survive
    lost executors, and each reader takes only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
