"""Session helpers: local test session and the folder shared by all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app_name: str = "limnos") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


# Scratch folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared folder the cluster names in ``spark.checkpoint.dir``.

    A cluster must name one. Only a local session may leave it unset, as in tests: it gets a folder that is removed when
    the Python process ends.
    """
    application = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="limnos-")
            atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
        base = _LOCAL[application]
    return f"{base.rstrip('/')}/limnos-{application}"


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the scratch folder."""
    return "/".join([scratch_folder(spark), uuid.uuid4().hex, *parts])


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything this application has staged; call it before the session is stopped."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of slices a hot group is cut into: as many as a shuffle has partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def staged(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and go on from the table.

    The steps before it run once, and a lost executor does not bring them back. The optimizer knows the
    size of a written table: as one side of a join it is broadcast if it is small, and sorted and split
    if it is not, while the size of an aggregate would be a guess that shuffles the big side.
    """
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
