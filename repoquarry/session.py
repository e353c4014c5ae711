"""Session helpers: conf for the jobs and the shared folder for intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.sources.storage import delete_path

JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "repoquarry", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. Not needed
    where it is installed on all nodes or passed with --py-files."""
    context = spark.sparkContext
    if getattr(context, "_repoquarry_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="repoquarry-")) / "package"),
        "zip",
        root_dir=package.parent,
        base_dir=package.name,
    )
    context.addPyFile(archive)
    context._repoquarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only where `spark.checkpoint.dir` is unset, as in local tests, a temporary
    folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="repoquarry-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; a job may delete it
    once its results are written."""
    return f"{shared_dir(spark)}/repoquarry-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    delete_path(spark, scratch_root(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a retry or a second
    consumer then sees the same rows, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        spark.sparkContext.defaultParallelism,
    )


TASK_BYTES = 256 << 20


def tasks_for(spark: SparkSession, units: int, size: int) -> int:
    """Tasks for `units` pieces of work on `size` bytes: all slots if there are pieces for
    them, and more where a task would otherwise have more than TASK_BYTES."""
    return max(1, min(task_count(spark), units), -(-size // TASK_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every slot a share of a small table before costly work on its rows.

    A small file is one or two row groups, which only as many tasks can read. A large
    table has more splits than there are slots and is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def explode_all(array: Column) -> Column:
    """Generator for arrays known to have entries. The plain form makes the optimizer
    add a filter against empty arrays, which computes the array a second time."""
    return F.posexplode_outer(array)


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times inside `body`.

    A plain column reference inside a lambda is inlined by the optimizer when two
    projections are merged, and would then be evaluated once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
