"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "newsloom") -> SparkSession:
    """Session for tests and local runs; on a cluster the platform brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # No call site per column; plans are built a little faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    ``spark.checkpoint.dir``; a temporary one only in local runs that name none."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="newsloom-")
    return _own_folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def local_path(spark: SparkSession, path: str) -> str | None:
    """A path as the operating system names it; None in any other file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(target).toUri().getPath() if files.getScheme() == "file" else None


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what is at a path of any file system that Spark writes."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def short_listings(spark: SparkSession) -> None:
    """Folders of many files are listed by a few tasks per core; Spark's own bound is so high that
    each small folder becomes a task. Streams list while they run, so the setting stays."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = min(int(spark.conf.get(name)), 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set(name, str(tasks))


def cut_lineage(table: DataFrame) -> DataFrame:
    """Materialise a table reliably; lost executors do not lose it."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(table.sparkSession))
    return table.checkpoint()
