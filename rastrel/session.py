"""Session settings and lineage cuts shared by tests, bench and library users."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "rastrel", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local session that leaves it unset, where driver and executors are one process, gets a folder of its own,
    which goes with the process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="rastrel-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plans of loops from growing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: With it Spark removes the shuffle files of a query when the query has ended, not when the driver happens to collect its plan.
_NO_SHUFFLE_LEFT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: for loops whose plans must know the true size of their tables and
    nothing of how they were made. The files may go when the session has ended, or by ``discard``; the shuffles of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rastrel/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_NO_SHUFFLE_LEFT, "false")
    spark.conf.set(_NO_SHUFFLE_LEFT, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_NO_SHUFFLE_LEFT, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``stored`` has made and that nothing reads again, such as the last step of a loop; others stay."""
    for df in tables:
        at = df.__dict__.pop("_stored_at", None) if df is not None else None
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
