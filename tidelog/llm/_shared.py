"""Helpers shared by the training-data operators: shared-folder staging and word rules."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Word rule of every operator: maximal runs of anything but space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset, as in tests on a local master, a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return _own_dirs[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete every staged table of this application; results not yet written are lost with them."""
    _delete(spark, _own_folder(spark))


#: Spark deletes the shuffle files of a finished execution while this setting is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession):
    """Executions inside keep no shuffle files once they have ended; for plans that run only once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Staged:
    """A table written once to the shared folder; later reads need no lineage and no lost executor."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{_own_folder(self.spark)}/{uuid.uuid4().hex}/{name}"
        self.schema = df.schema
        with no_shuffle_left(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call it only when no unread DataFrame still refers to them."""
        _delete(self.spark, self.path.rsplit("/", 1)[0])


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again."""
    return Staged(df, name).read()


def release_memory() -> None:
    """Give a Python worker's freed memory back to the machine, which it shares with its executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
