"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings for local runs and tests; on a cluster spark-submit gives the session.
LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; one of our own only where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


#: Folders of written tables by scope; the last scope is the one open.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def application_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The plan behind it is cut, a lost executor costs only tasks, and the columnar copy is far smaller
    than a checkpoint of rows. The files go when the scratch() they were written in ends, else when the
    Python process does; sweep() removes those of drivers that were killed.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_scopes) == 1 and not _scopes[0]:
        atexit.register(_remove_all, _scopes[0])
    _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are removed at its end, so results must have been read or written by then.

    For drivers that live long: one query each, whose intermediate tables would else stay to the end.
    """
    _scopes.append([])
    try:
        yield
    finally:
        _remove_all(_scopes.pop())


def sweep(spark: SparkSession, older_than_seconds: float) -> int:
    """Remove the folders of other applications that nothing was written into for that long; how many there were."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own, gone = application_dir(spark).rsplit("/", 1)[1], 0
    for status in fs.listStatus(root) if fs.exists(root) else ():
        name = status.getPath().getName()
        if name.startswith("quern-") and name != own and status.isDirectory() and time.time() - status.getModificationTime() / 1000 > older_than_seconds:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def _remove_all(written: list[tuple[SparkSession, str]]) -> None:
    while written:
        _remove(*written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
