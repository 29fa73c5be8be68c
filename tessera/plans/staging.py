"""Cutting lineage through tables that every executor can read.

``staged(df)`` writes a DataFrame once, as Parquet, below the folder that the
session names in ``spark.checkpoint.dir`` and returns the table read back.  The
rows are computed once however often the result is used, a lost executor costs
nothing, and the optimizer sees the true size of the table.  ``release(spark)`` deletes what
the application has staged, once its results are written; at the end of the process that is done
if the session is still there.  Only where the
session names no folder (tests, notebooks on one machine) is one made below the
system's temporary folder.  In a shared folder of the operating system, files are written without
Hadoop's checksum files, and no process is started for their permissions.  ``discard(*tables)`` deletes staged tables that nothing reads any more.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hadoop's checksummed local files start two processes (chmod) for each file that an executor writes unless its native library is there,
#: and until such a process runs its own program it has all the executor's memory. Parquet has checksums of its own.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_OWN: dict[str, str] = {}
_STAGED: dict[str, tuple[SparkSession, list[str]]] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(folder.cleanup)
        _OWN[app] = f"file://{folder.name}"
    return _OWN[app]


def staged(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, (spark, []))[1].append(path)
    df.write.options(**PLAIN_FILES).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables, which nothing may read afterwards.

    The driver collects its garbage then: the shuffle files and broadcasts of finished steps
    stay on the executors' disks and in the driver's memory until it does.
    """
    spark = tables[0].sparkSession
    paths = [_PATHS.pop(t) for t in tables]
    delete(spark, paths)
    own = _STAGED[spark.sparkContext.applicationId][1]
    own[:] = [p for p in own if p not in paths]
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application has staged and returns their number; results that read them must be written before."""
    _, paths = _STAGED.pop(spark.sparkContext.applicationId, (spark, []))
    delete(spark, paths)
    return len(paths)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_STAGED.values()):
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the gateway may be gone before us
                release(spark)


def small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Stages ``df`` and says whether it has at most ``max_rows`` rows, so that it may be broadcast."""
    table = staged(df)
    return table, table.limit(max_rows + 1).count() <= max_rows


def join_small(big: DataFrame, table: DataFrame, fits: bool, on: list[str], how: str = "inner") -> DataFrame:
    """Joins ``table`` (staged, checked by :func:`small`) to ``big``: broadcast if it fits, a shuffled join that AQE may split otherwise."""
    return big.join(F.broadcast(table) if fits else table, on, how)
