"""Tables written between steps, in the folder that driver and executors share, and the package for Python workers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process, until they are cleared.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, one machine) gets a temporary folder that goes with the process; a cluster is
    refused, as its machines don't see each other's folders.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="driftloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the running stage: what is written is read again by others. ``clear_stored`` deletes the
    tables when nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that this process has written since it had ``keep`` of them (see ``marked``); returns how many.

    Frames that read them can't be used any more, so results are to be written or collected first.
    """
    gone = _WRITTEN[keep:]
    del _WRITTEN[keep:]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def let_go(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and plans that nothing refers to any more.

    Spark learns of them by the driver's garbage collection alone, which grows the heap before it looks through all of it. In
    a loop what ended rounds leave would fill the driver's heap to its end and the executors' disks.
    """
    gc.collect()  # frames that only a cycle holds hold plans in the JVM
    spark._jvm.System.gc()


def marked() -> int:
    """How many tables are written now, for ``clear_stored``."""
    return len(_WRITTEN)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
