"""Session helpers: shipping the package to executors, and lineage cuts in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, wherever they run; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_critpath_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="critpath-")) / "critpath.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, os.path.join(_ROOT.name, p.relative_to(_ROOT)))
    sc.addPyFile(str(to))
    sc._critpath_shipped = True


def prepare_checkpoints(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; on a local master a temporary one will do.

    Checkpoints are deleted once nothing refers to them.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps Spark's estimate of its size, and a join's is the product of its sides': in a loop the figure's digits
    multiply with every round, until the driver has no memory or time for anything else. One that no table can have is dropped.
    """
    spark = df.sparkSession
    prepare_checkpoints(spark)
    out = df.checkpoint(eager=True)
    if int(str(out._jdf.queryExecution().analyzed().stats().sizeInBytes())) < 1 << 63:
        return out
    rows = out._jdf.queryExecution().toRdd()
    return type(out)(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)


def give_back(spark: SparkSession) -> None:
    """Returns what the driver no longer uses to the system, of Python and of the JVM, and what the executors' JVMs don't; without it none shrinks after a peak."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library keeps what it has
        pass
    spark._jvm.System.gc()
    if not spark.sparkContext._jsc.sc().isLocal():  # a task for each core reaches every executor, as none is busy between stages
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
