"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_path(spark: SparkSession) -> None:
    """Let Python workers import this package even if PYTHONPATH lacks it. On a cluster ship it with ``--py-files``."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


#: Bytes up to which a table of texts is dealt over all cores, and from which that is worth a shuffle.
SMALL, TINY = 20 << 20, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table as it was read, dealt over all cores: often it is one file with one row group, which one task would work on.

    The size is that of its files. A larger one has as many row groups as tasks can use, and is left as it is.
    """
    size, sc = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if TINY < size <= SMALL and sc.defaultParallelism > 1 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made on this machine only if the session names none and runs all its
    tasks here, as in tests; on a cluster it would be lost on the others, so that is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="mendweave-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: for what is read several times, or must survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
