"""Tables written to the cluster's shared folder to cut lineage in iterative jobs."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A session that names none (``spark.checkpoint.dir``) gets one beside its tables, in
    the warehouse, which executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rounds/{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is ever written over."""
    return f"{shared_dir(spark).rstrip('/')}/pageloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Losing an executor later costs a re-read, never a replay of earlier rounds.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of earlier rounds that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/pageloom/" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def with_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in.

    A cluster without that folder gets the package through ``--py-files`` instead.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)
