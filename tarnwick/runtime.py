"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: dict[int, tuple[weakref.ref, str]] = {}


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    fd, name = tempfile.mkstemp(prefix="tarnwick-", suffix=".zip")
    with os.fdopen(fd, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset; it gets one of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarnwick-checkpoint-"))
            current = sc._jsc.sc().getCheckpointDir()
        found = current.get()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tarnwick/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key, so that what is grouped by it and more is not shuffled again; into parts that grow with the input, as texts become many rows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.rdd.getNumPartitions()), key)


def discard(df: DataFrame) -> None:
    """Remove the table that materialize wrote for df; nothing may read it any more."""
    held, path = _written.pop(id(df), (None, ""))
    if held is not None and held() is df:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def end_run(spark: SparkSession) -> None:
    """Remove all tables that this session has materialized; results that read them must have been written before."""
    remove(spark, _run_dir(spark))
    _written.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
