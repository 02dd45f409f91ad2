"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are sent to every task to pick or drop rows; more are joined by a shuffle, with the same result.
MOST_IDS = 1_000_000
#: Bytes of an Arrow batch, unless the session was given another bound: memory then follows bytes, not rows.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set to a temporary one only where it is unset and one machine
    runs everything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kinloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps neither recompute it nor
    depend on any executor that made it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes in this session, if it has the default of 64 MiB."""
    if spark.conf.get(_BATCH, None) in (None, str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def rows_of(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", most: int = MOST_IDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` is, or with how="left_anti" isn't, among ``ids``, a staged table of that one
    column without repeats or nulls. The rows only move where there are more than ``most`` ids."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
