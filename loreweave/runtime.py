"""Session helpers: the shared scratch folder and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_CLEANED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir where it is set.

    Where it is unset a local master gets a temporary folder and a cluster gets
    a folder below the warehouse, which its executors share as well.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if app not in _OWN_DIRS:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            _OWN_DIRS[app] = (
                tempfile.mkdtemp(prefix="loreweave-")
                if local
                else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            )
        base = _OWN_DIRS[app]
    path = f"{base.rstrip('/')}/loreweave-{app}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may have ended before the interpreter does
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it again.

    This cuts the lineage, survives lost executors, and gives the optimizer the
    true size of the table. drop_table() frees it; the rest goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def on_executors(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives value on executors, which needn't have this package: its classes travel with the value."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def drop_table(df: DataFrame) -> None:
    """Delete what materialize() wrote; the table must no longer be needed.

    Spark deletes the shuffle files of finished queries only when the driver collects garbage, which it seldom has cause
    to do, so it is asked to here: a chain of large tables would else keep the files of all its steps.
    """
    path = getattr(df, "_scratch_path", None)
    if path:
        _remove(df.sparkSession, path)
        df.sparkSession.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
