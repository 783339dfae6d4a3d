"""Session factory, lineage cuts, and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE, last-wins maps, Arrow."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: dict[str, str] = {}
_shipped: set[str] = set()


def _temporary(prefix: str) -> str:
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine that is gone
    after the run, if all of Spark runs on this machine; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + _temporary("spark-lorekeep-")
    return _local[app]


def own_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/lorekeep-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what cut() wrote for this application; DataFrames that still read it fail afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet below scratch_dir and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{_temporary('spark-lorekeep-')}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
