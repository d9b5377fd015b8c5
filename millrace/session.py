"""Session construction, code shipping and the shared folder that survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Most buckets that Spark's default setting lets a table have.
MOST_BUCKETS = 100_000
_PACKAGE = Path(__file__).resolve().parent


def get_spark(app: str = "millrace", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the operators assume (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers that don't share the driver's path; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    sc._millrace_shipped = True
    folder = Path(tempfile.mkdtemp(prefix="millrace"))
    archive = folder / "millrace_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path("millrace") / p.relative_to(_PACKAGE)))
    sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.

    Only in local mode may it be unset: then a temporary folder is taken. A cluster without the setting is an error, since
    executors would write to disks of their own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark.sparkContext, "_millrace_shared", None)
        if d is None:
            d = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
            spark.sparkContext._millrace_shared = d
    return d.rstrip("/")


def cut(df: DataFrame, name: str = "cut", drop: Iterable[DataFrame] = ()) -> DataFrame:
    """Write *df* to a table in the shared folder and read it back: a lineage cut that outlives executors.

    The tables in *drop*, made by earlier cuts and needed for nothing but this one, go at once; all others when the driver
    process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    for old in drop:
        if name := getattr(old, "_millrace_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, old._millrace_path)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As :func:`cut`, with the rows of one *key* in one bucket: grouping the table by *key* needs no shuffle of it. There
    are as many buckets as partitions, and no fewer than the shuffle width, or else Spark would shuffle it all the same."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    buckets = min(MOST_BUCKETS, max(df.rdd.getNumPartitions(), shuffle_width(spark)))
    table = f"millrace_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out._millrace_path, out._millrace_table = path, table
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    _left.add(path)
    if len(_left) == 1:
        atexit.register(_remove_all, spark)
    return path


_left: set[str] = set()


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder; no error if it isn't there."""
    _left.discard(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all(spark: SparkSession) -> None:
    for path in list(_left):
        try:
            remove(spark, path)
        except Exception:  # the context may be gone already
            return


def shuffle_width(spark: SparkSession) -> int:
    """Number of reduce partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
