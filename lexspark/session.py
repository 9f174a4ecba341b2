"""Helpers shared by all operators: sessions, tables, lineage cuts and size-checked joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) has a
    temporary one of its own; a cluster must name one, as a folder of one machine would hold only a part of a table."""
    if where := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", ""):
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        _OWN_DIRS[app] = "file://" + where
    return _OWN_DIRS[app]


def written_dir(spark: SparkSession) -> str:
    """The folder of this application's own tables within the shared one."""
    return f"{shared_dir(spark)}/lexspark-{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that ``written`` made in this application; for its end, as results read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{written_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_join(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` only when its counted rows are within ``limit``, and shuffles beyond it.

    ``small`` is counted here (unless ``rows`` is given), so it should be a written table or cheap to compute.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= limit else small.hint("merge"), on, how)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose few files would leave cores idle, over as many partitions as there are cores; larger ones as they are.

    For scans only: the partitions of a plan with shuffles are known when it runs.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def partitions(spark: SparkSession) -> int:
    """Partitions for Python work after a shuffle, where merging small ones would leave cores idle."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
