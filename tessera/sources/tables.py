"""Table sources and sinks: Parquet in, snapshots out."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table. Filters and columns chosen above it reach the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Key-range scan. The bounds are plain comparisons, so Parquet row-group statistics prune."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) <= F.lit(high))
    return df


def clustered_copy(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Write a copy range-clustered by `key`: narrow row-group min/max make it act as a B-tree index."""
    parts = (partitions, key) if partitions else (key,)
    df.repartitionByRange(*parts).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session, all of one machine, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset: it must name a folder that the driver and all executors of {master} share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/tessera"


_made: set[str] = set()


def _delete(spark: SparkSession, paths) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clean() -> None:
    """Staged tables that are left go when the program ends."""
    spark = SparkSession.getActiveSession()
    if spark is None or not _made:
        return
    try:
        _delete(spark, _made)
    except Exception:  # the JVM may be gone already; the folder is then left to its owner
        return


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _made.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no frame still to be run reads; frames that are not staged tables are left alone."""
    paths = {f.staged_path for f in frames if getattr(f, "staged_path", None) in _made}
    if paths:
        _delete(frames[0].sparkSession, paths)
        _made.difference_update(paths)
