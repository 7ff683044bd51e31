"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="tracelake-")) / "tracelake.zip"  # the driver serves it to the executors
    at.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; make one only where none is set (local runs)."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: cuts the lineage, survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over at least as many partitions as there are cores, by ``keys``.

    A scan of few or small files would leave most cores idle in stages that are heavy on CPU. Where the scan already has
    enough partitions, nothing moves.
    """
    n = cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(2 * n, *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys``, enough for all cores and as many as the session's shuffles have.

    Groups and windows on these keys that follow need no further exchange, up to the next Python stage.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
