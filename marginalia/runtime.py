"""Session helpers: lineage cuts and table access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's own checkpoint folder; only a local session may do without (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    The files are in shared storage, so a lost executor costs nothing but a new read.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input that came as fewer splits than there are cores.

    Such an input is at most a split per core, so moving its rows costs little; any larger one is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() * 2 <= cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, for workers that can't import it."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(suffix=".zip", prefix="marginalia-", delete=False) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out.name)
    sc._marginalia_shipped = True
    return spark
