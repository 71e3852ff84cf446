"""Session helpers: lineage cutting in the shared checkpoint folder, and spreading small scans over the cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "folioscope", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Checkpoint files go with the frames that need them; a cluster's session sets the same.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a temporary one, removed at exit."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the files, which survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of fewer partitions than cores one partition a core; larger scans pass without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    shared = str(spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    # Spark serves the file from the driver; it lies in the shared folder where that is one of the file system.
    if shared.startswith("/"):
        Path(shared).mkdir(parents=True, exist_ok=True)
    target = Path(tempfile.mkdtemp(prefix="folioscope-code-", dir=shared if shared.startswith("/") else None)) / "folioscope.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._folioscope_shipped = True
