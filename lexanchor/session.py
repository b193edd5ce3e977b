"""Session helpers: table access, session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", app: str = "lexanchor", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the frames that need them
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lexanchor_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexanchor-")  # read by the driver only, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lexanchor_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._lexanchor_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over as many partitions as a shuffle has, for costly Python stages.

    Adaptive execution sizes partitions by bytes, which leaves a stage of few bytes but much
    work per row in one task; a fixed number of partitions isn't coalesced.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it survives lost executors.

    The folder comes from the session's ``spark.checkpoint.dir``. Only a session on one machine
    may name none, and gets a temporary folder; on a cluster that raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexanchor-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
