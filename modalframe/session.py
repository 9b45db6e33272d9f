"""Session helpers: a tuned session for local work and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "modalframe") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(SCRATCH_KEY, os.environ.get("MODALFRAME_SCRATCH") or tempfile.mkdtemp(prefix="modalframe-"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is configured (tests)."""
    configured = spark.conf.get(SCRATCH_KEY, None) or spark.sparkContext.getConf().get(SCRATCH_KEY, None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if configured is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
            configured = tempfile.mkdtemp(prefix="modalframe-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame) -> DataFrame:
    """Mark a result that several branches of one plan read, so that it is computed once; a lost block is recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Few rows dealt over all shuffle partitions before each becomes many; otherwise the few input splits do all the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses an iterative result."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
