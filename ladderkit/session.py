"""Session helpers: a tuned local session for tests/bench and checkpoint-dir resolution.

On a cluster the session comes from the platform; the library never creates one
there. It only reads ``spark.checkpoint.dir`` and sets a scratch directory when
that setting is absent (local tests and the bench).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "ladderkit") -> SparkSession:
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    parts = shuffle_partitions or max(8, 2 * int(n))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting a scratch one only if unset.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we honour it. Only a
    ``local`` master, whose threads share one machine, gets a scratch folder when nothing is
    configured; any other master without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="ladderkit-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` as a Parquet copy below ``spark.checkpoint.dir``: cuts the lineage like ``checkpoint()``, and
    the columns of a wide table are read back many times faster than rows serialised one by one.
    ``options`` go to the writer."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ladderkit-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
