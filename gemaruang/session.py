"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gemaruang", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset (tests, one machine) a local one.

    A cluster must name a folder that all executors share; a machine-local folder is only chosen for a local master.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gemaruang-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder: its lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def core_count(spark: SparkSession) -> int:
    """Tasks that can run at once, at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before per-row Python work: a file too small to be split would keep one task busy.

    Only plain reads with fewer partitions than cores are repartitioned (round robin, so no key can be hot). Plans that
    shuffle are left as they are; asking them for their partitions would run them.
    """
    if re.search(r"\b(Join|Aggregate|Window|Sort|Repartition\w*|Generate|Limit)\b", df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = core_count(df.sparkSession)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
