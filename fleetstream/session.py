"""Session settings and the shared folder for written stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGE_ROOT: dict[str, str] = {}


def get_spark(app: str = "fleetstream", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _STAGE_ROOT:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _STAGE_ROOT[app] = tempfile.mkdtemp(prefix="fleetstream-stage-")
    return _STAGE_ROOT[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts the lineage at a stage boundary; a lost executor re-reads files.
    ``codec`` is that of the files, the session's if None.
    """
    path = path or stage_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)
