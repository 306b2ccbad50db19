"""Sessions and tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI casts, that removes checkpoints nothing refers to; ``conf`` adds or replaces settings."""
    own = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=own | conf).getOrCreate()


def use_checkpoints(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the one the cluster names; a local one only in local sessions."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{use_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores, for work that is heavy beside the bytes it reads: a scan is split by bytes alone,
    so a small file with very many rows would be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
