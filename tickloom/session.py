"""Session-level settings: trading hours and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SessionSpec:
    """Trading hours in seconds since local midnight."""

    open_sec: int = 23400  # 06:30:00
    close_sec: int = 46800  # 13:00:00

    @property
    def open_minute(self) -> int:
        return self.open_sec // 60


MARKET_HOURS = SessionSpec()
FULL_DAY = SessionSpec(0, 86400)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared work folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without that setting gets
    a temporary folder; on a cluster a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tickloom-")
    return f"{base.rstrip('/')}/tickloom/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage of operators that read their input more than once (see operators.blocks), so that
    chained operators do not recompute everything before them. The table outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
