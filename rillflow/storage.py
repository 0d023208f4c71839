"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where that is unset, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet and reads it back: iterations keep a short lineage and outlive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/rillflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
