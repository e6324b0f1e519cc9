"""Tables kept in the cluster's shared folder between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of SparkContext.setCheckpointDir. A temporary one only in local mode, where driver and tasks share a machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = sc._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lekhya-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written below the shared folder and read back, for what several steps use: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lekhya/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._lekhya_path = path  # type: ignore[attr-defined]
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing that is still to run makes use."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lekhya_path)  # type: ignore[attr-defined,union-attr]
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # type: ignore[attr-defined]
