"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset and there is but one machine (a local master) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='eqlake-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/eqlake/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores: few bytes but much work a row need more tasks than their size asks for."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Paths of the tables that ``written`` made and that still stand, by application.
_standing: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _standing.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._eqlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``written`` returned and nothing reads any more."""
    _delete(df.sparkSession, df._eqlake_path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that read them can't be computed afterwards."""
    for path in list(_standing.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _standing[spark.sparkContext.applicationId].remove(path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files behind a frame that ``written`` returned."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._eqlake_path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
