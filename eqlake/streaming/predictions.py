"""Responses that arrive over time: read as they come, parsed, and appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import responses as A

SCHEMA = "equation_id string, response string, ground_truth_has_solution boolean, ground_truth_solution_type string, at timestamp"


def arriving(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 1000) -> DataFrame:
    """JSON lines below ``folder``, new files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def parsed(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """With the answer's fields, the first of each equation_id only; state is dropped ``late`` after."""
    first = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["equation_id"])
    return first.withColumn("_a", A.answer(F.col("response"))).select("equation_id", "at", "ground_truth_has_solution", "ground_truth_solution_type", "_a.*")


def accuracy(answers: DataFrame, window: str = "1 hour") -> DataFrame:
    """By window of ``at``: answers, those with both decisions known, and those that agree."""
    both = F.col("ground_truth_has_solution").isNotNull() & F.col("has_solution").isNotNull()
    counts = answers.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.count_if(both).alias("known"), F.count_if(both & (F.col("ground_truth_has_solution") == F.col("has_solution"))).alias("right"))
    return counts.select("window.start", "n", "known", "right")


def appended(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to ``path`` exactly once; a later call goes on from ``checkpoint``."""
    return answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
