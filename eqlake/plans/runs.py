"""Tables of runs: metric files of any shape joined to the runs that should have made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a run's row shows, by the place in its metric file.
METRICS = {"evaluated": ("$.evaluated_count", "long"), "accuracy": ("$.accuracy", "double"), "symbolic_accuracy": ("$.symbolic_accuracy", "double"), "numeric_accuracy": ("$.numeric_accuracy", "double")}


def metric_files(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """``file, metrics``: each JSON file below a path (a folder or pattern) whole, as a VARIANT; null where it isn't JSON (a bare Infinity isn't).

    A file is named by what the pattern ``name`` finds in its path, its last part by default.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("file"), F.try_parse_json("value").alias("metrics"))


def run_table(runs: DataFrame, files: DataFrame, metrics: dict[str, tuple[str, str]] = METRICS) -> DataFrame:
    """``runs`` (run, file) with a state and metrics: done, unreadable, or not_run where there is no file. A metric that a file lacks is null."""
    held = files.select("file", "metrics", F.lit(True).alias("_there"))
    out = runs.join(held, "file", "left")
    state = F.when(F.col("_there").isNull(), "not_run").when(F.col("metrics").isNull(), "unreadable").otherwise("done")
    return out.select(*runs.columns, state.alias("state"), *(F.try_variant_get("metrics", place, kind).alias(name) for name, (place, kind) in metrics.items()))


def type_table(runs: DataFrame, files: DataFrame, types: list[str], metric: str = "accuracy") -> DataFrame:
    """A row a run and a column for each of ``types``: the metric of that type in the run's file; null if it isn't there or the run wasn't made."""
    values = (F.try_variant_get("metrics", f"$.per_type.{kind}.{metric}", "double").alias(kind) for kind in types)
    return runs.join(files, "file", "left").select(*runs.columns, *values)


def long_table(files: DataFrame) -> DataFrame:
    """``file, kind, metric, value``: every number of every type in every file, whatever types a file has."""
    files.createOrReplaceTempView("_eqlake_metric_files")
    return files.sparkSession.sql(
        "SELECT file, k.key AS kind, m.key AS metric, try_variant_get(m.value, '$', 'double') AS value FROM _eqlake_metric_files, "
        "LATERAL variant_explode(try_variant_get(metrics, '$.per_type', 'variant')) k, LATERAL variant_explode(k.value) m"
    )
