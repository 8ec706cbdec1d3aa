"""Preparing a set of equations: faulty rows set apart with reasons, splits, prompts; as stages that a stopped job goes on from.

A stage's table lies under the digest of all it depends on, and a manifest names the stages that are done. A job that
was stopped anywhere runs again as it is: done stages are read, a stage that was cut off is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import relational as R
from ..sources.readers import DEFAULTS, REQUIRED, equations

CORRUPT = "_corrupt_record"
MANIFEST = "stage string, digest string, rows long"


def loaded(spark: SparkSession, path: str, columns: tuple[str, ...] = REQUIRED, header: bool = True) -> DataFrame:
    """Rows of CSV files as texts, with ``source_file``, the whole line of a malformed one, and ``reasons`` why a row can't be used (none if it can).

    Reasons: malformed (not as many fields as columns), a blank kernel, and a lambda_val, a or b that isn't a number, or a
    domain that ends before it begins. A blank number stands for its default and is none.
    """
    schema = ", ".join(f"{c} string" for c in (*columns, CORRUPT))
    raw = spark.read.schema(schema).csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, escape='"', enforceSchema=True)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    odd = lambda c: ~blank(c) & F.col(c).try_cast("double").isNull()
    fine = F.col(CORRUPT).isNull()
    reasons = F.array_compact(
        F.array(
            F.when(~fine, "malformed"),
            F.when(fine & blank("kernel"), "kernel"),
            *(F.when(fine & odd(c), c) for c in ("lambda_val", "a", "b")),
            F.when(fine & (F.col("a").try_cast("double") >= F.col("b").try_cast("double")), "domain"),
        )
    )
    return raw.withColumn("source_file", F.col("_metadata.file_path")).withColumn("reasons", reasons)


def usable(rows: DataFrame) -> DataFrame:
    """Typed equations of the rows without a reason, with their source file and a digest of their content as equation_id."""
    good = rows.where(F.size("reasons") == 0)
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in REQUIRED)), 256)
    named = good.withColumn("has_solution", F.lit(None).cast("boolean")).withColumn("solution_type", key)
    # two columns that typed equations keep carry the key through, and are what they say only afterwards
    return equations(named).withColumn("equation_id", F.col("solution_type")).drop("has_solution", "solution_type")


def quarantine(rows: DataFrame) -> DataFrame:
    """The other rows as they stood, a row each."""
    return rows.where(F.size("reasons") > 0)


class Job:
    """Stages below one folder in the store that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.built: list[str] = []

    def manifest(self) -> DataFrame:
        """``stage, digest, rows`` of what is done."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def files(self, path: str) -> str:
        """A digest of the names, sizes and times of the files at a path."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").cast("string").alias("at"))
        each = found.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", "path", "length", "at"))), "\n"), 256)).head()
        return each[0]

    def stage(self, name: str, build: Callable[[], DataFrame], depends: list, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        """The table of a stage and its digest: read if it is done for the same dependencies, else built, written (partitioned ``by`` columns) and entered."""
        digest = hashlib.sha256(json.dumps([name, depends, list(by)]).encode()).hexdigest()
        path = f"{self.root}/{name}/{digest}"
        if not self.manifest().where((F.col("stage") == name) & (F.col("digest") == digest)).limit(1).count():
            build().write.mode("overwrite").partitionBy(*by).parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.spark.createDataFrame([(name, digest, rows)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
            self.built.append(name)
        return self.spark.read.parquet(path), digest


def prepare(spark: SparkSession, source: str, root: str, styles: str = "all", notations: tuple[str, ...] | None = None, header: bool = True, settings: dict | None = None) -> dict[str, DataFrame]:
    """The whole preparation of CSV files: loaded, equations, quarantine, splits (partitioned by split) and prompts (by style and notation).

    Shares and seed of the splits, and notation, mode and examples of the prompts, are those of ``settings`` (``readers.settings``).
    """
    settings = settings or DEFAULTS
    shares, shown = settings["split"], settings["prompts"]
    notations = notations or (shown["notation"],)
    job = Job(spark, root)
    rows, at = job.stage("loaded", lambda: loaded(spark, source, header=header), [job.files(source), header])
    good, good_at = job.stage("equations", lambda: usable(rows), [at])
    bad, _ = job.stage("quarantine", lambda: quarantine(rows), [at])
    parts, parts_at = job.stage("splits", lambda: R.split_dataset(good, "equation_id", shares["train"], shares["val"], shares["seed"]), [good_at, shares], ("split",))

    def rendered() -> DataFrame:
        each = [P.prompts(parts, styles, n, shown["mode"], n_examples=shown["examples"]) for n in notations]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    made, _ = job.stage("prompts", rendered, [parts_at, styles, list(notations), shown], ("style", "format_type"))
    return {"loaded": rows, "equations": good, "quarantine": bad, "splits": parts, "prompts": made, "manifest": job.manifest()}
