"""Readers and writers of equation, prompt and prediction tables: files found, read by format, typed, filtered and written."""

from __future__ import annotations

import ast
import glob
import json
import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from ..functions.text import explicit_product, expression_type, flagged_type, number_or_one, truth

FORMATS = {"json": "json", "jsonl": "jsonl", "csv": "csv", "parquet": "parquet"}
#: Columns that an equation file must have: fixed values.
REQUIRED = ("u", "f", "kernel", "lambda_val", "a", "b")
ALIASES = {"u": ("u", "U"), "f": ("f", "F"), "kernel": ("kernel", "Kernel"), "lambda_val": ("lambda_val", "lambda", "Lambda", "lmbda"), "a": ("a", "A"), "b": ("b", "B")}
EVALUATION_POINTS = "x_values array<double>, u_values array<double>, u_values_samples array<array<double>>, constant_samples array<double>, n_points int"


def format_of(path: str) -> str:
    """By extension; an unknown one is read as JSON."""
    return FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "json")


def read(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None, key: str | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """A table by format: JSON arrays, single objects or a ``data`` wrapper, JSON lines, CSV with a header, Parquet.

    With ``schema`` a file isn't scanned to find its types. A local path that doesn't exist gives an empty table (of the
    schema, or of no columns). With ``limit``, the first rows by ``key`` are kept.
    """
    kind = kind or format_of(path)
    if "://" not in path and not glob.glob(path):
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "jsonl":
        out = reader.option("recursiveFileLookup", True).json(path)
    elif kind == "json":
        out = reader.option("multiLine", True).json(path)
        if out.columns == ["data"]:
            out = out.select(F.inline("data"))
    elif kind == "csv":
        out = reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
    elif kind == "parquet":
        out = reader.parquet(path)
    else:
        raise ValueError(f"unknown format: {kind}")
    if limit is not None:
        out = out.orderBy(key or out.columns[0]).limit(limit)
    return out


def write(df: DataFrame, path: str, kind: str | None = None) -> None:
    """By format. JSON leaves out null fields; CSV gets arrays, maps and structs as JSON text."""
    kind = kind or format_of(path)
    if kind == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema)).write.csv(path, header=True, emptyValue="", escape='"')
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        df.write.json(path)


def write_metrics(report: DataFrame, path: str, key: str) -> dict:
    """A small report (a row a key) as one JSON file on the driver, and as a dict."""
    out = {r[key]: {k: v for k, v in r.asDict(True).items() if k != key and v is not None} for r in report.collect()}
    Path(path).write_text(json.dumps(out, indent=2, default=str, sort_keys=True), encoding="utf-8")
    return out


def batches(df: DataFrame, size: int = 1) -> Iterator[list[dict]]:
    """Rows as dicts, ``size`` at a time, one partition on the driver at a time."""
    held: list[dict] = []
    for row in df.toLocalIterator():
        held.append(row.asDict(True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Column ``name``: places from 0 without gaps, in the order in which rows are read.

    A row's partition and place in it come with it; rows before each partition are counted, one number a partition.
    """
    spot = df.withColumn("_spot", F.monotonically_increasing_id())
    part, place = F.shiftright("_spot", 33), F.col("_spot").bitwiseAND((1 << 33) - 1)
    counts = {r._part: r.n for r in spot.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}
    ahead, sums = 0, {}
    for k in sorted(counts):
        sums[k] = ahead
        ahead += counts[k]
    rows = df.sparkSession.createDataFrame([(k, v) for k, v in sums.items()], "_part long, _ahead long")
    return spot.withColumn("_part", part).join(F.broadcast(rows), "_part").withColumn(name, place + F.col("_ahead")).drop("_part", "_ahead", "_spot")


def at(df: DataFrame, index: int) -> dict | None:
    """The row at a place from 0; None beyond the end."""
    row = numbered(df, "_at").where(F.col("_at") == index).drop("_at").first()
    return None if row is None else row.asDict(True)


def equation_files(folder: str) -> list[str]:
    """CSV and JSON files of a folder by name, those below ``formatted`` alone if there are any; no validation reports.

    Where that folder is empty, base and augmented files go too. A single file is itself.
    """
    if os.path.isfile(folder):
        return [folder] if format_of(folder) in ("csv", "json") and folder.endswith((".csv", ".json")) else []

    def those(where: str) -> list[str]:
        found = sorted(p for end in ("csv", "json") for p in glob.glob(os.path.join(where, f"*.{end}")))
        return [p for p in found if "validation_report" not in os.path.basename(p).lower()]

    special = os.path.join(folder, "formatted")
    if found := those(special):
        return found
    return [p for p in those(folder) if not os.path.isdir(special) or not {"base", "augmented"} & set(re.findall("base|augmented", os.path.basename(p)))]


def newest(pattern: str) -> str | None:
    """The last by name of the paths that match."""
    return max(glob.glob(pattern), default=None)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, md5`` of files, read where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))


def extracted(path: str) -> str:
    """The folder beside a zip archive into which it was unpacked; any other file as it is. Members that lead outside are an error."""
    if not zipfile.is_zipfile(path):
        return path
    target = os.path.realpath(os.path.splitext(path)[0])
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            if os.path.commonpath([target, os.path.realpath(os.path.join(target, name))]) != target:
                raise ValueError(f"{name} leads outside the archive")
        archive.extractall(target)
    return target


def sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, or all of fewer, in the hash order of their keys: a top-n by partition, then of these."""
    from ..operators.relational import hash_order

    return df.orderBy(hash_order(*keys, seed=seed), *keys).limit(n)


def equations(raw: DataFrame) -> DataFrame:
    """Typed equations from text columns under any of their aliases, implicit products made explicit.

    A type stands as its column says (``u_type``), else as the flags u_is_polynomial and so on say, else by the text. Degrees are 0 if they are missing.
    """
    have = set(raw.columns)

    def of(name: str):
        found = [F.col(f"`{x}`").cast("string") for x in ALIASES[name] if x in have]
        return F.trim(F.coalesce(*found)) if found else F.lit(None).cast("string")

    def kind(name: str) -> Column:
        flags = {k: truth(F.col(f"{name}_is_{k}").cast("string")) for k in ("polynomial", "trigonometric", "hyperbolic", "exponential") if f"{name}_is_{k}" in have}
        text = expression_type(explicit_product(of(name)))
        return F.when(F.greatest(*flags.values()) if len(flags) > 1 else next(iter(flags.values())), flagged_type(flags)).otherwise(text) if flags else text

    degree = lambda c: F.coalesce(F.col(f"{c}_max_degree").try_cast("int"), F.lit(0)) if f"{c}_max_degree" in have else F.lit(0)
    return raw.select(
        *(explicit_product(of(c)).alias(c) for c in ("u", "f", "kernel")),
        *(number_or_one(of(c)).alias(c) for c in ("lambda_val", "a", "b")),
        *(kind(c).alias(f"{c}_type") for c in ("u", "f", "kernel")),
        *(degree(c).alias(f"{c}_max_degree") for c in ("u", "f", "kernel")),
        *(F.col(c) for c in ("has_solution", "solution_type", "evaluation_points") if c in have),
    )


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with an equation_id: their own, or eq_ and their place in the file. A file without a required column is an error."""
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"missing required columns: {missing}")
    made = F.concat(F.lit("eq_"), F.col("_at").cast("string"))
    own = F.coalesce(F.col("equation_id").cast("string"), made) if "equation_id" in rows.columns else made
    return numbered(rows, "_at").withColumn("equation_id", own).drop("_at")


def points_of(text: Column) -> Column:
    """Stored evaluation points from JSON text or the literal of a dict; null if neither can be read."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    one = F.from_json(text, EVALUATION_POINTS)
    return F.coalesce(F.when(one["x_values"].isNotNull(), one), F.when(F.from_json(plain, EVALUATION_POINTS)["x_values"].isNotNull(), F.from_json(plain, EVALUATION_POINTS)))


def literal(text: str | None) -> dict | None:
    """A dict from JSON text or a literal; None otherwise."""
    for load in (json.loads, ast.literal_eval):
        try:
            out = load((text or "").strip())
            return out if isinstance(out, dict) else None
        except (ValueError, SyntaxError):
            continue
    return None


def filtered(df: DataFrame, max_degree: int | None = None, has_solution: bool | None = None, **equal) -> DataFrame:
    """Rows that meet every given condition: the largest degree, whether there is a solution, and equality of columns (u_type and so on)."""
    out = df
    if max_degree is not None:
        degrees = [F.coalesce(F.col(c), F.lit(0)) for c in ("u_max_degree", "f_max_degree", "kernel_max_degree") if c in df.columns]
        out = out.where(F.greatest(*degrees, F.lit(0)) <= max_degree)
    if has_solution is not None:
        out = out.where(F.col("has_solution") == has_solution)
    for column, value in equal.items():
        out = out.where(F.col(column).eqNullSafe(F.lit(value)))
    return out


def without(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` but for these columns, whether it has them or not."""
    return df.drop(*columns)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Those of ``columns`` that there are, in their order."""
    return df.select(*(c for c in columns if c in df.columns))


def settings(path: str | None = None) -> dict:
    """DEFAULTS with what a YAML or JSON file says, section by section; an unknown section is an error."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML settings need PyYAML; JSON works without") from e
            given = yaml.safe_load(text) or {}
        if unknown := set(given) - set(out):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        for section, values in given.items():
            out[section] |= values
    return out


def save_settings(values: dict, path: str) -> None:
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True), encoding="utf-8")


#: Defaults that change results.
DEFAULTS = {
    "split": {"train": 0.8, "val": 0.1, "seed": 42},
    "sample": {"per_type": 1, "seed": 42},
    "augmentation": {"multiplier": 2.0, "strategies": ["none_solution", "approx_coef", "discrete_points"]},
    "evaluation": {"symbolic_tolerance": 1e-10, "numeric_tolerance": 1e-6, "points": 100, "type_tolerances": {"series": 1e-2, "approx_coef": 1e-3}, "series_target": 4, "family_samples": [-1.0, 1.0, 2.0]},
    "solvers": {"rounds": 1, "tolerance": 1e-6, "points": 12},
    "scripts": {"timeout": 60, "rounds": 1},
    "prompts": {"examples": 2, "notation": "infix", "mode": "none"},
}
