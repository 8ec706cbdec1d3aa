"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..shipping import ship as ship
from ..staging import bytes_of as bytes_of
from ..staging import discard as discard
from ..staging import scratch as scratch
from ..staging import sweep as sweep
from ..staging import written as written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes.translate table: A-Z to a-z, the other bytes as they are.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: bytes.translate table: A-Z to a-z, every other ASCII byte that is no digit or letter to a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, with underscores put before those that a table's columns already have."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a counted side up to which it is broadcast, and the copies of it that a larger one is dealt in.
BROADCAST_ROWS, SALTS = 100_000, 16


def attach(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with the written table ``side``, in which ``key`` is unique.

    A side of few rows is broadcast, after they were counted. A larger one is
    joined by key and salt, so that a key that holds many rows is dealt to SALTS tasks.
    """
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    salt = unused(rows.columns + side.columns, "_salt")[0]
    copies = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [key, salt], "left").drop(salt)


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the driver has planned, whose number the caller bounds, as a frame without Python on the executors."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def fold(col: Column) -> Column:
    """A-Z to lower case, nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def remainder(col: Column, of: int) -> Column:
    """crc32 of the value as text, modulo ``of``; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % of


def text_bytes(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes, null as the empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
