"""Vector compression: product codes in exact integers, entries found by Exponion search.

Each component becomes floor(scale * x). A vector is cut into equal parts, each
coded by the index of the nearest entry of that part's codebook. A search starts
at the entry found last and scans that entry's neighbours by distance: an entry
farther from it than twice the part's own distance can't be nearer, so the scan
ends there; neighbours are taken in rings whose width doubles. Distances are
squared integers and equal ones go to the lower index, so the result is the
exhaustive one. Codebooks are a bounded size (parts x entries x part length) and
their sums alone come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Rows that a task holds as integers at a time.
BLOCK = 8192

#: Integers below it have squared distances that fit 64 bits up to 8,192 components; beyond, Python's integers take over.
SMALL = 1 << 20

#: Sums leave a task in digits of this base, so that they add up exactly as 64-bit sums over two billion tasks.
BASE = 1 << 32


class Codebooks(NamedTuple):
    """Rounds of codebooks, first to final: integer lists by part, entry and position; ``width`` is a part's length."""

    rounds: list
    width: int

    def arrays(self) -> list[np.ndarray]:
        return [integers(np.array(book, object)) for book in self.rounds]

    def digest(self) -> str:
        """sha256, in hex, of the final entries' integers by part, entry and position, joined by commas."""
        final = self.rounds[-1] if self.rounds else []
        return hashlib.sha256(",".join(str(v) for part in final for entry in part for v in entry).encode()).hexdigest()


def integers(values: np.ndarray) -> np.ndarray:
    """64-bit where distances surely fit, else as they are (Python's integers)."""
    return values.astype(np.int64) if not values.size or max(-values.min(), values.max()) < SMALL else values


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, a component at a time."""
    out = None
    for mine, theirs in zip(rows.T, entries.T, strict=True):
        off = mine[:, None] - theirs[None]
        off *= off
        out = off if out is None else np.add(out, off, out=out)
    return out


def nearest(rows: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, ties to the lower index, and its squared distance; ``start`` is where each search begins."""
    if rows.dtype != book.dtype:
        rows, book = rows.astype(object), book.astype(object)
    between = distances(book, book)
    found, off = start.copy(), ((rows - book[start]) ** 2).sum(-1)
    reach = off * 4
    by_start = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[by_start], np.arange(len(book) + 1))
    for entry in range(len(book)):
        group = by_start[bounds[entry] : bounds[entry + 1]]
        if not len(group):
            continue
        group = group[np.argsort(-reach[group], kind="stable")]
        falling = -reach[group]
        order = np.argsort(between[entry], kind="stable")
        lo, width = 0, 1
        while lo < len(order):
            # rows whose radius holds the ring's first entry; the others are done
            group = group[: np.searchsorted(falling[: len(group)], -between[entry][order[lo]], side="right")]
            if not len(group):
                break
            ring = order[lo : lo + width]
            d = distances(rows[group], book[ring])
            least = d.min(1)
            index = np.where(d == least[:, None], ring, len(book)).min(1)
            better = (least < off[group]) | ((least == off[group]) & (index < found[group]))
            off[group[better]], found[group[better]] = least[better], index[better]
            lo, width = lo + width, width * 2
    return found, off


def _codes(values: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Final entries (rows, parts) and squared distances summed over parts; each round's search starts at the entries of the one before."""
    codes = np.zeros(values.shape[:2], np.int64)
    total = np.zeros(len(values), values.dtype)
    for part in range(values.shape[1]):
        found = codes[:, part]
        for book in books:
            found, off = nearest(values[:, part], book[part], found)
        codes[:, part] = found
        total = total + off
    return codes, total


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int, scale: int):
    """(the batches' other columns, integers by row, part and position) of BLOCK rows or so."""

    def made(held):
        table = pa.Table.from_batches(held)
        flat = pa.concat_arrays([c.flatten() for c in table.column("vector").chunks]).cast(pa.float64()).to_numpy(zero_copy_only=False)
        scaled = np.floor(flat * scale)
        if len(scaled) and not np.abs(scaled).max() < 1 << 62:
            values = np.array([int(v) if np.isfinite(v) else _floor(x, scale) for v, x in zip(scaled, flat, strict=True)], object)
        else:
            values = scaled.astype(np.int64)
            if len(values) and np.abs(values).max() >= SMALL:
                values = values.astype(object)
        return table.drop_columns("vector"), values.reshape(-1, parts, width)

    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            held.append(piece)
            rows += piece.num_rows
            if rows >= BLOCK:
                yield made(held)
                held, rows = [], 0
    if rows:
        yield made(held)


def _floor(x: float, scale: int) -> int:
    """floor(scale * x) where the product leaves the range of doubles."""
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def _digits(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        value, digit = divmod(value, BASE)
        out.append(sign * digit)
    return out


def vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, vector) with a usable vector, and a part's length.

    Left out: null vectors, null or non-finite components, empty vectors, and
    lengths other than that of the first such vector by id whose length ``parts`` divides.
    """
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    )
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).head()
    width = first.n // parts if first else 0
    return kept.where(F.size("vector") == width * parts), width


def fit(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of every round: first the parts of the ``entries`` smallest ids, then means, floored, of what is nearest to each entry.

    Of equal ids the smaller vector comes first; with fewer rows there are fewer
    entries. Each round is one pass that reduces sums in the tasks.
    """
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select(F.col("vector").cast("array<double>")).collect()
    if not first:
        return Codebooks([], width)
    table = [[_floor(x, scale) for x in r.vector] for r in first]
    made = Codebooks([[[row[p * width : (p + 1) * width] for row in table] for p in range(parts)]], width)
    ship(kept.sparkSession)
    for _ in range(rounds):
        book = made.rounds[-1]
        sums: dict[int, int] = {}
        for slot, digit, value in _sums(kept, made, parts, scale).collect():
            sums[slot] = sums.get(slot, 0) + value * BASE**digit
        size = width + 1  # a count, then sums
        at = lambda p, e, k: sums.get((p * len(table) + e) * size + k, 0)  # noqa: E731, B023
        made = Codebooks(
            [*made.rounds, [[[at(p, e, k + 1) // at(p, e, 0) for k in range(width)] if at(p, e, 0) else book[p][e] for e in range(len(table))] for p in range(parts)]],
            width,
        )
    return made


def _sums(kept: DataFrame, made: Codebooks, parts: int, scale: int) -> DataFrame:
    """Counts and sums of the parts nearest to each entry, as (slot, digit, value); at most parts x entries x (width + 1) slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total = made.arrays(), None
        for _, values in _blocks(batches, parts, made.width, scale):
            codes, _ = _codes(values, books)
            if total is None:
                total = np.zeros((parts, len(made.rounds[0][0]), made.width + 1), object)
            for part in range(parts):
                near = np.argsort(codes[:, part], kind="stable")
                used, begins, counts = np.unique(codes[near, part], return_index=True, return_counts=True)
                total[part, used, 0] += counts.astype(object)
                total[part, used, 1:] += np.add.reduceat(values[near, part], begins, axis=0).astype(object)
        if total is None:
            return
        rows = [(slot, k, digit) for slot, value in enumerate(total.ravel()) for k, digit in enumerate(_digits(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["slot", "digit", "value"])

    return kept.select("vector").mapInArrow(run, "slot long, digit int, value long").groupBy("slot", "digit").agg(F.sum("value").alias("value"))


def encode(kept: DataFrame, made: Codebooks, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, code, error): entry indexes in part order as a byte each, and the squared distance to the coded vector.

    The error is null where it doesn't fit 64 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = made.arrays()
        for others, values in _blocks(batches, parts, made.width, scale):
            codes, errors = _codes(values, books)
            out = others.append_column("code", pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()))
            out = out.append_column("error", pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64()))
            yield from out.to_batches()

    if len(made.rounds) and len(made.rounds[0][0]) > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    ship(kept.sparkSession)
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the errors of equal labels (nulls together) summed; sums are made in the tasks first, and a large label is dealt to several tasks."""
    key = F.concat(F.when(F.col("label").isNull(), "n").otherwise("v"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    keyed = codes.withColumn("label_key", key)
    sums = keyed.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    side = written(sums.withColumn("label_error", F.expr("try_cast(label_error AS long)")), "label-errors")
    return attach(keyed, side, "label_key").drop("label_key")


def reconstructed(codes: DataFrame, made: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approximation``, the vector that a code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = np.array(made.rounds[-1], float) / scale if made.rounds else None
        for batch in batches:
            back = [np.concatenate([final[p][e] for p, e in enumerate(c)]) for c in batch.column("code").to_pylist()]
            yield batch.append_column("approximation", pa.array(back, pa.list_(pa.float64())))

    ship(codes.sparkSession)
    shape = ", ".join(f"{n} {t}" for n, t in codes.dtypes)
    return codes.mapInArrow(run, f"{shape}, approximation array<double>")
