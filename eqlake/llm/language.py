"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, ship, written

#: log2 of the number of n-gram buckets, n-gram lengths, and smoothing.
BITS = 15
SIZES = (1, 2, 3)
ALPHA = 0.5
#: Training rows of a language at most (those with the smallest hash of doc_id).
ROWS_PER_LANG = 2000
#: Ids of the sample up to which they are broadcast.
SAMPLE_ROWS = 1_000_000
#: Languages in one matrix (64 MB); more are scored matrix by matrix.
BLOCK = 256
#: Ranges of the hash in which rows of a language are counted before any are ranked.
RANGES = 1 << 12
#: Characters that are hashed at a time.
CHUNK = 1 << 20

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def buckets(text: str) -> np.ndarray:
    """Hashed n-grams of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out, shift = [np.zeros(0, np.uint32)], np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(points) - size + 1
            if n > 0:
                h = np.full(n, size, np.uint32)
                for k in range(size):
                    h = (h ^ points[k : k + n]) * np.uint32(_MULTIPLIERS[k])
                    h ^= h >> np.uint32(15)
                out.append((h * np.uint32(0x27D4EB2F)) >> shift)
    return np.concatenate(out).astype(np.int64)


def pieces(text: str):
    """Hashed n-grams of the whole text between two spaces, CHUNK characters at a time, so that a very long text needs bounded memory.

    A piece begins with the characters that n-grams over its edge need; those
    that lie within these alone were counted with the piece before.
    """
    text, over = f" {text.lower()} ", max(SIZES) - 1
    yield buckets(text[:CHUNK])
    for at in range(CHUNK, len(text), CHUNK):
        own = buckets(text[at - over : at + CHUNK])
        again = np.bincount(buckets(text[at - over : at]), minlength=1 << BITS)
        left = np.bincount(own, minlength=1 << BITS) - again
        yield np.repeat(np.arange(1 << BITS), left)


class Model:
    """Log-probabilities of some languages, and their log priors among all."""

    def __init__(self, langs: list[str], counts: np.ndarray, prior: np.ndarray):
        self.langs, self.prior = langs, prior
        logs = np.log((counts + ALPHA) / (counts + ALPHA).sum(1, keepdims=True)) if len(langs) else np.zeros((0, 1 << BITS))
        #: bucket by language, so that a text's rows are gathered at once
        self.matrix = np.ascontiguousarray(logs.T)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its log-probability with the text, log of the sum over languages); ties to the first by name; "und" without a letter."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        if not self.langs:
            return out
        group: list[tuple[int, np.ndarray]] = []
        sums = {k: self.prior.copy() for k, t in enumerate(texts) if t and any(map(str.isalpha, t))}
        held = 0

        def flush():
            sizes = np.array([len(b) for _, b in group])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.add.reduceat(self.matrix[np.concatenate([b for _, b in group])], at, axis=0)
            for (k, _), row in zip(group, rows, strict=True):
                sums[k] += row
            group.clear()

        for k in sums:
            for found in pieces(texts[k]):
                if len(found):
                    group.append((k, found))
                    held += len(found)
                if held >= CHUNK // 4:
                    flush()
                    held = 0
        if group:
            flush()
        for k, row in sums.items():
            best = int(np.argmax(row))
            out[k] = (self.langs[best], float(row[best]), float(row[best] + np.log(np.exp(row - row[best]).sum())))
        return out


def sample(documents: DataFrame, rows_per_lang: int) -> DataFrame:
    """``lang, text`` of the training rows: in each language those with the smallest hash of doc_id, ties by the text's.

    Rows without a doc_id go by the hash of their text. Equal rows count once, so ``rows_per_lang`` bounds
    the rows whatever ids repeat. Rows are counted by language and range of the hash first. Ranges before the
    one in which the bound is reached are in whole; in that one alone rows are
    ranked. So no task ranks a language, and no text is moved but the sample's.
    """
    known = documents.select("doc_id", "text", "lang").where("lang is not null and text is not null").withColumn("_t", F.xxhash64("text"))
    hashed = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))), F.col("_t"))
    # the hash's highest bits, as an ordered range
    place = (F.shiftright(hashed, 64 - RANGES.bit_length() + 1) + RANGES // 2).cast("int")
    counts = known.select("lang", place.alias("range")).groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # RANGES rows a language
    edge = counts.select(F.col("lang").alias("_lang"), "range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    edge = edge.where((F.col("before") < rows_per_lang) & (F.col("before") + F.col("n") >= rows_per_lang)).select("_lang", F.col("range").alias("_edge"), (rows_per_lang - F.col("before")).alias("_left"))
    edge = F.broadcast(written(edge, "edges"))  # a row a language
    rows = known.select("doc_id", "lang", "_t", hashed.alias("_h"), place.alias("_range")).join(edge, F.col("lang") == F.col("_lang"), "left")
    key = ("doc_id", "lang", "_t")
    inner = rows.where(F.col("_range") < F.coalesce("_edge", F.lit(RANGES))).select(*key).distinct()
    at_edge = rows.where(F.col("_range") == F.col("_edge")).select(*key, "_h", "_left").distinct()
    last = at_edge.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "_t")))
    ids = inner.unionByName(last.where(F.col("_rank") <= F.col("_left")).select(*key))
    ids = written(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("_t").alias("_text")), "sample")
    if ids.count() <= SAMPLE_ROWS:
        ids = F.broadcast(ids)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("_t") == F.col("_text"))
    return known.join(ids, same, "left_semi").groupBy(*key).agg(F.first("text").alias("text")).select("lang", "text")


def train(documents: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> list[Model]:
    """A model for every BLOCK languages, counted over the training rows: ``rows_per_lang`` of each language at most.

    Counting is distributed; the driver gets one count for each language and
    bucket, of BLOCK languages at a time.
    """
    ship(documents.sparkSession)

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}

        def out():
            for lang, have in sums.items():
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at], pa.int64())], names=["lang", "bucket", "n"]
                )
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # the last cell counts texts
                have = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                have[-1] += 1
                for found in pieces(text):
                    have[:-1] += np.bincount(found, minlength=1 << BITS)
                if len(sums) > BLOCK:
                    yield from out()
        yield from out()

    parts = sample(documents, rows_per_lang).mapInArrow(count, "lang string, bucket bigint, n bigint")
    cells = written(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "cells")
    texts = {r.lang: r.n for r in cells.where(F.col("bucket") == 1 << BITS).select("lang", "n").collect()}
    langs, total, models = sorted(texts), sum(texts.values()), []
    for at in range(0, len(langs), BLOCK):
        own = langs[at : at + BLOCK]
        got = cells.where((F.col("bucket") < 1 << BITS) & (F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).toArrow()
        counts = np.zeros((len(own), 1 << BITS))
        index = {lang: k for k, lang in enumerate(own)}
        column = got["lang"].combine_chunks().dictionary_encode()
        number = np.array([index[x] for x in column.dictionary.to_pylist()] or [0], np.int64)
        counts[number[column.indices.to_numpy(zero_copy_only=False)], got["bucket"].to_numpy()] = got["n"].to_numpy()
        models.append(Model(own, counts, np.log(np.array([texts[x] for x in own]) / total)))
    return models or [Model([], np.zeros((0, 1 << BITS)), np.zeros(0))]


def identify(documents: DataFrame, models: list[Model]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row by the models, from its whole text alone.

    A text that is null or has no letter is "und" with score 0, as is any text
    if nothing was learned. Repeated rows repeat, ties go to the first
    language by name, and an empty table gives an empty one. Each model's matrix
    is broadcast and held alone; with more than one, rows carry the best so far
    through a written table from one to the next.
    """
    spark = documents.sparkSession
    ship(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    best = "lang string, value double, total double"

    def step(rows: DataFrame, model: Model) -> DataFrame:
        sent = spark.sparkContext.broadcast(model)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                got = sent.value.predict(batch.column(1).to_pylist())
                for k, old in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "value", "total")), strict=True)):
                    if old[0] is not None and old[0] != "und":
                        new = got[k]
                        ahead = old if old[1] >= new[1] else new
                        got[k] = (ahead[0], ahead[1], float(np.logaddexp(old[2], new[2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64())))],
                    names=["doc_id", "text", "lang", "value", "total"],
                )

        return rows.mapInArrow(run, f"doc_id {kind}, text string, {best}")

    rows = documents.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("total"))
    for k, model in enumerate(models):
        rows = step(written(rows, "languages") if k else rows, model)
    score = F.when(F.col("lang") == "und", 0.0).otherwise(F.least(F.exp(F.col("value") - F.col("total")), F.lit(1.0)))
    return rows.select("doc_id", F.col("lang").alias("lang_pred"), score.alias("score"))


def held_out() -> object:
    return remainder(F.col("doc_id"), 4) == 2


def languages(documents: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, predict all; a table without ``lang`` teaches nothing."""
    if "lang" not in documents.columns:
        documents = documents.withColumn("lang", F.lit(None).cast("string"))
    models = train(documents.where(~held_out()))
    return identify(documents, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
