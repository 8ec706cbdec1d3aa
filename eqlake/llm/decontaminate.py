"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark items. For each
pattern length a table gives, for a block of words, how far the search may
move on without missing an occurrence; a block that can end a pattern selects
a bucket by itself and by the pattern's first block; what the bucket holds is
compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, attach, discard, ship, text_bytes, unused, written

WINDOW = 13
#: Bytes of benchmark words that one pass holds in memory; larger benchmarks take several passes.
BLOCK_BYTES = 2 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Occurrences of word windows of ``items`` ((id or None, text) pairs)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                owners.setdefault(tuple(words[at : at + size]), set()).add(k)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for pattern in owners:
            by_length.setdefault(len(pattern), []).append(pattern)
        self.tables = []
        for length, patterns in sorted(by_length.items()):
            block = 3 if length >= 6 else 2 if length >= 3 else 1
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
            for pattern in patterns:
                for end in range(block, length + 1):
                    part = pattern[end - block : end]
                    shift[part] = min(shift.get(part, length), length - end)
                bucket = buckets.setdefault(pattern[length - block :], {})
                bucket.setdefault(pattern[:block], []).append((list(pattern), tuple(owners[pattern])))
            self.tables.append((length, block, shift, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, item indexes) of every occurrence of every pattern."""
        n = len(words)
        for length, block, shift, buckets in self.tables:
            free, at, get = length - block + 1, length, shift.get
            while at <= n:
                part = tuple(words[at - block : at])
                step = get(part, free)
                if step:
                    at += step
                    continue
                start = at - length
                for pattern, owners in buckets[part].get(tuple(words[start : start + block]), ()):
                    if words[start:at] == pattern:
                        yield start, at, owners
                at += 1


_built: dict[str, WuManber] = {}


def _matcher(broadcast) -> WuManber:
    """The tables of a broadcast benchmark block, built once a worker; only the latest stays."""
    window, items = broadcast.value
    key = f"{len(items)}/{hash(tuple(items))}/{window}"
    if key not in _built:
        _built.clear()
        _built[key] = WuManber(items, window)
    return _built[key]


def hits(matcher: WuManber, text: bytes) -> tuple[int, list[int], set[str]]:
    """Number of words, flat starts and ends of merged hit spans, ids of items that occur."""
    words = words_of(text)
    marks, found = None, set()
    for start, end, owners in matcher.find(words):
        if marks is None:
            marks = bytearray(len(words))
        marks[start:end] = b"\x01" * (end - start)
        found.update(owners)
    spans: list[int] = []
    if marks is not None:
        at = marks.find(1)
        while at >= 0:
            stop = marks.find(0, at)
            stop = len(marks) if stop < 0 else stop
            spans += (at, stop)
            at = marks.find(1, stop)
    return len(words), spans, {matcher.ids[k] for k in found if matcher.ids[k] is not None}


def merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def cut(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """The words of an item in pieces of about ``most`` bytes that overlap by all but one word of a window."""
    words = words_of(text)
    at = 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (size < most or end < at + window):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end])
        if end == len(words):
            return
        at = end - window + 1


def pieces(benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``i, t``: distinct pieces of all items, none of which is much longer than a block."""
    ship(benchmark.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                out = list(cut(text, window, block_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(out), pa.string()), pa.array(out, pa.binary()).cast(pa.string())], names=["i", "t"])

    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    return items.mapInArrow(run, "i string, t string").distinct()


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of about ``block_bytes``, one on the driver at a time; none if it has no words."""
    items = written(pieces(benchmark, window, block_bytes), "benchmark")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r.i, r.t.encode()) for r in part.collect()]
    discard(items)


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``documents`` (any columns, ``text`` among them) with three columns added, and their names.

    These are the number of words; flat starts and ends of hit word spans; ids
    of the items that occur, sorted as text. Names that the table has already get
    underscores before them. A null or empty text has no words. Rows are
    independent: repeated rows give repeated results, an empty table an empty
    one, and a null item id marks words but isn't listed. A benchmark over
    ``block_bytes`` is searched block by block, so that workers hold one block at a
    time: each pass reads the texts alone and writes only hits, addressed by
    content, which are then merged and joined back.
    """
    spark = documents.sparkSession
    ship(spark)
    names = unused(documents.columns, "_n_words", "_spans", "_items")
    blocks = blocks_of(benchmark, window, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _search(documents, names, window, first), names
    found = [_hits(documents, window, first), _hits(documents, window, second)]
    found += [_hits(documents, window, items) for items in blocks]
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    blob, spans, items = unused(documents.columns + names, "_blob", "_found_spans", "_found_items")
    grouped = union.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items))
    side = written(grouped.withColumnRenamed("blob", blob), "hits")
    rows = attach(documents.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)), side, blob).drop(blob)
    return _merge(rows, names, spans, items), names


def _schema(fields, names: list[str]) -> T.StructType:
    kinds = (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()))
    return T.StructType(list(fields) + [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])


def _search(documents: DataFrame, names: list[str], window: int, items: list) -> DataFrame:
    """All rows against one block."""
    sent = documents.sparkSession.sparkContext.broadcast((window, items))
    columns = documents.columns

    def run(batches):
        import pyarrow as pa

        matcher = _matcher(sent)
        for batch in batches:
            found = [hits(matcher, t) for t in text_bytes(batch.column(columns.index("text")))]
            added = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=columns + names)

    return documents.mapInArrow(run, _schema(documents.schema.fields, names))


def _hits(documents: DataFrame, window: int, items: list) -> DataFrame:
    """``blob, spans, items`` of each different text that has a hit in one block, written."""
    sent = documents.sparkSession.sparkContext.broadcast((window, items))

    def run(batches):
        import hashlib

        import pyarrow as pa

        matcher = _matcher(sent)
        for batch in batches:
            out = [(hashlib.sha256(t).hexdigest(), s, sorted(i)) for t in text_bytes(batch.column(0)) for _, s, i in [hits(matcher, t)] if s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))],
                names=["blob", "spans", "items"],
            )

    rows = documents.select("text").mapInArrow(run, "blob string, spans array<bigint>, items array<string>")
    return written(rows.groupBy("blob").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")


def _merge(rows: DataFrame, names: list[str], spans: str, items: str) -> DataFrame:
    """``rows`` with words counted and the blocks' spans merged."""
    columns = [c for c in rows.columns if c not in (spans, items)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = [len(words_of(t)) for t in text_bytes(batch.column("text"))]
            flat = [merged(s or []) for s in batch.column(spans).to_pylist()]
            ids = [i or [] for i in batch.column(items).to_pylist()]
            added = [pa.array(n, pa.int64()), pa.array(flat, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], names=columns + names)

    fields = [f for f in rows.schema.fields if f.name in columns]
    return rows.mapInArrow(run, _schema(fields, names))


def _hit_words(spans: str):
    """Over s1, e1, s2, e2, ... the alternating difference is the sum of the lengths."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: x - a)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items that occur, and whether a twentieth of its words are hit."""
    found, (n_words, spans, items) = scan(documents.select("doc_id", "text"), benchmark, window, block_bytes)
    hit = _hit_words(spans)
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col(n_words))).alias("contaminated"),
        F.col(spans).alias("hit_spans"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, with all their columns, that aren't contaminated."""
    found, (n_words, spans, _) = scan(documents, benchmark, window, block_bytes)
    hit = _hit_words(spans)
    return found.where(~((hit > 0) & (hit * 20 >= F.col(n_words)))).select(*documents.columns)
