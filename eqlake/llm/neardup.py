"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and verification.

A document is its set of word shingles. A SetSketch register is the largest of
floor(1 - log_b h) over the set, h being exponentially distributed hashes; so it
follows from their minimum, merges by maximum, and two sets agree in a register
about as often as their Jaccard similarity says. Bands of register values deal
similar sets into common buckets. Of pairs that are compared, the counts of
larger, smaller and equal registers give the most likely similarity; those
that can reach the threshold are verified on their full sets.

Equal sets form a class and are compared once. In a bucket each class is
compared with one leader first, then with a few spread members of the bucket's
largest component. Only classes that are then still in different components of
one bucket are compared with each other, if they share one of their rarest
shingles, which all that reach the threshold do. So a large group of copies
costs a few comparisons a member, and no link between components is lost that
a common bucket shows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, ship, text_bytes, written

SHINGLE = 2
THRESHOLD = 80
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Pairs whose most likely similarity is lower than the threshold by more than this (5 deviations) aren't verified.
MARGIN = 0.13
#: Cells by which shingles are ordered, rare ones first; a power of two, so that counts have a fixed size (2 MB).
CELLS = 1 << 18

_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hash of each word; the most frequent words come early, so a bound on what is kept costs little."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


_words = _WordHashes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_BYTES).split()


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words has its whole sequence as one."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = mix(h[: len(h) - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = mix(out + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def shingle_set(text: bytes, size: int = SHINGLE) -> frozenset:
    """The shingles themselves, for verification."""
    words = words_of(text)
    size = min(size, len(words)) or 1
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False))


def class_of(hashes: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MULTIPLIERS).min(0), out=least)
    uniform = (least.astype(np.float64) + 1) * 2.0**-64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)) + 20_000, 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    mixed = mix(registers.astype(np.uint64) * _BAND_MULTIPLIERS).reshape(BANDS, ROWS).sum(1)
    return mix(mixed + _BAND_SEEDS).view(np.int64)


_GRID = np.linspace(0, 1, 201)


def _crossing(x: np.ndarray) -> np.ndarray:
    """Chance that one register exceeds the other, from the share of elements that only one set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def likeliest(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """Most likely Jaccard similarity given both sketches and both sizes."""
    more, less = int((a > b).sum()), int((a < b).sum())
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    j = _GRID[_GRID <= min(u / v, v / u) + 1e-9]
    p, q = _crossing(u - v * j), _crossing(v - u * j)
    tiny = 1e-12
    value = more * np.log(p + tiny) + less * np.log(q + tiny) + (len(a) - more - less) * np.log(np.maximum(1 - p - q, tiny))
    return float(j[int(np.argmax(value))])


def signatures(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n, node, sketch, bands``: size, class and sketch of each row's set (null class if it is empty)."""
    ship(documents.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for named, text in zip(batch.column(0).is_valid().to_pylist(), text_bytes(batch.column(1)), strict=True):
                h = shingles(text, size)
                if len(h) and not named:
                    rows.append((len(h), None, None, None))
                elif len(h):
                    s = sketch(h)
                    rows.append((len(h), class_of(h), s.tobytes(), band_keys(s)))
                else:
                    rows.append((0, None, None, None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "node", "sketch", "bands"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, node binary, sketch binary, bands array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): root is the least node that can be reached.

    Large-star and small-star steps in turn, each a grouping by node with the
    minimum found first, until nothing changes; each pair of steps ends in a
    written table.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def star(both: DataFrame, larger_only: bool) -> DataFrame:
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(low, "a")
        if larger_only:  # neighbours above a, to the least of its neighbourhood
            out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a and its neighbours below, to the least of them
            out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(frame: DataFrame):
        return tuple(frame.agg(F.count("*"), F.sum(F.crc32("a")), F.sum(F.crc32(F.concat("a", "b"))), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = mark(edges)
    while True:
        large = star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        edges = written(star(large, False), "links")
        before, now = now, mark(edges)
        if before == now:
            break
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar: first by sketch and size, then on the full sets of words."""
    ship(pairs.sparkSession)
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    # sizes that differ too much can't be similar enough
    sized = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {THRESHOLD} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def likely(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = [
                likeliest(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n) * 100 >= THRESHOLD - 100 * MARGIN
                for x, y, m, n in zip(sa, sb, na, nb, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = sized.mapInArrow(likely, "a binary, b binary")
    full = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def exact(batches):
        import pyarrow as pa

        known: dict[bytes, frozenset] = {}

        def of(node, text):
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = shingle_set(text, size)
            return known[node]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), text_bytes(batch.column("ta")), text_bytes(batch.column("tb")), strict=True):
                x, y = of(a, ta), of(b, tb)
                both = len(x & y)
                keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(exact, "a binary, b binary")


def of_class(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Those of ``rows`` (node, text) whose text has the node's set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [class_of(shingles(t, size)) == n for n, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "node binary, text string")


def placed_in(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, node, root, main`` of buckets (key, node) with several components: each node's and the bucket's largest."""
    placed = buckets.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    several = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "root")).alias("most")).where("parts > 1")
    return placed.join(several.select("key", F.col("most.root").alias("main")), "key")


def rarities(texts: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How often shingles fall into each of CELLS cells, over all of ``texts``: an array of fixed size."""
    ship(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                np.add.at(total, cell_of(shingles(text, size)), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], names=["cell", "n"])

    counts = texts.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return out


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def rarest(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, in order; two sets that reach the threshold have one of them in common."""
    order = np.lexsort((hashes, counts[cell_of(hashes)]))
    return hashes[order[: len(hashes) + (-THRESHOLD * len(hashes)) // 100 + 1]]


def sharing_rare(sides: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of ``sides`` (node, root, apart) of different roots that can still be similar, one of them ``apart`` at least.

    All sets are put in one order, by how frequent the cells of their shingles
    are. Sets that reach the threshold share a shingle among the first few of
    each (prefix filter), and what stands from the first common one on must
    suffice for the overlap (positional filter). Both are exact: nothing
    that can reach the threshold is left out, and passages that many documents
    have aren't among the first, so they make no pairs.
    """
    full = texts.join(sides, "node")
    counts = rarities(full, size)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t, size) for t in text_bytes(batch.column("text"))]
            heads = [rarest(h, counts).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "root", "apart")), pa.array([len(h) for h in sets], pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                names=["node", "root", "apart", "n", "head"],
            )

    heads = full.select("node", "root", "apart", "text").mapInArrow(run, "node binary, root binary, apart boolean, n bigint, head array<bigint>")
    heads = written(heads, "heads").select("node", "root", "apart", "n", F.posexplode("head").alias("place", "shingle"))
    one, other = (heads.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "apart", "n", "place"))) for k in "ab")
    fits = (
        (F.col("root_a") != F.col("root_b"))
        # two that are apart meet once
        & (~F.col("apart_b") | (F.col("node_a") < F.col("node_b")))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * THRESHOLD)
        & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (100 + THRESHOLD) >= (F.col("n_a") + F.col("n_b")) * THRESHOLD)
    )
    return one.where("apart_a").join(other, (one["shingle"] == other["shingle"]) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Sets are of distinct shingles of ``size`` words; two are linked at a Jaccard
    similarity of THRESHOLD hundredths. ``component_id`` is the least doc_id
    of the component and ``kept`` says whether it is the row's own. Null and empty
    texts have no shingles and are linked with nothing, and neither is a row
    without doc_id: its component_id is null and it is kept. Repeated rows have
    the same component and are all kept if one is. An empty table gives an
    empty one.
    """
    own = written(signatures(documents, size), "signatures")
    known = own.where("node is not null")
    least = known.groupBy("node").agg(F.min("doc_id").alias("low"))
    # one row a class; size, sketch and bands follow from the set, so they are the same in all its rows
    nodes = written(known.groupBy("node").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in ("n", "sketch", "bands"))), "classes")

    rows = nodes.select("node", F.explode("bands").alias("key"))
    large = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
    buckets = written(rows.join(large, "key").select("key", "node", "leader"), "buckets")
    wanted = buckets.select("node").distinct()
    ids = wanted.join(nodes, "node").select("low", "node")
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("low")).select("node", "text")
    # one text a class, even if an id repeats with the same or another text
    texts = written(of_class(texts, size).dropDuplicates(["node"]), "texts")

    # first each class against the leader that most of its buckets share
    votes = buckets.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    first = votes.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("b")).select(F.col("node").alias("a"), "b")
    links = written(verified(first, nodes, texts, size), "verified")
    roots = components(links)

    # then classes of a bucket that aren't in its largest component, against a few spread members of that;
    # this links most of what can be linked, so that few are left for the comparison with every other class
    mixed = written(placed_in(buckets, roots), "mixed")
    some = mixed.where("root = main").groupBy("key", F.pmod(F.xxhash64("node", "key"), F.lit(3)).alias("slot")).agg(F.min_by("node", F.xxhash64("node")).alias("b"))
    pairs = mixed.where("root != main").select("key", F.col("node").alias("a")).join(some, "key").select("a", "b").distinct()
    links = written(links.unionByName(verified(pairs, nodes, texts, size)), "verified")
    roots = components(links)

    # where components still differ, classes that share one of their rarest shingles
    mixed = placed_in(mixed.select("key", "node"), roots)
    sides = written(mixed.groupBy("node").agg(F.first("root").alias("root"), F.bool_or(F.col("root") != F.col("main")).alias("apart")), "sides")
    roots = components(links.unionByName(verified(sharing_rare(sides, texts, size), nodes, texts, size)))

    named = least.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(ids, "root").select("node", "component")
    out = own.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
