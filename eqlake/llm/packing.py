"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of WINDOW tokens is one round. In it each source's deficit grows by
its share of the window and is served in whole cells of CELL tokens; what
remains is carried to the next window. The counters have a closed form: after w
windows a source has had the whole part of w times its share (shares are split
along a binary tree of sources, rounding down at each node, so that the parts
of a window always add up to it). So a cell's window follows from its place in
its source's queue alone, deficits carry over windows and partitions without a
pass from one to the next, and tokens needn't be shuffled: partitions only
have to know how many tokens each queue has before them. These offsets are
broadcast if they are few, else joined.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

WINDOW, CELL = 1024, 64
END = 0
#: Counted offsets up to which they are broadcast; more are joined.
OFFSET_ROWS = 1_000_000
#: Chunks of text whose ids a worker keeps.
CACHE = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids of whole texts as bytes of little-endian numbers, ended by END.

    The vocabulary's numbers are its merge ranks. A space between two characters
    that aren't white space, and a line end between two such, always begin a new
    piece for this vocabulary, so ids of the stretches between them can be kept and
    put together. Texts where white space stands otherwise are encoded as they
    are, and those with the special token's string by the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", ())}
        spare = iter(range(256, 512))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(next(spare)): b for b in range(256) if b not in plain}
        vocab = model["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.special = [s for s in special if s]
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.path = path
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        coder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = coder.encode_ordinary
        self.end, self.line = self.pack([END]), self.pack(self.encode("\n"))
        self.marks = {c: self.pack(self.encode(c)) for c in ".,;:!?"}
        self.chunks = self._cache()

    @cached_property
    def whole(self):
        """The library's tokenizer, only where a text needs it: it takes as much memory as all the rest."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _cache(self):
        encode, line, marks, code = self.encode, self.line, self.marks, "H" if self.kind.itemsize == 2 else "I"

        class Cache(dict):
            """Ids of chunks that a space stands before, or, where they begin so, a line end."""

            def __missing__(self, chunk: str) -> bytes:
                # a mark after a letter is a piece of its own
                if chunk[-1:] in marks and chunk[-2:-1].isalpha():
                    return self[chunk[:-1]] + marks[chunk[-1]]
                own = chunk[1:] if chunk[:1] == "\n" else chunk
                if not own or own[0].isspace() or own[-1].isspace():
                    raise KeyError(chunk)
                before, own = (line, own) if own is not chunk else (b"", " " + own)
                value = before + array(code, encode(own)).tobytes()
                if len(self) < CACHE:
                    self[chunk] = value
                return value

        return Cache()

    def of(self, text: str) -> bytes:
        if not text:
            return self.end
        if any(s in text for s in self.special):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids) + self.end
        try:
            found = b"".join(map(self.chunks.__getitem__, ("\n" + text.replace("\n", " \n")).split(" ")))
        except KeyError:
            return self.pack(self.encode(text)) + self.end
        return found[len(self.line) :] + self.end


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """``part, queue, doc_id, before, n, ids``: ``before`` are the queue's tokens ahead of the row within its partition.

    A queue is named by its source with a mark before it, so that no source shares the queue of null ("").
    """
    ship(documents.sparkSession)
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, ids, sums = TaskContext.get().partitionId(), ids_of(path), {}
        size = ids.kind.itemsize
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    piece = batch.slice(at, 1000)
                    out = [ids.of(t) for t in piece.column(2).to_pylist()]
                    n = [len(x) // size for x in out]
                    names, before = piece.column(0).to_pylist(), []
                    for q, k in zip(names, n, strict=True):
                        before.append(sums.get(q, 0))
                        sums[q] = before[-1] + k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(n), pa.int64()), piece.column(0), piece.column(1), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                        names=["part", "queue", "doc_id", "before", "n", "ids"],
                    )
        finally:
            # the worker may wait long for its next task, or do other stages' work
            ids.chunks.clear()

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(queue.alias("queue"), "doc_id", "text")
    return rows.mapInArrow(run, f"part bigint, queue string, doc_id {kind}, before bigint, n bigint, ids binary")


class Rounds:
    """Windows in which queues of so many cells are served in proportion, from window ``at`` on."""

    def __init__(self, cells: list[int], per_window: int, at: int = 0):
        self.cells, self.per, self.at = cells, per_window, at
        self.sums = [0]
        for c in cells:
            self.sums.append(self.sums[-1] + c)
        self.total = self.sums[-1]
        self.windows = -(-self.total // per_window)
        # products of two counts must stay exact
        self.kind = np.int64 if self.total < 1 << 31 else object

    def served(self, q: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of queue q, and of the queues before it, in the first w windows."""
        n = np.minimum(w.astype(self.kind) * self.per, self.total)
        ahead = np.zeros(len(w), self.kind)
        lo, hi = 0, len(self.cells)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            whole = self.sums[hi] - self.sums[lo]
            left = n * (self.sums[mid] - self.sums[lo]) // whole if whole else n * 0
            if q < mid:
                n, hi = left, mid
            else:
                n, ahead, lo = n - left, ahead + left, mid
        return n, ahead

    def windows_of(self, q: int, k: np.ndarray) -> np.ndarray:
        """The window in which each cell of queue q stands: the last one before which at most k cells were served."""
        guess = (k.astype(np.float64) * (self.total / max(1, self.cells[q]) / self.per)).astype(np.int64)
        reach = int(4 * self.total / max(1, self.cells[q]) / self.per) + 4 + int(self.windows * 1e-12)
        lo, hi = np.maximum(guess - reach, 0), np.minimum(guess + reach, self.windows)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            fits = (self.served(q, mid)[0] <= k).astype(bool)
            lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid)
        return lo


class Plan:
    """Where every token of every queue goes; ``targets`` are the queues' shares, by default those they have.

    With other targets, queues run dry one by one; each time the rest go on in
    their proportions, in a new run of rounds.
    """

    def __init__(self, tokens: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW, cell: int = CELL):
        self.window, self.cell, per = window, cell, window // cell
        self.names = sorted(tokens, key=lambda q: (-tokens[q], q))
        self.index = {q: i for i, q in enumerate(self.names)}
        self.tokens = [tokens[q] for q in self.names]
        left = [-(-t // cell) for t in self.tokens]
        self.cells = list(left)
        self.runs: list[Rounds] = []
        self.starts: list[list[int]] = []
        at = 0
        while any(left):
            share = [0.0 if not n else n if targets is None else max(targets.get(q, 0.0), 1e-9) for q, n in zip(self.names, left, strict=True)]
            time = min(n / s for n, s in zip(left, share, strict=True) if n)
            take = [min(n, max(int(s * time + 1e-6), int(n <= s * time * (1 + 1e-12)) * n)) if n else 0 for n, s in zip(left, share, strict=True)]
            if not any(take):
                take = list(left)
            self.starts.append([c - n for c, n in zip(self.cells, left, strict=True)])
            self.runs.append(Rounds(take, per, at))
            at += self.runs[-1].windows
            left = [n - t for n, t in zip(left, take, strict=True)]
        # a queue's last cell may be short; what follows it in its window moves up
        self.short: dict[int, list[tuple[int, int]]] = {}
        for q, (c, t) in enumerate(zip(self.cells, self.tokens, strict=True)):
            if c * cell > t:
                w = int(self.place(q, np.array([c - 1]))[0][0])
                self.short.setdefault(w, []).append((q, c * cell - t))

    def place(self, q: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cells k of queue q: window, first cell of the queue there, cells of other queues ahead of it there."""
        w, first, ahead = (np.zeros(len(k), np.int64) for _ in range(3))
        run = np.searchsorted([s[q] for s in self.starts], k, "right") - 1
        # runs in which the queue has no cells start where the next one does
        for r in np.unique(run):
            rounds, start, at = self.runs[r], self.starts[r][q], run == r
            own = rounds.windows_of(q, k[at] - start)
            had, others = rounds.served(q, own)
            first[at] = had + start
            ahead[at] = rounds.served(q, own + 1)[1] - others
            w[at] = own + rounds.at
        return w, first, ahead

    def pieces(self, q: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of rows at queue places [begin, begin + n): row, start, length, window, offset there."""
        cell = self.cell
        low, high = begin // cell, (begin + n - 1) // cell
        counts = high - low + 1
        row = np.repeat(np.arange(len(n)), counts)
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
        w, first, ahead = self.place(q, k)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (w[1:] != w[:-1])])
        last = np.r_[new[1:], len(k)] - 1
        row, w, first, ahead = row[new], w[new], first[new], ahead[new]
        a = np.maximum(k[new] * cell, begin[row])
        b = np.minimum((k[last] + 1) * cell, (begin + n)[row])
        offset = ahead * cell + a - first * cell
        for at in np.flatnonzero(np.isin(w, list(self.short))):
            offset[at] -= sum(m for s, m in self.short[int(w[at])] if s < q)
        return row, a - begin[row], b - a, w, offset


def pack(documents: DataFrame, path: str | None = None, targets: dict[str, float] | None = None, window: int = WINDOW, cell: int = CELL) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``: a row for each piece.

    Each row of ``documents`` is its text's ids and END; null and empty texts are
    END alone. Rows stand in their source's queue as they are read; a null
    source is a queue too, and so is a missing column. Every source is a queue
    of its own; the plan that is broadcast grows with their number, by some 100
    bytes each. A sequence has ``window`` ids but where queues end:
    there up to ``cell`` - 1 fewer for each queue, and fewer in the last one of a
    run. Repeated rows are packed again; an empty table gives no pieces.
    """
    if "source" not in documents.columns:
        documents = documents.withColumn("source", F.lit(None).cast("string"))
    spark = documents.sparkSession
    path = path or tokenizer_path()
    rows = written(tokenized(documents, path), "tokens")
    sums = written(rows.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("part", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    if sums.count() <= OFFSET_ROWS:
        ahead = F.broadcast(ahead)
    placed = rows.join(ahead, ["part", "queue"]).select("queue", "doc_id", (F.col("before") + F.col("ahead")).alias("begin"), "n", "ids")
    sent = spark.sparkContext.broadcast(Plan(totals, None if targets is None else {f"={q}" if q is not None else "": t for q, t in targets.items()}, window, cell))

    def run(batches):
        import pyarrow as pa

        plan = sent.value
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                queue = piece.column(0).to_numpy(zero_copy_only=False)
                begin, n = piece.column(2).to_numpy(), piece.column(3).to_numpy()
                ids = piece.column(4)
                for q in dict.fromkeys(queue):
                    own = np.flatnonzero(queue == q)
                    row, start, length, w, offset = plan.pieces(plan.index[q], begin[own], n[own])
                    crc, last, data = [], -1, b""
                    for r, a, size in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                        if r != last:
                            last, raw = r, ids[int(own[r])].as_py()
                            data = memoryview(np.frombuffer(raw, f"<u{len(raw) // int(n[own[r]])}").astype("<u4").tobytes())
                        crc.append(zlib.crc32(data[4 * a : 4 * (a + size)]))
                    at_row = own[row]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(1).take(pa.array(at_row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[at_row], w, offset)), pa.array([q[1:] if q else None] * len(row), pa.string())], names=names
                    )

    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return placed.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields, T.StructField("source", T.StringType())]))
