"""Periodic runs of words: a suffix automaton whose end positions are merged small to large.

States are merged into their suffix links from the longest to the shortest. When
an end position joins a state's ordered set, its distance d to either neighbour
there, if the state is no shorter than d, is the period of a square. A run's
first and second copies end at neighbours of the state that holds both, so every
run has such a seed; a seed is extended both ways to the whole run, and a seed
inside a run known already isn't extended again.

A run has at least LEAST words and twice its period, so all its windows of
LEAST // 2 words that lie within either copy stand in it twice. Stretches of text
whose windows never repeat within the stretch can't hold one and get no automaton.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_bytes

#: The fewest words of a run.
LEAST = 12

#: Positions in one block of a large ordered set.
BLOCK = 2048


class Ends:
    """An ordered set of positions in blocks, so that an insertion moves one block at most."""

    def __init__(self, ordered: list[int]):
        self.blocks = [ordered[k : k + BLOCK] for k in range(0, len(ordered), BLOCK)]
        self.firsts = [b[0] for b in self.blocks]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert a new position; its neighbours below and above."""
        k = max(0, bisect_right(self.firsts, x) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        below = block[at - 1] if at else None
        above = block[at] if at < len(block) else self.firsts[k + 1] if k + 1 < len(self.firsts) else None
        block.insert(at, x)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.firsts[k : k + 1] = [block[0], block[BLOCK]]
        return below, above


def automaton(word_ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """States of the suffix automaton: suffix links, lengths of the longest text, and the position that a state was made for (-1 for a copy)."""
    nexts, link, length, own = [{}], [-1], [0], [-1]
    last = 0
    for at, word in enumerate(word_ids):
        state = len(nexts)
        nexts.append({})
        length.append(at + 1)
        own.append(at)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                copy = len(nexts)
                link.append(copy)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                own.append(-1)
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                link[q] = copy
        last = state
    return link, length, own


class _Runs:
    """Runs of one text found so far, by period."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.known = ids, {}

    def seed(self, begin: int, end: int, period: int) -> None:
        """The words from ``begin`` to before ``end`` repeat at ``period``; find how far."""
        begins, ends = self.known.setdefault(period, ([], []))
        k = bisect_right(begins, begin)
        if k and ends[k - 1] >= end:
            return
        ids, n = self.ids, len(self.ids)
        step = 8
        while end < n:
            here = ids[end : end + step] == ids[end - period : min(end + step, n) - period]
            fit = len(here) if here.all() else int(here.argmin())
            end += fit
            if fit < len(here):
                break
            step *= 2
        step = 8
        while begin:
            low = max(0, begin - step)
            here = ids[low:begin] == ids[low + period : begin + period]
            fit = len(here) if here.all() else int(here[::-1].argmin())
            begin -= fit
            if fit < len(here):
                break
            step *= 2
        k = bisect_right(begins, begin)
        begins.insert(k, begin)
        ends.insert(k, end)

    def found(self, least: int) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of each run, by start, then period."""
        smallest: dict[tuple[int, int], int] = {}
        for period, (begins, ends) in self.known.items():
            for span in zip(begins, ends, strict=True):
                if span[1] - span[0] >= max(least, 2 * period):
                    smallest[span] = min(period, smallest.get(span, period))
        return sorted((begin, end - begin, period) for (begin, end), period in smallest.items())


def stretch_runs(word_ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a text of word numbers: (start, length, period) by start, then period."""
    link, length, own = automaton(word_ids)
    runs = _Runs(np.array(word_ids, np.int64))
    sets: list = [[p] if p >= 0 else None for p in own]
    # a run's two copies meet in a state of length - period words, which is half the least length or more
    shortest = least // 2
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        parent = link[state]
        reach = length[parent] if parent > 0 else 0
        mine, sets[state] = sets[state], None
        if reach < shortest or mine is None:
            continue
        theirs = sets[parent]
        if theirs is None:
            sets[parent] = mine
            continue
        if len(theirs) < len(mine):
            theirs, mine = mine, theirs
        if len(theirs) > 2 * BLOCK and isinstance(theirs, list):
            theirs = Ends(theirs)
        sets[parent] = theirs
        for x in mine:
            if isinstance(theirs, list):
                at = bisect_left(theirs, x)
                below = theirs[at - 1] if at else None
                above = theirs[at] if at < len(theirs) else None
                theirs.insert(at, x)
            else:
                below, above = theirs.add(x)
            if below is not None and x - below <= reach:
                runs.seed(below - reach + 1, x + 1, x - below)
            if above is not None and above - x <= reach:
                runs.seed(x - reach + 1, above + 1, above - x)
    return runs.found(least)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of words, begin and end, each of whose words lies in a window that the stretch holds twice; no run lies outside them or over two."""
    size = least // 2
    if len(hashes) < least:
        return []
    windows = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        windows = windows * _MIX + hashes[k : len(hashes) - size + 1 + k]
    out, todo = [], [(0, len(hashes))]
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        held = windows[begin : end - size + 1]
        ordered = np.sort(held)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, held), len(twice) - 1)
        marks = np.zeros(end - begin + 1, np.int64)
        starts = np.flatnonzero(twice[at] == held)
        marks[starts] += 1
        marks[starts + size] -= 1
        covered = np.concatenate([[0], np.cumsum(marks[:-1]) > 0, [0]]).astype(np.int8)
        turns = np.flatnonzero(np.diff(covered)).reshape(-1, 2) + begin
        if len(turns) == 1 and turns[0, 0] == begin and turns[0, 1] == end:
            out.append((begin, end))
        else:
            todo.extend((int(a), int(b)) for a, b in turns)
    return sorted(out)


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a text's words: maximal stretches with smallest period q and at least max(least, 2 q) words."""
    if len(words) < least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for begin, end in stretches(hashes, least):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words[begin:end]]
        out += [(begin + start, length, period) for start, length, period in stretch_runs(ids, least)]
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed) of ``docs`` (doc_id, text).

    ``runs`` are structs (start, length, period) by start, then period; words
    are what stands between ASCII white space and are numbered from 0. ``collapsed``
    holds the words but for a run's repeats, joined by one space. A null or
    empty text has no word, no run and an empty collapsed text. Each row stands
    alone: nothing is shuffled. An automaton takes some 0.5 KB a word of a repeating stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in text_bytes(batch.column("text")):
                words = text.split()
                found = runs_of(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(without_repeats(words, found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts (doc_id, text): in a tenth of the documents, by crc32 of the id (null: empty), the words from one on repeat periodically."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = g % F.greatest(n, F.lit(1))
    times = (F.lit(3) + g % 8).cast("int")
    p = F.lit(1) + F.floor((n - a) / times)
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), times)), 1, (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))
