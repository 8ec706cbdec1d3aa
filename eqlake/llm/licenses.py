"""License scans: fuzzy search for short notices.

A notice with at most k edits keeps at least one of k + 1 disjoint pieces
intact (pigeonhole). The pieces are sought exactly; around each place where one
stands, the ``regex`` library matches the whole notice with a bound on its
errors and reports where it begins and ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER_BYTES, WORD_BYTES, ship, text_bytes

#: Base notices, in normal form (lower-case words, one space between): fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Further short notices of public licenses; longer ones allow more edits.
NOTICES = BASE + (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: Names of other licenses that are within the edits of a notice; they aren't misspellings of it.
OTHERS = frozenset({"cc by nd"})

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edits_allowed(phrase: str) -> int:
    """One edit up to 23 characters, then one more for every 12, four at most."""
    return min(4, max(1, len(phrase) // 12))


def numbers(phrase: str) -> list[str]:
    """The words with a digit: another number is another version, so an edit may not touch them."""
    return [w for w in phrase.split(" ") if any("0" <= c <= "9" for c in w)]


class NoticeFinder:
    def __init__(self, notices=NOTICES, edits=edits_allowed):
        self.notices = []
        for phrase, label in notices:
            k = edits(phrase)
            cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
            pieces = [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
            # at a word's edges only, so that "cc by nc" isn't found inside longer words
            fuzzy = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase, special_only=True, literal_spaces=True)}){{e<={k}}}(?![^ ])")
            self.notices.append((phrase, label, k, pieces, fuzzy))

    def matches(self, line: str) -> list[tuple[int, int, int, str, str]]:
        """(start, end, edits, phrase, label) in normal form ``line``; every exact occurrence is among them."""
        found = set()
        for phrase, label, k, pieces, fuzzy in self.notices:
            size, seen = len(phrase), set()
            for piece, shift in pieces:
                at = line.find(piece)
                while at >= 0:
                    start = at - shift
                    if start not in seen:
                        seen.add(start)
                        exact = start >= 0 and line.startswith(phrase, start)
                        if exact and (start == 0 or line[start - 1] == " ") and line[start + size : start + size + 1] in ("", " "):
                            found.add((start, start + size, 0, phrase, label))
                        else:
                            low, high = max(0, start - k), min(len(line), start + size + k)
                            # one character more on either side lets the edges be seen
                            if m := fuzzy.search(line, max(0, low - 1), min(len(line), high + 1)):
                                a, b = m.span()
                                edge = (a == 0 or line[a - 1] == " ") and line[b : b + 1] in ("", " ")
                                if edge and line[a:b] not in OTHERS and numbers(line[a:b]) == numbers(phrase):
                                    found.add((a, b, sum(m.fuzzy_counts), phrase, label))
                    at = line.find(piece, at + 1)
        return sorted(found)

    def scan(self, text: bytes) -> dict:
        """What ``licenses`` returns for one text."""
        words = text.translate(WORD_BYTES).split()
        line = b" ".join(words).decode("utf-8", "replace")
        base = {p for p, _ in BASE}
        found = self.matches(line)
        exact = [m for m in found if m[2] == 0 and m[3] in base]
        spaces = [k for k, c in enumerate(line) if c == " "] if found else []
        first = [bisect_left(spaces, m[0]) for m in exact]
        out = {
            "n_words": len(words),
            "n_base": len(exact),
            "first_word": min(first, default=None),
            "last_word": max(first, default=None),
            "base_labels": ",".join(sorted({m[4] for m in exact})),
            "labels": ",".join(sorted({m[4] for m in found})),
            "score": max((1 - m[2] / len(m[3]) for m in found), default=0.0),
            "spans": [],
        }
        if found:
            places = [m.span() for m in WORD.finditer(text.translate(LOWER_BYTES).decode("utf-8", "replace"))]
            for a, b, e, phrase, label in found:
                i, j = bisect_left(spaces, a), bisect_left(spaces, b)
                out["spans"].append({"start": places[i][0], "end": places[j][1], "edits": e, "label": label})
        return out


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("edits", T.LongType()),
                        T.StructField("label", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def licenses(documents: DataFrame, notices=NOTICES, edits=edits_allowed) -> DataFrame:
    """Licence notices of every document: ``doc_id`` and the columns of ``FIELDS``.

    ``n_base``, ``first_word`` and ``last_word`` count exact places of the base
    notices by word; ``labels`` also has those of notices with bounded edits,
    whose spans (code points of the text, end exclusive) are in ``spans``;
    ``score`` is the best match's share of untouched characters, 0 without one.
    A null text counts as empty: no words, no places, empty labels. Rows are
    independent, so repeated rows repeat, and an empty table gives an empty one.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        finder = NoticeFinder(notices, edits)
        schema = to_arrow_schema(FIELDS)
        for batch in batches:
            out = [finder.scan(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[f.name] for r in out], f.type) for f in schema],
                names=["doc_id"] + [f.name for f in schema],
            )

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"]] + FIELDS.fields))
