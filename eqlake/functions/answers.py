"""An answer in a whole response that labels nothing: the formula that is most likely meant, found by trying to read its spans.

Formulas stand between delimiters, or are runs of words that are numbers, operators, functions and
single letters. Of a run, however long, the longest span that can be read counts, the first of equal ones: it is found in one pass over the run, that follows the
reader's grammar from all starts together. What stands behind u(x) = comes first, then formulas between
delimiters, then those with more operations, then later ones. Plain numbers, single names and words that happen to be
read as products of letters are no answers.
"""

from __future__ import annotations

import math
import re
import sys
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import types as T

from .canonical import operations
from .expressions import CONSTANTS, FUNCTIONS, _column, parse, show, symbols
from .notation import LETTERS, product_of_letters

DELIMITED = re.compile(r"\$\$(.+?)\$\$|\$(.+?)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|`([^`\n]+)`", re.S)
PIECE = re.compile(r"\s*(\d+\.?\d*(?:[eE][-+]?\d+)?|[A-Za-z]\w*|\*\*|[-+*/^(),=|]|\S)")
SIGNS = frozenset("- + * / ^ ** ( ) , |".split())
#: Pieces that no formula begins or ends with.
NO_START, NO_END = frozenset("* / ^ ** ) ,".split()), frozenset("+ - * / ^ ** ( ,".split())
GIVEN = re.compile(r"u\s*\(\s*x\s*\)\s*(?:=|\\approx|≈)")


def _formula(piece: str) -> bool:
    """Whether a piece of prose can be part of a formula."""
    return piece in SIGNS or piece[0].isdigit() or piece in FUNCTIONS or piece in CONSTANTS or piece == "Integral" or bool(re.fullmatch(r"[A-Za-z](?:_\w+|\d+)?", piece))


def _usable(tree) -> bool:
    """No plain number or name, and no product of four letters or more."""
    if tree is None or not symbols(tree) and operations(tree) < 1:
        return False
    if tree[0] in ("num", "sym") or tree[0] == "neg" and tree[1][0] in ("num", "sym") and tree != ("neg", ("sym", "x")):
        return tree == ("sym", "x")
    return bool(symbols(tree)) and not product_of_letters(tree) and _finite(tree)


def _finite(tree) -> bool:
    """Whether all numbers can be written."""
    todo = [tree]
    while todo:
        part = todo.pop()
        if part[0] == "num" and not math.isfinite(part[1]):
            return False
        todo += [p for p in part[1:] if isinstance(p, tuple)]
    return True


def _read(text: str):
    """The tree of a formula's text, in LaTeX or infix; of a chain of equations that of the last part that can be read."""
    for part in reversed(text.split("=")):
        part = part.strip().rstrip(".,;: ")
        if not part:
            continue
        tree = parse(part, "latex") if re.search(r"\\|[\^_]\{", part) else parse(part.replace("^", "**"))
        if tree is not None:
            return tree
    return None


def _runs(text: str):
    """(start, pieces) of maximal runs of pieces that can be parts of a formula; = ends one."""
    run, start = [], 0
    for m in PIECE.finditer(text):
        piece = m[1]
        if _formula(piece):
            if not run:
                start = m.start(1)
            run.append((m.start(1), m.end(1)))
        elif run:
            yield start, run
            run = []
    if run:
        yield start, run


class _Place(NamedTuple):
    """Where the reader is in a sum, and what of the tree so far decides whether it is an answer. Starts at equal places have the same future."""

    #: Before an operand with signs (S) or without (O), behind a function's name (F) or Integral (N), behind an operand (A).
    state: str = "S"
    #: 0: one factor so far, 1: a product, 2: a sum.
    mode: int = 0
    #: Letters of the product before this factor and of this factor, up to LETTERS.
    before: int = 0
    letters: int = 0
    #: The factor's letters don't count, as it is an exponent, an argument, a divisor or has a sign within a product.
    inner: bool = False
    #: Minus signs before the first factor, up to 2.
    signs: int = 0
    #: Whether a name is in it that is no constant (kept by name in frames).
    free: bool = False
    #: The tree: x, another name or number (y), the negative of such (-y), or anything else (o).
    kind: str = "o"

    def operand(self, letters: int, kind: str, free: bool) -> _Place:
        """Behind an operand."""
        alone = not self.mode and not self.inner
        for _ in range(self.signs):
            letters, kind = 0, "-y" if kind == "y" else "o"
        return _Place("A", self.mode, self.before, 0 if self.inner or self.mode == 2 else letters, free=self.free or free, kind=kind if alone else "o")

    def product(self) -> int:
        return min(LETTERS, self.before + self.letters)

    def factor(self, state: str) -> _Place:
        """Before the next factor."""
        return _Place(state, max(1, self.mode), self.product(), free=self.free)

    def usable(self) -> bool:
        return self.state == "A" and self.free and self.product() < LETTERS and self.kind in ("x", "o")


class _Frame:
    """A bracket, bar, Integral or raised function that is open; ``below`` are the places before it of all starts that it is open for."""

    def __init__(self, kind: str):
        self.kind, self.phase, self.names, self.kept = kind, 0, set(), set()
        self.place = _Place("O", inner=True) if kind == "raised" else _Place()
        #: The frame around it, or without one the first start.
        self.below: dict[tuple[_Place, _Frame | None], int | _Frame] = {}

    def key(self) -> tuple:
        """Frames with the same have the same future."""
        return self.kind, self.phase, self.place, frozenset(self.names), frozenset(self.kept)

    def add(self, place: _Place, holder):
        key = place, holder if isinstance(holder, _Frame) else None
        self.below[key] = holder if key[1] else min(holder, self.below.get(key, holder))

    def joined(self, other: _Frame) -> _Frame:
        one, two = (self, other) if len(self.below) >= len(other.below) else (other, self)
        for (place, _), holder in two.below.items():
            one.add(place, holder)
        return one

    def outer(self) -> list[tuple]:
        return [(place, holder) for (place, _), holder in self.below.items()]


class _Spans:
    """All spans of a run that can be read, followed piece by piece; ``best`` is the longest usable one (first and last piece, the latter not included).

    The reader looks ahead one piece and never goes back, so a start is known by its place and its open frames. Starts that have the
    same are one from there on and the first counts; frames with the same future are one, too. So the work grows with the pieces, not with their pairs.
    """

    def __init__(self, pieces: list[str]):
        self.best, length = None, 0
        # names that an Integral may bind are kept apart; of the others it matters whether there are any
        self.bound = {b for a, b, c in zip(pieces[1:], pieces[2:], pieces[3:]) if a == "(" and c == ","} if "Integral" in pieces else set()
        self.outside: dict[_Place, int] = {}
        self.inside: list[_Frame] = []
        for at, piece in enumerate(pieces):
            todo = [(place, start) for place, start in self.outside.items()] + [(f.place, f) for f in self.inside]
            todo.append((_Place(), at))
            self.outside, self.inside, self.opened = {}, [], {}
            for place, holder in todo:
                self.take(place, holder, piece)
            self.inside += self.opened.values()
            if len(self.inside) > 1:
                frames: dict[tuple, _Frame] = {}
                for frame in self.inside:
                    key = frame.key()
                    frames[key] = frames[key].joined(frame) if key in frames else frame
                self.inside = list(frames.values())
            for place, start in self.outside.items():
                size = at + 1 - start
                if (self.settled(place, start) if place.state == "N" else place).usable() and size > 1 and (size > length or size == length and start < self.best[0]):
                    self.best, length = (start, at + 1), size

    def put(self, place: _Place, holder):
        if isinstance(holder, _Frame):
            holder.place = place
            self.inside.append(holder)
        else:
            self.outside[place] = min(holder, self.outside.get(place, holder))

    def open(self, kind: str, place: _Place, holder):
        if kind not in self.opened:
            self.opened[kind] = _Frame(kind)
        self.opened[kind].add(place, holder)

    def close(self, frame: _Frame, inside: _Place):
        letters, kind = (inside.product(), inside.kind) if frame.kind == "(" else (0, "o")
        for place, holder in frame.outer():
            self.put(self.named(place, holder, frame.names, letters, kind), holder)

    def named(self, place: _Place, holder, names, letters: int, kind: str) -> _Place:
        """Behind an operand with these free names."""
        if isinstance(holder, _Frame):
            holder.names.update(n if n in self.bound else "" for n in names)
            return place.operand(letters, kind, False)
        return place.operand(letters, kind, bool(names))

    def settled(self, place: _Place, holder) -> _Place:
        """Behind the word Integral where it is a name."""
        return self.named(place, holder, ["Integral"], 0, "y")

    def take(self, place: _Place, holder, piece: str):
        """The piece at a place; a start that can't take it is dropped."""
        frame = holder if isinstance(holder, _Frame) else None
        if frame and frame.kind == "Integral" and frame.phase in (1, 2, 3, 6):
            return self.integral(frame, piece)
        if place.state == "N":
            if piece == "(":
                return self.open("Integral", place, holder)
            place = self.settled(place, holder)
        if place.state != "A":
            return self.operand(place, holder, piece)
        if piece in ("^", "**"):
            return self.put(place._replace(state="S", letters=0, inner=True), holder)
        if frame and frame.kind == "raised":  # the exponent of a function ends, its argument begins
            for below, other in frame.outer():
                if isinstance(other, _Frame):
                    other.names.update(frame.names)
                self.take(below._replace(free=below.free or bool(frame.names) and not isinstance(other, _Frame)), other, piece)
        elif piece == "*":
            self.put(place.factor("S"), holder)
        elif piece == "/":
            self.put(place.factor("S")._replace(before=0, inner=True), holder)
        elif piece in ("+", "-"):
            self.put(_Place(mode=2, free=place.free), holder)
        elif piece == "(" or re.match(r"[\dA-Za-z]", piece):
            self.operand(place.factor("O"), holder, piece)
        elif frame and piece == {"(": ")", "|": "|"}.get(frame.kind):
            self.close(frame, place)
        elif frame and frame.kind == "Integral" and piece == {0: ",", 4: ",", 5: ")"}[frame.phase]:
            if frame.phase == 0:
                frame.kept, frame.names = frame.names, set()
            frame.phase += 1
            self.put(_Place(), frame)

    def integral(self, frame: _Frame, piece: str):
        """What isn't a sum of Integral(body, (name, low, high))."""
        if frame.phase == 2 and re.fullmatch(r"[A-Za-z]\w*", piece):
            frame.kept.discard(piece)
        elif piece != {1: "(", 3: ",", 6: ")"}.get(frame.phase):
            return
        if frame.phase == 6:
            frame.names |= frame.kept
            return self.close(frame, frame.place)
        frame.phase += 1
        self.put(_Place(), frame)

    def operand(self, place: _Place, holder, piece: str):
        if piece in ("+", "-"):
            if place.state == "S":
                first = not place.mode and not place.inner
                self.put(place if piece == "+" else place._replace(signs=min(2, place.signs + 1)) if first else place._replace(inner=True), holder)
        elif piece in ("^", "**"):
            if place.state == "F":
                self.open("raised", place, holder)
        elif piece in ("(", "|"):
            self.open(piece, place, holder)
        elif piece in FUNCTIONS:
            self.put(place._replace(state="F", inner=True), holder)
        elif piece == "Integral":
            self.put(place._replace(state="N"), holder)
        elif re.match(r"\d", piece):
            if math.isfinite(float(piece)):
                self.put(place.operand(0, "y", False), holder)
        elif re.match(r"[A-Za-z]", piece):
            self.put(self.named(place, holder, [] if piece in CONSTANTS else [piece], int(len(piece) == 1), "x" if piece == "x" else "y"), holder)


@contextmanager
def _room(pieces: int):
    """Frames for a text whose brackets can be nested as deep as it has pieces."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 8 * pieces)
    try:
        yield
    finally:
        sys.setrecursionlimit(limit)


def _longest(line: str, run: list[tuple[int, int]]):
    """(tree, text) of the longest usable span of a run's pieces, the first of equal ones; None without one."""
    low, high = 0, len(run)
    while low < high and line[slice(*run[low])] in NO_START:
        low += 1
    while low < high and line[slice(*run[high - 1])] in NO_END:
        high -= 1
    run = run[low:high]
    if len(run) < 2:
        return None
    raw = line[run[0][0] : run[-1][1]]
    tree = parse(raw.replace("^", "**"))
    if _usable(tree):  # mostly it is all of it
        return tree, raw
    found = _Spans([line[a:b] for a, b in run]).best
    if found is None:
        return None
    raw = line[run[found[0]][0] : run[found[1] - 1][1]]
    with _room(found[1] - found[0]):
        tree = parse.__wrapped__(raw.replace("^", "**"))
    return None if tree is None else (tree, raw)


def candidates(text: str) -> list[tuple[tuple, tuple, str]]:
    """(rank, tree, text) of every usable formula of a response, the best first."""
    found, plain = [], list(text)
    for m in DELIMITED.finditer(text):
        raw = next(g for g in m.groups() if g is not None)
        tree = _read(GIVEN.split(raw)[-1])
        given = bool(GIVEN.search(raw)) or bool(GIVEN.search(text[max(0, m.start() - 16) : m.start()]))
        if _usable(tree):
            found.append(((not given, False, -operations(tree), -m.start()), tree, raw.strip()))
        plain[m.start() : m.end()] = "\n" * (m.end() - m.start())
    rest = "".join(plain)
    for line in re.finditer(r"[^\n]+", rest):
        for start, run in _runs(line[0]):
            given = bool(re.search(r"u\s*\(\s*x\s*\)\s*=\s*$", line[0][:start]))
            if re.fullmatch(r"(?:[A-Za-z]\s+){3,}[A-Za-z]\s*", line[0][run[0][0] : run[-1][1]] + " "):
                continue  # letters that stand apart are no product
            best = _longest(line[0], run)
            # a bare x or a number is an answer where it is called one, and x where it is all that is said
            if best is None and run and (given or text.strip() == "x"):
                raw = line[0][run[0][0] : run[0][1]]
                best = (parse(raw), raw) if parse(raw) is not None else None
            if best:
                found.append(((not given, True, -operations(best[0]), -(line.start() + start)), *best))
    return sorted(found, key=lambda x: x[0])


def extracted(text: str | None) -> str | None:
    """The answer of a response as infix; None if no formula in it can be one."""
    found = candidates(text or "")
    with _room(len(text or "")):
        return show(found[0][1]) if found else None


#: Column: the answer of a response as infix, null without one.
answer_text = _column(T.StringType(), extracted)
