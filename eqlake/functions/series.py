"""Series that carry their order: text with an O(...) term read, added and multiplied, exactly.

A series is its centre, rational coefficients of the powers of x - centre, and the
order from which on nothing is known (null: it is the whole polynomial).
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import types as T

from .canonical import ONE, Algebra, TooComplex, Unreadable
from .expressions import _column, number, parse

ORDER = re.compile(r"\+?\s*O\(\s*(\(\s*x\s*([-+])\s*([\d.]+)\s*\)|x)\s*(?:(?:\*\*|\^)\s*\{?(\d+)\}?)?\s*\)\s*$")


class Series(NamedTuple):
    centre: Fraction
    terms: tuple[Fraction, ...]
    order: int | None

    def cut(self, order: int | None) -> Series:
        """The same up to an order; without one, as it is."""
        terms = list(self.terms if order is None else self.terms[:order])
        while terms and not terms[-1]:
            terms.pop()
        return Series(self.centre, tuple(terms), order)


@lru_cache(1 << 14)
def read(text: str | None) -> Series | None:
    """A series from text: a polynomial in x and an O(x**n) or O((x - a)**n) behind it, if there is one; None if it is neither."""
    text = (text or "").strip()
    mark = ORDER.search(text)
    centre, order = Fraction(0), None
    if mark:
        if mark[3]:
            centre = Fraction(mark[3]) * (1 if mark[2] == "-" else -1)
        order, text = int(mark[4] or 1), text[: mark.start()].strip()
    tree = parse(text)
    if tree is None:
        return None
    try:
        algebra = Algebra()
        n, d = algebra.form(_shifted(tree, centre))
    except (Unreadable, TooComplex, ZeroDivisionError, RecursionError, OverflowError):
        return None
    x = algebra.numbers.get(("sym", "x"))
    if d != {ONE: 1} or any(e or any(k != x or v < 0 for k, v in m) for m, e in n):
        return None
    found = {dict(m).get(x, 0): c for (m, _), c in n.items()}
    terms = tuple(found.get(k, Fraction(0)) for k in range(max(found, default=-1) + 1))
    return Series(centre, terms, order).cut(order)


def _shifted(tree, centre: Fraction):
    """The tree with x + centre in place of x."""
    if not centre:
        return tree
    if tree == ("sym", "x"):
        return ("+", tree, ("/", ("num", float(centre.numerator)), ("num", float(centre.denominator))))
    return tuple(_shifted(p, centre) if isinstance(p, tuple) else p for p in tree)


def add(p: Series, q: Series) -> Series | None:
    """The sum, known up to the lesser order; None about different centres."""
    if p.centre != q.centre:
        return None
    size = max(len(p.terms), len(q.terms))
    at = lambda s, k: s.terms[k] if k < len(s.terms) else Fraction(0)
    orders = [s.order for s in (p, q) if s.order is not None]
    return Series(p.centre, tuple(at(p, k) + at(q, k) for k in range(size)), None).cut(min(orders, default=None))


def multiply(p: Series, q: Series) -> Series | None:
    """The product: what is unknown of one begins at its order plus the other's lowest power."""
    if p.centre != q.centre:
        return None
    out = [Fraction(0)] * (len(p.terms) + len(q.terms))
    for i, a in enumerate(p.terms):
        for j, b in enumerate(q.terms):
            out[i + j] += a * b
    lowest = lambda s: next((k for k, c in enumerate(s.terms) if c), s.order if s.order is not None else 0)
    orders = [a.order + lowest(b) for a, b in ((p, q), (q, p)) if a.order is not None]
    return Series(p.centre, tuple(out), None).cut(min(orders, default=None))


def show(s: Series | None, order: bool = True) -> str | None:
    """A series as text, lowest power first, with its order or (``order`` false) as the bare polynomial."""
    if s is None:
        return None
    centre = float(s.centre)
    step = "x" if not centre else f"(x {'-' if centre > 0 else '+'} {number(abs(centre))})"
    parts = []
    for k, c in enumerate(s.terms):
        if c:
            power = "" if k == 0 else step if k == 1 else f"{step}**{k}"
            size = f"{abs(c.numerator)}" if c.denominator == 1 else f"{abs(c.numerator)}/{c.denominator}"
            word = power if power and size == "1" else f"{size}*{power}" if power else size
            parts.append(("-" if c < 0 else "+", word))
    if order and s.order is not None:
        parts.append(("+", f"O({step}**{s.order})"))
    if not parts:
        return "0"
    return ("-" if parts[0][0] == "-" else "") + parts[0][1] + "".join(f" {sign} {word}" for sign, word in parts[1:])


def _both(rule):
    def run(one, other):
        p, q = read(one), read(other)
        return None if p is None or q is None else show(rule(p, q))

    return run


#: Columns: a series as its polynomial without the O(...) term; sums and products of two, in the order that both are known to.
polynomial = _column(T.StringType(), lambda text: show(read(text), False))
series_sum = _column(T.StringType(), _both(add))
series_product = _column(T.StringType(), _both(multiply))
