"""Column functions over expression text and answers; all of them native."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


#: A number that stands before a letter: fixed value.
IMPLICIT_PRODUCT = r"(\d+\.?\d*(?:[eE][+-]?\d+)?)([a-zA-Z])"


def explicit_product(c: Column) -> Column:
    """2x becomes 2*x."""
    return F.regexp_replace(c, IMPLICIT_PRODUCT, "$1*$2")


def number_or_one(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(1.0))


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def expression_type(c: Column) -> Column:
    """First that holds: exponential, hyperbolic, trigonometric, polynomial, else a real value."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"exp|e\*\*|e\^"), "exponential")
        .when(low.rlike(r"sinh|cosh|tanh"), "hyperbolic")
        .when(low.rlike(r"sin|cos|tan"), "trigonometric")
        .when(low.rlike(r"[xt]"), "polynomial")
        .otherwise("real_value")
    )


def last_block(c: Column) -> Column:
    """What stands in the last fenced python block."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?s)```(?:python|py)?\s*\n(.*?)```"), F.lit(1)), F.lit(-1))


def coefficient_class(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(c.rlike(r"\d+\.\d+"), "num_coef").otherwise("symbolic")


def shortened(c: Column, size: int = 80) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def equation_line(kernel: Column, f: Column, lam: Column, a: Column, b: Column) -> Column:
    """The equation as text; of the first kind where lambda is 0."""
    integral = F.concat(F.lit("∫["), a.cast("string"), F.lit(", "), b.cast("string"), F.lit("] ("), kernel, F.lit(") u(t) dt = "), f)
    return F.when(lam == 0, integral).otherwise(F.concat(F.lit("u(x) - "), lam.cast("string"), F.lit(" * "), integral))


def flagged_type(flags: dict[str, Column]) -> Column:
    """The type that boolean flags name, in the order they are given; a real value without any."""
    out = F.lit("real_value")
    for name, flag in reversed(flags.items()):
        out = F.when(F.coalesce(flag, F.lit(False)), name).otherwise(out)
    return out


def rounded_numbers(c: Column, digits: int = 4) -> Column:
    """Decimal numbers in a text to so many significant digits, integers as they are. Native, number by number."""
    pattern = r"\d+\.\d+(?:[eE][+-]?\d+)?"
    between, numbers = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    short = F.transform(numbers, lambda n: F.regexp_replace(F.format_string(f"%.{digits - 1}e", n.cast("double")).cast("double").cast("string"), r"\.0$", ""))
    return F.array_join(F.flatten(F.zip_with(between, short, lambda b, n: F.array(b, F.coalesce(n, F.lit(""))))), "")


#: Classes of a solution's text, in the order in which they are tried.
SOLUTION_CLASSES = (
    ("Trivial (zero)", r"^(?:0|0\.0|none|null|)$"),
    ("Constant", r"^-?\d+\.?\d*$"),
    ("Linear (x)", r"^[xt]$"),
    ("Special Function", r"bessel|legendre|hermite|laguerre|gamma|erf"),
    ("Exponential", r"exp\("),
    ("Hyperbolic", r"sinh|cosh|tanh"),
    ("Trigonometric", r"sin|cos|tan"),
    ("Polynomial", r"\*\*|x\s*\*|\*\s*x"),
    ("Rational", r"^(?=.*/)(?=.*x)"),
)


def solution_class(c: Column) -> Column:
    """The first of SOLUTION_CLASSES that a solution's text, trimmed and in lower case, falls into."""
    low, out = F.lower(F.trim(c)), F.lit("Other Symbolic")
    for name, pattern in reversed(SOLUTION_CLASSES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
