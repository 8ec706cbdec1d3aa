"""Which notation a text is in, whole equations in each of them, and series as text. Native, but where an expression has to be read."""

from __future__ import annotations

import re


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from .expressions import CONSTANTS, _column, convert, number, parse, show, symbols

#: Marks of each notation.
RPN_OPERATORS = ("+", "-", "*", "/", "^")
RPN_FUNCTIONS = ("exp", "sin", "cos", "tan", "log", "sqrt", "neg")
INFIX_OPERATOR, INFIX_CALL = r"[a-zA-Z0-9]\s*[\+\-\*/\^]\s*[a-zA-Z0-9]", r"\w+\([^)]+\)"
LATEX_MARKS = (r"\\sin", r"\\cos", r"\\tan", r"\\exp", r"\\log", r"\\sqrt", r"\\frac", r"\^\{", r"_\{")


def notation(c: Column) -> Column:
    """rpn (an operator last and none between operands, or a function after operands), latex by its marks, else infix."""
    tokens = F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")
    many = F.size(tokens) >= 3
    operator = F.try_element_at(tokens, F.lit(-1)).isin(*RPN_OPERATORS) & ~c.rlike(INFIX_OPERATOR)
    function = F.exists(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: t.isin(*RPN_FUNCTIONS)) & ~c.rlike(INFIX_CALL)
    return F.when(many & (operator | function), "rpn").when(c.rlike("|".join(LATEX_MARKS)), "latex").otherwise("infix")


def notation_of_name(name: Column) -> Column:
    """The notation that a file's name states, null if none."""
    stem = F.lower(F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1))
    return F.when(stem.contains("infix"), "infix").when(stem.contains("latex"), "latex").when(stem.contains("rpn"), "rpn")


def notation_of_rows(rows: DataFrame, *by: str) -> DataFrame:
    """``by, notation``: what most expressions (columns u, f, kernel) are in; ties go to infix, then latex."""
    columns = [F.col(c) for c in ("u", "f", "kernel") if c in rows.columns]
    each = rows.select(*by, F.explode(F.array(*columns)).alias("_text")).where("_text is not null").select(*by, notation(F.col("_text")).alias("_kind"))
    counts = [F.struct(F.count_if(F.col("_kind") == k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("kind")) for i, k in enumerate(("infix", "latex", "rpn"))]
    return each.groupBy(*by).agg(F.greatest(*counts)["kind"].alias("notation"))


def one_notation(files: DataFrame) -> DataFrame:
    """``files`` (name, notation) as they are if all have one notation; an error when a row of another is computed."""
    both = files.agg(F.min("notation").alias("_low"), F.max("notation").alias("_high"))  # one row
    checked = files.crossJoin(F.broadcast(both))
    message = F.concat(F.lit("notations differ: "), F.col("_low"), F.lit(", "), F.col("_high"))
    return checked.withColumn("notation", F.when(F.col("_low") == F.col("_high"), F.col("notation")).otherwise(F.raise_error(message).cast("string"))).drop("_low", "_high")


def _either(text):
    tree = parse(text, "latex") if re.search(r"\\|[\^_]\{", text) else parse(text.replace("^", "**"))
    if tree is None or tree[0] == "num" and any(c.isalpha() for c in text.replace("\\", "")):
        return None
    return show(tree)


#: LaTeX or infix text as infix, null if it can't be read; words set as a product of letters aren't one.
infix = _column(T.StringType(), lambda text: None if _scrambled(text) else _either(text))


#: Letters of a product from which on it is a word.
LETTERS = 4


def product_of_letters(tree) -> bool:
    """Whether a tree is a product of so many single letters that it is a word."""
    count, todo = 0, [tree]
    while todo:  # a long product is nested deeper than calls can be
        part = todo.pop()
        if part[0] == "*":
            todo += part[1:]
        else:
            count += part[0] == "sym" and len(part[1]) == 1
    return tree[0] == "*" and count >= LETTERS


def _scrambled(text) -> bool:
    tree = parse(text, "latex") if "\\" in text else parse(text)
    return tree is not None and product_of_letters(tree)


def _rounded(text, digits):
    def walk(t):
        if t[0] == "num":
            return ("num", float(f"{t[1]:.{digits}g}"))
        return tuple(walk(p) if isinstance(p, tuple) else p for p in t)

    tree = parse(text)
    return None if tree is None else show(walk(tree), "latex")


#: Infix text as LaTeX with numbers to so many significant digits.
rounded_latex = _column(T.StringType(), _rounded)

#: A whole equation in each notation, and what stands for a missing part.
EQUATIONS = {
    "infix": "u(x) - {lam} * ∫[{a},{b}] ({kernel}) u(t) dt = {f}",
    "latex": "u(x) - {lam} \\int_{{{a}}}^{{{b}}} {kernel} \\, u(t) \\, dt = {f}",
    "rpn": "u x {f} = {kernel} u t * {lam} * {a} {b} ∫ -",
    "tokenized": "u ( x ) - <LAMBDA> {lam} <INT> <LOWER> {a} <UPPER> {b} {kernel} u ( t ) dt <SEP> {f}",
    "plain_tokenized": "u ( x ) - {lam} * ∫ {a} {b} {kernel} u ( t ) dt = {f}",
}
MISSING = {"f": "f(x)", "kernel": "K(x,t)", "lam": "λ", "a": "a", "b": "b"}


def filled(template: str, parts: dict[str, Column]) -> Column:
    """A template's text with columns for its names; doubled braces are braces."""
    from string import Formatter

    out = []
    for text, name, _, _ in Formatter().parse(template):
        out += ([F.lit(text)] if text else []) + ([parts[name]] if name else [])
    return F.concat(*out)


def equation(kernel: Column, f: Column, lam: Column, a: Column, b: Column, kind: str = "infix") -> Column:
    """A whole equation in one of EQUATIONS; ``kernel`` and ``f`` are infix texts, the others text or numbers; null or empty parts have names for them."""
    target = "tokenized" if "tokenized" in kind else kind
    spaced = lambda text: F.lit(" ".join(text.replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split()) if target == "tokenized" else text)
    part = lambda c, name: F.coalesce(F.nullif(c.cast("string"), F.lit("")), spaced(MISSING[name]))
    parts = {n: part(convert(c, F.lit("infix"), F.lit(target)) if target != "infix" else c, n) for n, c in (("kernel", kernel), ("f", f))}
    return filled(EQUATIONS[kind], parts | {n: part(c, n) for n, c in (("lam", lam), ("a", a), ("b", b))})


def neumann_terms(kernel: Column, f: Column, n: int = 4) -> Column:
    """A Neumann series as an array of term texts; kernels of further terms are named K_i."""
    own = [F.concat(F.lit("Term 0: "), f)]
    for i in range(1, n):
        composed = kernel if i == 1 else F.concat(F.lit(f"K_{i - 1}*"), kernel)
        own.append(F.concat(F.lit(f"Term {i}: λ^{i} * ∫ "), composed, F.lit(" * f(t) dt")))
    return F.array(*own)


def neumann_text(f: Column, kernel: Column, lam: Column, a: Column, b: Column, n: int = 4, named: bool = True) -> Column:
    """A Neumann series in one text with its bounds and the order of what is left out; with ``named`` its kernels are K^i, else their expression."""
    out = [F.concat(F.lit("u(x) = "), f)]
    head = lambda i: F.concat(F.lit("+ ("), lam.cast("string"), F.lit(f")^{i} * "))
    bounds = F.concat(F.lit("∫["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("] "))
    for i in range(1, n):
        out.append(F.concat(head(i), bounds, F.lit(f"K^{i}(x,t) f(t) dt")) if named else F.concat(head(i), F.lit("("), bounds, kernel, F.lit(f" ...)^{i}")))
    return F.concat_ws(" ", *out, F.lit(f"+ O(λ^{n})"))


def truncated_text(f: Column, n: int = 4) -> Column:
    """The first terms of a Neumann series without the order of the rest."""
    return F.concat(F.lit("u(x) ≈ "), f, *(F.lit(f" + λ^{i} * K^{i}(f)") for i in range(1, n)))


#: Coefficients of the powers of h in f(h), from the derivatives of f at 0 and at a point.
def _taylor(text, at, n):
    """Taylor coefficients at ``at`` by arithmetic of truncated power series; None if a part has no such series there."""
    import math

    tree = parse(text)
    if tree is None or symbols(tree) - {"x"}:
        return None

    def times(p, q):
        return [sum(p[i] * q[k - i] for i in range(k + 1)) for k in range(n)]

    def over(p, q):
        out = []
        for k in range(n):
            out.append((p[k] - sum(out[i] * q[k - i] for i in range(k))) / q[0])
        return out

    def exp(p):
        out = [math.exp(p[0])]
        for k in range(1, n):
            out.append(sum(i * p[i] * out[k - i] for i in range(1, k + 1)) / k)
        return out

    def log(p):
        out = [math.log(p[0])]
        for k in range(1, n):
            out.append((p[k] - sum(i * out[i] * p[k - i] for i in range(1, k)) / k) / p[0])
        return out

    def waves(p, sign):
        one, two = [math.sin(p[0]) if sign < 0 else math.sinh(p[0])], [math.cos(p[0]) if sign < 0 else math.cosh(p[0])]
        for k in range(1, n):
            one.append(sum(i * p[i] * two[k - i] for i in range(1, k + 1)) / k)
            two.append(sign * sum(i * p[i] * one[k - i] for i in range(1, k + 1)) / k)
        return one, two

    def walk(t):
        kind = t[0]
        if kind == "num":
            return [t[1]] + [0.0] * (n - 1)
        if kind == "sym":
            return [at, 1.0][: n] + [0.0] * (n - 2) if t[1] == "x" else [CONSTANTS[t[1]]] + [0.0] * (n - 1)
        if kind == "neg":
            return [-v for v in walk(t[1])]
        if kind in ("+", "-"):
            return [p + q if kind == "+" else p - q for p, q in zip(walk(t[1]), walk(t[2]), strict=True)]
        if kind == "*":
            return times(walk(t[1]), walk(t[2]))
        if kind == "/":
            return over(walk(t[1]), walk(t[2]))
        if kind == "**":
            base, power = walk(t[1]), walk(t[2])
            if not any(power[1:]) and power[0] == int(power[0]) and 0 <= power[0] <= 64:
                out = [1.0] + [0.0] * (n - 1)
                for _ in range(int(power[0])):
                    out = times(out, base)
                return out
            return exp(times(power, log(base)))
        p = walk(t[2])
        if t[1] in ("sin", "cos", "tan", "sinh", "cosh", "tanh"):
            one, two = waves(p, 1 if t[1].endswith("h") else -1)
            return one if t[1].startswith("sin") else two if t[1].startswith("cos") else over(one, two)
        if t[1] == "exp":
            return exp(p)
        if t[1] in ("log", "ln"):
            return log(p)
        if t[1] == "sqrt":
            return exp([v / 2 for v in log(p)])
        raise ValueError(t[1])

    return walk(tree)


def _taylor_text(text, at, n, rest):
    found = _taylor(text, at, n)
    if found is None:
        return None
    step = "x" if at == 0 else f"(x {'-' if at > 0 else '+'} {number(abs(at))})"
    parts = []
    for k, c in enumerate(found):
        c = float(f"{c:.12g}")
        if c:
            power = "" if k == 0 else step if k == 1 else f"{step}**{k}"
            size = number(abs(c))
            word = power if power and size == "1" else f"{size}*{power}" if power else size
            parts.append(("-" if c < 0 else "+", word))
    if rest:
        parts.append(("+", f"O({step}**{n})"))
    if not parts:
        return "0"
    return ("-" if parts[0][0] == "-" else "") + parts[0][1] + "".join(f" {sign} {word}" for sign, word in parts[1:])


#: (expression, point, number of coefficients): the Taylor series as text, with and without the order of what is left out.
taylor_text = _column(T.StringType(), lambda text, at, n: _taylor_text(text, float(at), int(n), True))
taylor_polynomial = _column(T.StringType(), lambda text, at, n: _taylor_text(text, float(at), int(n), False))


def converted(rows: DataFrame, target: str, source: str | None = None, columns: tuple[str, ...] = ("u", "f", "kernel")) -> DataFrame:
    """``rows`` with the expressions in ``target`` notation as u_rpn and so on; a row with one that can't be read goes.

    Without ``source`` each text's own notation is found.
    """
    have = [c for c in columns if c in rows.columns]
    out = rows.withColumns({f"{c}_{target}": convert(F.col(c), F.lit(source) if source else notation(F.col(c)), F.lit(target)) for c in have})
    lost = [F.col(c).isNotNull() & F.col(f"{c}_{target}").isNull() for c in have]
    return out.where(~F.coalesce(F.greatest(*lost) if len(lost) > 1 else lost[0], F.lit(False))) if lost else out
