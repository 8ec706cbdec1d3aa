"""Sums term by term: coefficients, series, families of solutions, lists of points, and checks of equations.

A term is a number times powers of other factors. Products of sums are
multiplied out and like terms put together; nothing else is simplified, so
sin(x)**2 + cos(x)**2 has two terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from .expressions import _column, on, parse, show, symbols, value

#: Products of sums aren't multiplied out beyond this many terms; such an expression is unreadable here (null).
MOST_TERMS = 512


def _sum(tree) -> list[tuple[float, dict]]:
    """(coefficient, {factor's text: (factor, exponent)}) of each term, like terms not yet put together."""
    kind = tree[0]
    if not symbols(tree):
        return [(float(value(tree, {})), {})]
    if kind in ("+", "-"):
        return _sum(tree[1]) + [(c if kind == "+" else -c, p) for c, p in _sum(tree[2])]
    if kind == "neg":
        return [(-c, p) for c, p in _sum(tree[1])]
    if kind == "*":
        out = [_product(p, q) for p in _sum(tree[1]) for q in _sum(tree[2])]
    elif kind == "/" and len(below := _sum(tree[2])) == 1 and below[0][0]:
        c, parts = below[0]
        out = [_product(p, (1 / c, {k: (f, -n) for k, (f, n) in parts.items()})) for p in _sum(tree[1])]
    elif kind == "**" and tree[2][0] == "num" and len(base := _sum(tree[1])) == 1 and base[0][0] > 0:
        c, parts = base[0]
        out = [(c ** tree[2][1], {k: (f, n * tree[2][1]) for k, (f, n) in parts.items()})]
    elif kind == "**" and tree[2][0] == "num" and tree[2][1] in range(2, 9):
        out = base
        for _ in range(int(tree[2][1]) - 1):
            out = [_product(p, q) for p in out for q in base]
            if len(out) > MOST_TERMS:
                break
    else:
        out = [(1.0, {show(tree): (tree, 1.0)})]
    if len(out) > MOST_TERMS:
        raise ValueError("too many terms")
    return out


def _product(p, q):
    parts = dict(p[1])
    for k, (f, n) in q[1].items():
        parts[k] = (f, n + (parts[k][1] if k in parts else 0.0))
    return p[0] * q[0], {k: v for k, v in parts.items() if v[1]}


def terms(text: str) -> list[tuple[str, float, dict]] | None:
    """(base, coefficient, factors) of each term, high powers of x first; null if unreadable, empty for zero."""
    tree = parse(text)
    if tree is None:
        return None
    together: dict[str, tuple[float, dict]] = {}
    try:
        for c, parts in _sum(tree):
            key = "*".join(k if n == 1 else f"({k})**{n:g}" for k, (_, n) in sorted(parts.items())) or "1"
            together[key] = (together.get(key, (0.0,))[0] + c, parts)
    except (ValueError, KeyError, OverflowError, ZeroDivisionError, RecursionError):
        return None
    out = [(k, c, p) for k, (c, p) in together.items() if c]
    return sorted(out, key=lambda t: (-t[2].get("x", (None, 0.0))[1], t[0]))


def _coefficients(text):
    found = terms(text)
    return None if found is None else {k: c for k, c, _ in found}


def _values(term, x):
    out = np.full(x.shape, term[1])
    with np.errstate(all="ignore"):
        for f, n in term[2].values():
            out = out * np.power(on(f, x=x), n)
    return out


def _series(pred, truth, a, b, points=100, tolerance=1e-6):
    p, q = terms(pred), terms(truth)
    if not p or not q or any(symbols(f) - {"x"} for t in p + q for f, _ in t[2].values()):
        return None
    x = np.linspace(a, b, points)
    each = [float(np.sqrt(((_values(s, x) - _values(t, x)) ** 2).mean())) for s, t in zip(p, q, strict=False)]
    good = sum(e < tolerance for e in each)
    return {"pred_terms": len(p), "gt_terms": len(q), "terms_compared": len(each), "mean_rmse": float(np.mean(each)), "max_rmse": float(np.max(each)), "term_match_rate": good / len(each), "match": good == len(each)}


def _family(pred, truth):
    p, q = parse(pred), parse(truth)
    if p is None or q is None or not (free := symbols(q) - {"x", "t"}):
        return False
    x = np.linspace(0.11, 1.37, 24)
    own = {s: 0.7 + 0.3 * k for k, s in enumerate(sorted(symbols(p) - {"x"}))}
    one = on(p, x=x, **{s: np.full(x.shape, v) for s, v in own.items()})
    other = on(q, x=x, **{s: np.ones(x.shape) for s in free | (symbols(q) & {"t"})})
    if not np.abs(other).max() > 0:
        return False
    with np.errstate(all="ignore"):
        for found in (one / other, one - other):
            known = found[np.isfinite(found)]
            if len(known) >= 8 and np.ptp(known) <= 1e-8 * max(1.0, np.abs(known).max()):
                return True
    return False


def _strange(text, known):
    tree = parse(text)
    return None if tree is None else sorted(symbols(tree) - set(known.split()))


_SERIES = "pred_terms int, gt_terms int, terms_compared int, mean_rmse double, max_rmse double, term_match_rate double, match boolean"

#: ``map<base, coefficient>`` of an expression.
coefficients = _column(T.MapType(T.StringType(), T.DoubleType()), _coefficients)
n_terms = _column(T.IntegerType(), lambda e: None if (t := terms(e)) is None else max(1, len(t)))
#: True if the ratio or the difference of (pred, truth) doesn't depend on x once the truth's constants are 1.
family_match = _column(T.BooleanType(), _family)
#: Symbols of an expression that aren't among the space-separated known ones; null if it can't be read.
strange_symbols = _column(T.ArrayType(T.StringType()), _strange)


def series_scores(pred, truth, a, b) -> Column:
    """Terms of (pred, truth) paired in order, their errors over a grid; null if unreadable or other symbols than x are left."""
    import json

    text = _column(T.StringType(), lambda *v: None if (out := _series(*v)) is None else json.dumps(out).replace("NaN", '"NaN"').replace("Infinity", '"Infinity"'))
    return F.from_json(text(pred, truth, a, b), _SERIES)


def coefficient_scores(pred: Column, truth: Column, tolerance: float = 1e-6, relative: float = 0.1) -> Column:
    """Struct of how the truth's coefficients are met by ``pred``.

    Both are map columns, not UDF calls, which Spark doesn't take inside lambdas.
    A missing term counts as 0. Null if the truth has none.
    """
    each = F.transform(
        F.map_entries(truth),
        lambda e: F.struct(F.abs(F.coalesce(F.try_element_at(pred, e["key"]), F.lit(0.0)) - e["value"]).alias("off"), F.abs(e["value"]).alias("size")),
    )
    each = F.transform(each, lambda e: F.struct(e["off"].alias("off"), F.when(e["size"] > tolerance, e["off"] / e["size"]).alias("rel")))
    good = F.size(F.filter(each, lambda e: (e["off"] <= tolerance) | F.coalesce(e["rel"] <= relative, F.lit(False))))
    offs, rels = F.transform(each, lambda e: e["off"]), F.array_compact(F.transform(each, lambda e: e["rel"]))
    scores = F.struct(
        F.size(each).alias("terms_compared"),
        (good / F.size(each)).alias("match_rate"),
        mean(offs).alias("mean_abs_error"),
        F.array_max(offs).alias("max_abs_error"),
        mean(rels).alias("mean_rel_error"),
        F.coalesce(F.array_max(rels), F.lit(float("inf"))).alias("max_rel_error"),
        (good == F.size(each)).alias("match"),
    )
    return F.when((F.size(truth) > 0) & pred.isNotNull(), scores)


def mean(values: Column) -> Column:
    """Of an array; infinite if it is empty."""
    return F.when(F.size(values) == 0, F.lit(float("inf"))).otherwise(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0)))


def point_scores(pred: Column, truth: Column, x_tolerance: float = 1e-3, y_tolerance: float = 1e-3, share: float = 0.8) -> Column:
    """Struct of how ``pred`` meets ``truth``, both ``array<struct<x, y>>``: each point against the nearest in x, the first on ties.

    A match needs ``share`` of the predicted points. An empty or null side
    gives no match and infinite errors. Native.
    """
    none = F.array().cast("array<struct<x: double, y: double>>")
    p, q = F.coalesce(pred, none), F.coalesce(truth, none)

    def met(n: Column) -> Column:
        offs = n["offs"]
        matched = F.size(F.filter(offs, lambda d: d < y_tolerance))
        return F.struct(
            ((matched > 0) & (matched >= n["n_pred"] * share)).alias("match"),
            matched.alias("matched_points"),
            n["n_pred"].alias("total_points_pred"),
            n["n_truth"].alias("total_points_gt"),
            F.coalesce(matched / F.nullif(n["n_pred"], F.lit(0)), F.lit(0.0)).alias("accuracy"),
            F.coalesce(F.array_max(offs), F.lit(float("inf"))).alias("max_error"),
            mean(offs).alias("mae"),
            F.sqrt(mean(F.transform(offs, lambda d: d * d))).alias("rmse"),
        )

    near = F.transform(p, lambda s: F.struct(s["y"].alias("y"), F.array_min(F.transform(q, lambda g, i: F.struct(F.abs(g["x"] - s["x"]).alias("d"), i.alias("i"), g["y"].alias("y")))).alias("g")))
    offs = F.array_compact(F.transform(near, lambda n: F.when(n["g"]["d"] < x_tolerance, F.abs(n["g"]["y"] - n["y"]))))
    # in a list of one, as what a lambda takes is computed once, and not for each value that is taken from it
    return F.get(F.transform(F.array(F.struct(offs.alias("offs"), F.size(p).alias("n_pred"), F.size(q).alias("n_truth"))), met), F.lit(0))


def checked(equations: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """``equations`` (text columns kernel, f, lambda_val, doubles a, b, optionally solution) with valid, errors, warnings.

    A required column that is missing or null, an expression that can't be read or has
    other symbols, a lambda that is no number and a >= b are errors; a lambda of 0, no domain and
    an odd or missing solution are warnings. ``rules`` are further checks: a column is an error's text,
    or a warning's if its name begins with "warn", or null. Rows stay; nothing is shuffled.
    """
    col = lambda c: F.col(c) if c in equations.columns else F.lit(None).cast("string")

    def expression(c: str, known: str, name: str):
        strange = strange_symbols(col(c), F.lit(known))
        return F.when(col(c).isNull(), None).when(strange.isNull(), F.lit(f"Invalid {name}: unreadable")).when(F.size(strange) > 0, F.concat(F.lit(f"Invalid {name}: "), F.array_join(strange, ", ")))

    lam = col("lambda_val").try_cast("double")
    errors = [F.when(col(c).isNull(), F.lit(f"Missing required field: {c}")) for c in ("kernel", "f", "lambda_val")]
    errors += [expression("kernel", "x t", "kernel"), expression("f", "x", "f(x)"), F.when(col("lambda_val").isNotNull() & lam.isNull(), "lambda_val must be a number"), F.when(col("a") >= col("b"), "Invalid domain: a must be less than b")]
    warnings = [F.when(lam == 0, "lambda_val is 0 (trivial case)"), F.when(col("a").isNull() | col("b").isNull(), "Missing recommended field: domain"), F.when(col("solution").isNull(), "Missing recommended field: solution"), expression("solution", "x", "solution format")]
    for name, rule in (rules or {}).items():
        (warnings if name.startswith("warn") else errors).append(rule)
    out = equations.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.array_compact(F.array(*warnings))})
    return out.withColumn("valid", F.size("errors") == 0)


def validation_report(rows: DataFrame, key: str, most: int = 100) -> DataFrame:
    """``total, valid, invalid, first_errors`` of checked rows in one row; the errors are those of the first ``most`` invalid rows by key."""
    totals = rows.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    first = rows.where(~F.col("valid")).select(F.col(key).alias("key"), "errors").orderBy("key").limit(most)
    return totals.crossJoin(first.agg(F.sort_array(F.collect_list(F.struct("key", "errors"))).alias("first_errors")))


def checked_augmented(rows: DataFrame) -> DataFrame:
    """``checked`` with what doesn't agree between an augmented row's type and its solution."""
    u = F.coalesce(F.col("u").cast("string"), F.lit(""))
    return checked(rows, {
        "solved_none": F.when(F.col("solution_type").isin("none", "none_solution") & (u != ""), F.concat(F.lit("type none has a solution: "), u)),
        "unsolved": F.when(F.col("solution_type").isin("exact_symbolic", "family") & (u == ""), F.concat(F.lit("no solution for type "), F.col("solution_type"))),
    })


def augmented_report(rows: DataFrame) -> DataFrame:
    """``edge_case, solution_type, rows, valid, invalid, pct``: by edge case, by type, and in total (both null), as grouping sets of checked rows."""
    out = rows.groupingSets([["edge_case"], ["solution_type"], []], "edge_case", "solution_type").agg(
        F.count("*").alias("rows"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.grouping_id().alias("level"),
        F.count_if(F.coalesce(F.col("edge_case"), F.lit("none")) != "none").alias("_odd"),
    )
    return out.withColumn("pct", F.when(F.col("level") == 3, 100 * F.col("_odd") / F.nullif(F.col("rows"), F.lit(0)))).drop("_odd")
