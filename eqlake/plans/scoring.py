"""The scoring job: every prediction against its truth by solution type, and one report over all.

``scored`` gives a row a prediction and shuffles nothing, so it serves batches and
streams alike; ``report`` is one aggregation over the types and in total.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.canonical import EQUAL, TOO_COMPLEX, compare, operations
from ..functions.expressions import TROUBLE, bleu, errors, family_errors, operators, parse, residuals, show, symbols, with_constants
from ..functions.terms import _coefficients, _family, _series, point_scores
from ..functions.terms import terms as terms_of
from ..functions import metrics
from ..shipping import ship

#: Terms that a series answer should have, and constants for which families are compared.
SERIES_TARGET = 4
FAMILY_SAMPLES = (-1.0, 1.0, 2.0)

_NUMERIC = "struct<max_error: double, mae: double, rmse: double, rel_l2: double, match: boolean>"
_SERIES = "struct<pred_terms: int, gt_terms: int, terms_compared: int, mean_rmse: double, max_rmse: double, term_match_rate: double, match: boolean>"
_COEF = "struct<terms_compared: int, match_rate: double, mean_abs_error: double, max_abs_error: double, mean_rel_error: double, max_rel_error: double, match: boolean>"
_FAMILY = "struct<match: boolean, n_pred: int, n_truth: int, count_match: boolean, naming_valid: boolean>"
_RESIDUAL = "struct<residual_max: double, residual_mean: double, residual_mae: double, residual_rmse: double, verified: boolean>"
SCORES = (
    f"symbolic boolean, numeric {_NUMERIC}, op_precision double, op_recall double, op_f1 double, bleu double, "
    f"series_terms int, series {_SERIES}, coef {_COEF}, family {_FAMILY}, residual {_RESIDUAL}, readable boolean, status string"
)

#: Outcomes of a row: its scores count, a text can't be read, a text has more than OPERATIONS operations or an integral in it too many panels, or
#: (scored all the same) the canonical forms took more than their budget, or the residual wasn't computed for a text of more than CHECKED operations.
SCORED, UNREADABLE, SYMBOLIC_LIMIT, RESIDUAL_SKIPPED = "scored", "unreadable", "symbolic_limit", "residual_skipped"
OPERATIONS, CHECKED = 4000, 800


def coefficient_errors(pred: str, truth: str, tolerance: float = 1e-6, relative: float = 0.1) -> dict | None:
    """How the truth's coefficients are met; a missing term counts as 0."""
    p, q = _coefficients(pred), _coefficients(truth)
    if p is None or not q:
        return None
    off = [abs(p.get(k, 0.0) - c) for k, c in q.items()]
    rel = [o / abs(c) for o, c in zip(off, q.values(), strict=True) if abs(c) > tolerance]
    good = sum(o <= tolerance or (abs(c) > tolerance and o / abs(c) <= relative) for o, c in zip(off, q.values(), strict=True))
    mean = lambda v: sum(v) / len(v) if v else math.inf
    return {
        "terms_compared": len(q), "match_rate": good / len(q), "mean_abs_error": mean(off), "max_abs_error": max(off),
        "mean_rel_error": mean(rel), "max_rel_error": max(rel, default=math.inf), "match": good == len(q),
    }


def _sets(p: set, q: set) -> tuple[float, float, float]:
    if not p and not q:
        return 1.0, 1.0, 1.0
    both = len(p & q)
    return both / len(p) if p else 0.0, both / len(q) if q else 0.0, 2 * both / (len(p) + len(q))


def score(kind, pred, truth, a, b, kernel, f, lam, stored, tolerance, points=100) -> dict:
    """The scores of one prediction that needs its expressions read; unreadable ones have no scores."""
    trees = parse(pred), parse(truth)
    if None in trees:
        return {"readable": False, "status": UNREADABLE}
    sizes = [operations(t) for t in trees]
    if max(sizes) > OPERATIONS:
        return {"status": TOO_COMPLEX}
    out: dict = {"readable": True, "status": SCORED}

    def alike(one, other):
        found = compare(one, other)
        if found == TOO_COMPLEX:
            out["status"] = SYMBOLIC_LIMIT
        return found == EQUAL

    kept = (stored["x_values"], stored["u_values"]) if stored and stored.get("x_values") is not None and len(stored["x_values"]) else None
    if kind == "family":
        free = [sorted(symbols(t) - {"x", "t"}) for t in trees]
        one = [show(with_constants(t, 1.0)) for t in trees]
        valid = bool(free[0]) and all(n == "C" or n.startswith("c_") for n in free[0])
        out["family"] = {"match": _family(pred, truth), "n_pred": len(free[0]), "n_truth": len(free[1]), "count_match": len(free[0]) == len(free[1]), "naming_valid": valid}
        out["symbolic"] = alike(*one)
        out["numeric"] = family_errors(pred, truth, a, b, points, tolerance, FAMILY_SAMPLES, stored)
        out["series"] = _series(*one, a, b, points, tolerance)
        return out
    out["symbolic"] = alike(pred, truth)
    out["numeric"] = errors(pred, truth, a, b, points, tolerance, kept)
    out["op_precision"], out["op_recall"], out["op_f1"] = _sets(set(operators(trees[0])), set(operators(trees[1])))
    out["bleu"] = bleu(pred, truth)
    if kind == "series":
        out["series_terms"] = max(1, len(terms_of(pred) or ()))
        out["series"] = _series(pred, truth, a, b, points, tolerance)
    if kind == "approx_coef":
        out["coef"] = coefficient_errors(pred, truth, tolerance)
    if kernel and f and lam is not None and lam == lam and sizes[0] > CHECKED:
        out["status"] = RESIDUAL_SKIPPED
    elif kernel and f and lam is not None and lam == lam:
        out["residual"] = residuals(pred, kernel, f, lam, a, b, x_values=kept and kept[0])
    return out


#: Scores that a worker has found, over batches and tasks, as different rows are few where models answer one benchmark; forgotten before a batch if there are more than KNOWN.
_known: dict[tuple, dict] = {}
KNOWN = 5_000


def _number(v) -> float:
    return math.nan if v is None else float(v)


def _numbered(column: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones; only rows that have stored lists are looked at in Python."""
    if not pa.types.is_struct(column.type):
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    none = column.flatten()[column.type.get_field_index("none")].fill_null(True)
    rows, found = np.flatnonzero(~none.to_numpy(zero_copy_only=False)), {}
    out = np.zeros(len(column), np.int64)
    out[rows] = [found.setdefault(str(v), len(found) + 1) for v in column.take(pa.array(rows)).to_pylist()]
    return out


def _places(given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, at): the first row of each different one of ``given``, and which of these each row is; no Python a row."""
    at = np.zeros(len(given), np.int64)
    for column in given.flatten():
        own = _numbered(column)
        if len(own) and (own != own[0]).any():
            at = np.unique(at * (int(own.max()) + 1) + own, return_inverse=True)[1]
    _, first, at = np.unique(at, return_index=True, return_inverse=True)
    return first, at


def _scores(given: pa.Array, points: int, form: pa.DataType) -> pa.Array:
    """An Arrow array of ``given`` rows as one of their scores: different rows are scored and converted once, the others refer to them."""
    known = _known
    if len(known) > KNOWN:
        known.clear()
    first, at = _places(given)
    different = []
    for row in given.take(pa.array(first)).to_pylist():
        kind, pred, truth, kernel, f, a, b, lam, tolerance, stored = (row[c] for c in ("kind", "pred", "truth", "kernel", "f", "a", "b", "lam", "tolerance", "stored"))
        stored = _received(stored)
        key = (points, kind, pred, truth, kernel, f, a, b, None if lam != lam else lam, tolerance, str(stored))
        if key not in known:
            try:
                known[key] = score(kind, pred, truth, _number(a), _number(b), kernel, f, _number(lam), stored, _number(tolerance), points) if pred and truth else {}
            except RecursionError:
                known[key] = {"status": TOO_COMPLEX}
            except TROUBLE:
                known[key] = {"readable": False, "status": UNREADABLE}
        different.append(known[key])
    return pa.array(different, form).take(pa.array(at))


def of(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


POINTS = "array<struct<x: double, y: double>>"
STORED = "struct<x_values: array<double>, u_values: array<double>, u_values_samples: array<array<double>>, constant_samples: array<double>>"


def sent_lists(stored: Column) -> Column:
    """``stored`` for Python with empty lists and flags in place of nulls: null lists make Spark's Arrow writer pass over all rows of a batch for each row."""
    fields = T.StructType.fromDDL(f"v {STORED}")["v"].dataType.fields
    lists = [F.coalesce(stored[f.name], F.array().cast(f.dataType)).alias(f.name) for f in fields]
    return F.struct(stored.isNull().alias("none"), F.array(*(stored[f.name].isNull() for f in fields)).alias("nulls"), *lists)


def _received(sent: dict | None) -> dict | None:
    """What ``sent_lists`` was given; null numbers are NaN."""
    if sent is None or sent["none"]:
        return None
    lists = [(k, v) for k, v in sent.items() if k not in ("none", "nulls")]
    return {k: None if null else [[_number(y) for y in x] if isinstance(x, list) else _number(x) for x in v] for (k, v), null in zip(lists, sent["nulls"], strict=True)}


def scored(results: DataFrame, tolerance: float = 1e-6, type_tolerances: dict[str, float] | None = None, points: int = 100) -> DataFrame:
    """``results`` with ``kind``, ``evaluated``, ``correct``, ``status`` and the scores of its type; a column that is missing counts as null.

    Read are solution_str, ground_truth, has_solution, ground_truth_has_solution, solution_type,
    ground_truth_solution_type, ground_truth_domain ([0, 1] without one), evaluation_points,
    ground_truth_kernel, ground_truth_f, ground_truth_lambda, pred_points, gt_points and api_error.

    By the truth's type: ``none`` is right if the answer denies a solution, ``regularized`` if it
    names that type, ``discrete_points`` with point lists if enough points match, ``family`` if the ratio or
    difference is constant, or the expressions agree, or match for all sample constants; the rest if
    expressions agree or match on the stored points, else on a grid. A row that
    lacks an expression, can't be read, is too complex, or had no answer of the interface isn't evaluated, so it is in no denominator.
    """
    kinds = of(results, "ground_truth_solution_type", "string")
    domain = of(results, "ground_truth_domain", "array<double>")
    limit = F.lit(tolerance)
    for kind, own in (type_tolerances or {}).items():
        limit = F.when(kinds == kind, F.lit(own)).otherwise(limit)
    failed = F.coalesce(of(results, "api_error", "boolean"), F.lit(False))
    texts = kinds.isin("none", "regularized") | failed
    text = lambda c: F.when(~F.coalesce(texts, F.lit(False)), F.nullif(of(results, c, "string"), F.lit("")))
    held = "evaluation_points" in results.columns and isinstance(results.schema["evaluation_points"].dataType, T.StructType)
    stored = sent_lists(of(results, "evaluation_points", STORED)) if held else F.lit(None).cast("string")
    given = F.struct(
        kinds.alias("kind"), text("solution_str").alias("pred"), text("ground_truth").alias("truth"),
        F.coalesce(F.get(domain, F.lit(0)), F.lit(0.0)).alias("a"), F.coalesce(F.get(domain, F.lit(1)), F.lit(1.0)).alias("b"),
        of(results, "ground_truth_kernel", "string").alias("kernel"), of(results, "ground_truth_f", "string").alias("f"), of(results, "ground_truth_lambda", "double").alias("lam"),
        stored.alias("stored"), limit.cast("double").alias("tolerance"),
    )

    form = to_arrow_type(T.StructType.fromDDL(SCORES))

    @F.arrow_udf(SCORES)
    def computed(rows: pa.Array) -> pa.Array:
        return _scores(rows, points, form)

    ship(results.sparkSession)
    out = results.withColumn("_scores", computed(given))
    pred, truth = of(results, "pred_points", POINTS), of(results, "gt_points", POINTS)
    listed = F.coalesce((kinds == "discrete_points") & pred.isNotNull() & truth.isNotNull(), F.lit(False))
    # a column of its own, so that lists are matched once a row and not for each value that is taken from it
    out = out.withColumn("_met", F.when(listed & ~failed, point_scores(pred, truth, y_tolerance=tolerance)))
    met = F.col("_met")
    says, type_said = of(results, "has_solution", "boolean"), of(results, "solution_type", "string")
    s = F.col("_scores")
    read = F.coalesce(s["readable"], F.lit(False))
    near, alike = F.coalesce(s["numeric"]["match"], F.lit(False)), F.coalesce(s["symbolic"], F.lit(False))
    right = (
        F.when(kinds == "none", says.eqNullSafe(F.lit(False)))
        .when(kinds == "regularized", type_said.eqNullSafe(F.lit("regularized")))
        .when(listed, met["match"])
        .when(~read, F.lit(None).cast("boolean"))
        .otherwise(near | alike | F.coalesce(s["family"]["match"], F.lit(False)))
    )
    verdict = kinds.isin("none", "regularized")
    alone = lambda c: F.when(verdict, right).otherwise(c)
    perfect = F.when(verdict & right, 0.0).when(verdict, float("inf"))
    number = lambda k: F.coalesce(perfect, F.when(listed, met[k] if k in ("max_error", "mae", "rmse") else F.lit(None)).otherwise(s["numeric"][k]))
    done = out.select(
        *results.columns,
        kinds.alias("kind"),
        F.when(failed, F.lit(None)).otherwise(right).alias("correct"),
        (right.isNotNull() & ~failed).alias("evaluated"),
        F.coalesce(F.when(~failed, F.when(F.coalesce(verdict, F.lit(False)) | listed, F.lit(None)).otherwise(F.col("_scores.readable") == False)), F.lit(False)).alias("unreadable"),  # noqa: E712
        F.when(failed, "api_error").when(F.coalesce(verdict, F.lit(False)) | listed, SCORED).otherwise(F.coalesce(s["status"], F.lit("missing"))).alias("status"),
        alone(alike).alias("symbolic_match"),
        F.when(listed, met["match"]).otherwise(alone(near)).alias("numeric_match"),
        *(number(k).alias(k) for k in ("max_error", "mae", "rmse")),
        F.when(~F.coalesce(verdict, F.lit(False)), s["numeric"]["rel_l2"]).alias("rel_l2"),
        *(s[k].alias(k) for k in ("op_precision", "op_recall", "op_f1", "bleu", "series_terms", "series", "coef", "family", "residual")),
        met.alias("points"),
    )
    return done


def report(rows: DataFrame) -> DataFrame:
    """A row for each type of truth (null: unknown) and one in total (``all``): one aggregation of partial sums.

    Means leave out null, NaN and infinite values. Rates of nothing are null; the three of ``none`` detection are 0 then.
    """
    said_none = of(rows, "has_solution", "boolean").eqNullSafe(F.lit(False))
    truth_says, says = of(rows, "ground_truth_has_solution", "boolean"), of(rows, "has_solution", "boolean")
    truth_type, type_said = of(rows, "ground_truth_solution_type", "string"), of(rows, "solution_type", "string")
    known = F.col("evaluated")
    right = F.coalesce(F.col("correct"), F.lit(False))
    series = known & (F.col("kind") == "series") & F.col("series_terms").isNotNull()
    coef = known & F.col("coef").isNotNull()
    listed = known & F.col("points").isNotNull()
    family = known & F.col("family").isNotNull()
    held = F.col("residual").isNotNull() & known
    mean = lambda c, where=known: metrics.finite_mean(F.when(where, c))
    share = lambda c, where: F.count_if(where & c) / F.nullif(F.count_if(where), F.lit(0))
    wide = rows.withColumn("solution_kind", F.coalesce("kind", F.lit("unknown")))
    out = wide.rollup("solution_kind").agg(
        F.count("*").alias("results"),
        F.count_if(known).alias("total"),
        F.count_if(known & right).alias("correct"),
        F.count_if("unreadable").alias("parse_errors"),
        F.count_if(F.col("status") == TOO_COMPLEX).alias("too_complex"),
        F.count_if(F.col("status") == SYMBOLIC_LIMIT).alias("symbolic_limits"),
        F.count_if(F.col("status") == RESIDUAL_SKIPPED).alias("residuals_skipped"),
        share(right, known).alias("accuracy"),
        share(F.coalesce(F.col("symbolic_match"), F.lit(False)), known).alias("symbolic_accuracy"),
        share(F.coalesce(F.col("numeric_match"), F.lit(False)), known).alias("numeric_accuracy"),
        *(mean(F.col(c)).alias(f"mean_{c}") for c in ("mae", "rmse", "max_error", "rel_l2", "op_precision", "op_recall", "op_f1", "bleu")),
        F.count_if(truth_says.isNotNull() & says.isNotNull()).alias("has_solution_total"),
        metrics.accuracy(truth_says, says).alias("has_solution_accuracy"),
        F.count_if((truth_type != "") & (type_said != "")).alias("solution_type_total"),
        metrics.accuracy(F.nullif(truth_type, F.lit("")), F.nullif(type_said, F.lit(""))).alias("solution_type_accuracy"),
        F.count_if((F.col("kind") == "none") & said_none).alias("none_tp"),
        F.count_if((F.col("kind") != "none") & said_none).alias("none_fp"),
        F.count_if((F.col("kind") == "none") & ~said_none).alias("none_fn"),
        F.count_if(series).alias("series_total"),
        F.count_if(series & (F.col("series_terms") == SERIES_TARGET)).alias("series_match"),
        F.min(F.when(series, F.col("series_terms"))).alias("series_min"),
        F.max(F.when(series, F.col("series_terms"))).alias("series_max"),
        F.avg(F.when(series, F.col("series_terms"))).alias("series_mean"),
        F.count_if(coef).alias("coef_total"),
        F.avg(F.when(coef, F.col("coef.match_rate"))).alias("coef_match_rate"),
        F.avg(F.when(coef, F.col("coef.mean_abs_error"))).alias("coef_abs_error"),
        F.avg(F.when(coef, F.col("coef.mean_rel_error"))).alias("coef_rel_error"),
        F.count_if(listed).alias("points_total"),
        (F.sum(F.when(listed, F.col("points.matched_points"))) / F.nullif(F.sum(F.when(listed, F.col("points.total_points_gt"))), F.lit(0))).alias("matched_point_rate"),
        F.avg(F.when(listed, F.col("points.accuracy"))).alias("points_accuracy"),
        F.avg(F.when(listed, F.col("points.rmse"))).alias("points_rmse"),
        F.count_if(family).alias("family_total"),
        share(F.col("family.naming_valid"), family).alias("naming_convention_rate"),
        share(F.col("family.count_match"), family).alias("param_count_match_rate"),
        F.count_if(held).alias("residual_total"),
        F.count_if(held & F.col("residual.verified")).alias("verified_count"),
        share(F.col("residual.verified"), held).alias("verified_rate"),
        *(F.avg(F.when(held, F.col(f"residual.{c}"))).alias(f"mean_{c}") for c in ("residual_max", "residual_mean", "residual_mae", "residual_rmse")),
    )
    tp, fp, fn = F.col("none_tp"), F.col("none_fp"), F.col("none_fn")
    precision, recall = metrics.ratio(tp, tp + fp), metrics.ratio(tp, tp + fn)
    out = out.withColumns({"none_precision": precision, "none_recall": recall, "none_f1": metrics.ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("solution_kind", F.coalesce("solution_kind", F.lit("all")))


def confusion(rows: DataFrame) -> DataFrame:
    """``cell, n``: how often a type was taken for another; a blank one isn't counted."""
    truth, said = of(rows, "ground_truth_solution_type", "string"), of(rows, "solution_type", "string")
    return rows.where((truth != "") & (said != "") & (truth != said)).groupBy(F.concat_ws("_predicted_as_", truth, said).alias("cell")).agg(F.count("*").alias("n"))


def options(settings: dict) -> dict:
    """What ``scored`` takes, from the evaluation section of ``readers.settings``."""
    own = settings["evaluation"]
    return {"tolerance": own["numeric_tolerance"], "type_tolerances": own["type_tolerances"], "points": own["points"]}


def evaluate(results: DataFrame, path: str | None = None, settings: dict | None = None, **given) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored rows, report, confusion) by ``settings``, single options of ``scored`` before them; with ``path`` the rows are written there first and the others read them, so that nothing is scored twice."""
    rows = scored(results, **((options(settings) if settings else {}) | given))
    if path:
        rows.write.parquet(path)
        rows = results.sparkSession.read.parquet(path)
    return rows, report(rows), confusion(rows)
