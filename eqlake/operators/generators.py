"""Row generators: each equation gives the template rows of the chosen strategies; a projection and an explode, no join.

Evaluation points and sample meshes come with it: fixed places at which solutions are compared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from ..functions.canonical import renamed
from ..functions.expressions import _Alike, _column, _integrals, _settled, by_pattern, kernel_integrals, on, parse, show, symbols, with_constants
from ..functions.notation import filled

#: Parameters of the templates: width of a boundary layer, base frequency, band width, terms and scale of a series, distance to a
#: resonance, regularization parameter, sample points.
LAYER, FREQUENCY, BAND, SERIES_TERMS, SERIES_SCALE, DISTANCE, ALPHA, SAMPLES = 0.01, 10.0, 0.1, 4, 0.3, 0.1, 0.01, 10

#: Numbers and texts that templates name, in SQL over a, b and lambda_val; ``g`` ends are shown to six digits, ``t`` texts in full.
NAMES = {
    "a": "a", "b": "b",
    "g2": "a + 0.2D * (b - a)", "g6": "a + 0.6D * (b - a)", "g8": "a + 0.8D * (b - a)", "g15": "a + 0.15D * (b - a)", "g4": "a + 0.4D * (b - a)", "g55": "a + 0.55D * (b - a)",
    "ga": "a", "gb": "b", "c": "a + 0.3D * (b - a)", "d": "a + 0.6D * (b - a)",
}


@dataclass(frozen=True)
class Template:
    """One template row. Kernel, f and u may name NAMES in braces; f or u None is the equation's own."""

    variant: str
    kernel: str
    f: str | None
    u: str | None
    lam: str
    has_solution: bool
    kind: str
    methods: tuple[str, ...]
    reason: str
    where: str = "true"
    details: dict = field(default_factory=dict, hash=False)


def _box(*regions: str) -> str:
    """A kernel that is 1 where x and t lie in the same of some intervals."""
    parts = [f"(1, (x>={{{p}}}) & (x<={{{q}}}) & (t>={{{p}}}) & (t<={{{q}}}))" for p, q in (r.split() for r in regions)]
    return f"Piecewise({', '.join(parts)}, (0, True))"


_EIGEN = ("Check Fredholm Alternative conditions", "Verify eigenvalue")
_LAYER_LEFT, _LAYER_RIGHT = f"exp(-(x - {{a}})/{LAYER})", f"exp((x - {{b}})/{LAYER})"
_LAYERS = f"(tanh((x - {{a}})/{LAYER}) + tanh(({{b}} - x)/{LAYER}))/2"
_W10, _W8, _W12 = FREQUENCY * 10, FREQUENCY * 8, FREQUENCY * 12
_RESONANCE = ("recognize_resonance", "eigenvalue_analysis", "fredholm_alternative")

#: The template rows of each strategy, their variants, formulas, factors of lambda, types and recommended methods. The reasons are our own words.
STRATEGIES: dict[str, tuple[Template, ...]] = {
    "eigenvalue_cases": (
        Template("constant_kernel_eigenvalue", "1", "x", "", "if(b = a, 1.0D, 1 / (b - a))", False, "none", _EIGEN, "lambda is the eigenvalue of a constant kernel"),
        Template("separable_kernel_eigenvalue", "x*t", "x**2", "", "if(b = a, 1.0D, 3 / (b * b * b - a * a * a))", False, "none", _EIGEN, "lambda is the eigenvalue of x t", "a >= 0"),
        Template("symmetric_kernel_eigenvalue", "cos(x - t)", "sin(x)", "", "1.0D", False, "none", _EIGEN, "lambda is taken as an eigenvalue of a symmetric kernel"),
    ),
    "range_violation": (
        Template("even_odd_mismatch", "cos(x) * cos(t)", "x", "", "lambda_val", False, "none", ("symmetry_analysis", "range_space_decomposition", "parity_check"), "f is odd, the kernel gives even functions only", details={"operator_property": "even_symmetry"}),
        Template("separable_orthogonal", "sin(pi*x) * sin(pi*t)", "cos(pi*x)", "", "lambda_val * 0.5D", False, "none", ("separability_detection", "orthogonality_test", "range_projection"), "f is orthogonal to the range of a kernel of rank one", details={"operator_property": "separable_rank_one"}),
        Template("finite_rank_incompatible", "sin(x)*sin(t) + cos(x)*cos(t)", "x**2", "", "lambda_val * 0.3D", False, "none", ("rank_analysis", "basis_expansion", "projection_test"), "f lies outside the span of sin(x) and cos(x)", details={"operator_property": "finite_rank", "kernel_rank": "2"}),
    ),
    "divergent_kernel": (
        Template("cauchy_singularity", "1 / (abs(x - t) + 1e-10)", None, "", "lambda_val * 0.1D", False, "none", ("reject_as_ill_formed", "propose_regularization", "suggest_cauchy_principal_value"), "the kernel has a pole of first order", details={"singularity_order": "1.0", "singularity_strength": "strong", "divergence_type": "logarithmic"}),
        Template("second_order_pole", "1 / (abs(x - t) + 1e-10)**2", None, "", "lambda_val * 0.05D", False, "none", ("reject_as_ill_formed", "check_dimension_compatibility", "suggest_finite_part_integral"), "the kernel has a pole of second order", details={"singularity_order": "2.0", "singularity_strength": "very_strong", "divergence_type": "power_law"}),
        Template("mixed_smooth_divergent", "(1 + x*t) / (abs(x - t) + 1e-10)", None, "", "lambda_val * 0.1D", False, "none", ("singularity_extraction", "dominant_singularity_analysis", "reject_if_unfixable"), "a smooth factor doesn't remove the pole", details={"singularity_order": "1.0", "singularity_strength": "strong", "divergence_type": "logarithmic_with_weight"}),
    ),
    "disconnected_support": (
        Template("two_disconnected_regions", _box("ga g2", "g6 g8"), None, "", "lambda_val * 0.2D", False, "none", ("check_rank_deficiency", "identify_decoupled_blocks", "analyze_subsystems_separately"), "the kernel lives on two regions that don't interact", details={"support_type": "disconnected_regions", "num_support_regions": "2", "zero_fraction": "0.8", "matrix_structure": "block_diagonal", "rank_deficient_risk": "high"}),
        Template("three_disconnected_regions", _box("ga g15", "g4 g55", "g8 gb"), None, "", "lambda_val * 0.15D", False, "none", ("rank_analysis", "block_structure_detection", "compatibility_check"), "the kernel lives on three regions that don't interact", details={"support_type": "disconnected_regions", "num_support_regions": "3", "zero_fraction": "0.7", "matrix_structure": "block_diagonal", "rank_deficient_risk": "very_high"}),
    ),
    "weakly_singular": (
        Template("logarithmic_kernel", "log(abs(x - t) + 1e-10)", None, None, "lambda_val * 0.1D", True, "approx_coef", ("product_integration", "singularity_subtraction", "graded_mesh"), "the kernel has a logarithmic singularity", details={"singularity_type": "logarithmic", "singularity_order": "0"}),
        Template("power_law_kernel", "1/sqrt(abs(x - t) + 1e-8)", None, None, "lambda_val * 0.1D * 0.5D", True, "approx_coef", ("product_integration", "abel_transform", "collocation_with_grading"), "the kernel has a singularity of order one half", details={"singularity_type": "power_law", "singularity_order": "0.5"}),
        Template("algebraic_mixed_kernel", "(x + t + 1) / sqrt(abs(x - t) + 1e-8)", None, None, "lambda_val * 0.1D * 0.3D", True, "approx_coef", ("product_integration", "singularity_extraction", "nyström_modified"), "a smooth factor and a singularity of order one half", details={"singularity_type": "algebraic_mixed", "singularity_order": "0.5"}),
    ),
    "boundary_layer": (
        Template("left_exponential_layer", "x * t", _LAYER_LEFT, _LAYER_LEFT, "lambda_val * 0.2D", True, "approx_coef", ("adaptive_mesh_refinement", "exponential_mesh_grading", "shishkin_mesh"), "the solution falls in a thin layer at the left end", details={"layer_location": "left", "layer_width_estimate": str(LAYER), "minimum_points_in_layer": "10"}),
        Template("right_exponential_layer", "1 + x + t", _LAYER_RIGHT, _LAYER_RIGHT, "lambda_val * 0.2D", True, "approx_coef", ("adaptive_mesh_refinement", "exponential_mesh_grading", "shishkin_mesh"), "the solution rises in a thin layer at the right end", details={"layer_location": "right", "layer_width_estimate": str(LAYER), "minimum_points_in_layer": "10"}),
        Template("double_tanh_layers", "sin(x) * cos(t)", _LAYERS, _LAYERS, "lambda_val * 0.2D * 0.5D", True, "approx_coef", ("adaptive_mesh_refinement", "double_exponential_grading", "shishkin_mesh_double"), "the solution has a thin layer at either end", details={"layer_location": "both", "layer_width_estimate": str(LAYER), "minimum_points_in_layer": "15"}),
    ),
    "oscillatory_solution": (
        Template("high_frequency_sine", "x * t", f"sin({_W10} * pi * x)", f"sin({_W10} * pi * x)", "lambda_val * 0.1D", True, "approx_coef", ("filon_quadrature", "levin_collocation", "fine_uniform_sampling", "adaptive_sampling"), "the solution oscillates fast", details={"oscillation_type": "sinusoidal", "angular_frequency": f"{_W10}*pi"}),
        Template("amplitude_modulated", "1 + x + t", f"(1 + x) * sin({_W8} * pi * x)", f"(1 + x) * sin({_W8} * pi * x)", "lambda_val * 0.1D * 0.8D", True, "approx_coef", ("adaptive_quadrature", "filon_with_modulation", "variable_step_runge_kutta"), "the solution oscillates fast with a rising amplitude", details={"oscillation_type": "amplitude_modulated", "angular_frequency": f"{_W8}*pi"}),
        Template("multi_frequency_beating", "sin(x) * cos(t)", f"sin({_W10} * pi * x) + sin({_W12} * pi * x)", f"sin({_W10} * pi * x) + sin({_W12} * pi * x)", "lambda_val * 0.1D * 0.5D", True, "approx_coef", ("fourier_based_quadrature", "spectral_collocation", "fine_uniform_sampling"), "two near frequencies beat", details={"oscillation_type": "multi_frequency_beating", "angular_frequency": f"{_W10}*pi, {_W12}*pi"}),
    ),
    "mixed_type": (
        Template("piecewise_split", "Piecewise((t, t <= x), (x, True))", None, None, "lambda_val * 0.5D", True, "approx_coef", ("hybrid_method", "marching_plus_boundary", "domain_decomposition"), "the kernel is of one kind below x and another above", details={"equation_type": "volterra_fredholm_mixed", "split_point": "x", "causal_structure": "partial"}),
        Template("smooth_transition", "tanh((x - t) / 0.1)", None, None, "lambda_val * 0.3D", True, "approx_coef", ("adaptive_quadrature", "implicit_marching", "collocation"), "the kernel changes smoothly and fast at t = x", details={"equation_type": "volterra_fredholm_smooth_mixed", "transition_width": "0.1", "causal_structure": "approximate"}),
        Template("explicit_two_integral", "x*t", None, None, "lambda_val * 0.4D", True, "approx_coef", ("sequential_marching", "block_iteration", "shooting_method"), "the integral is split at x", details={"equation_type": "volterra_fredholm_explicit_split", "split_point": "x", "causal_structure": "explicit"}),
    ),
    "compact_support": (
        Template("band_limited", f"Piecewise((x*t, Abs(x - t) < {BAND}), (0, True))", None, None, "lambda_val * 0.5D", True, "approx_coef", ("sparse_matrix_solvers", "banded_matrix_algorithms", "iterative_krylov_methods"), "the kernel is zero away from t = x", details={"support_type": "band", "support_width": str(BAND), "matrix_structure": "banded", "rank_deficient_risk": "low"}),
        Template("localized_box", "Piecewise((sin(x)*cos(t), (x>={c}) & (x<={d}) & (t>={c}) & (t<={d})), (0, True))", None, None, "lambda_val * 0.3D", True, "approx_coef", ("domain_decomposition", "block_sparse_solvers", "restricted_problem_reduction"), "the kernel is zero outside a box", details={"support_type": "localized_box", "matrix_structure": "block_sparse", "rank_deficient_risk": "moderate"}),
    ),
    "complex_kernels": (
        Template("gaussian_kernel", "exp(-(x**2 + t**2))", "1", "", "0.5D", True, "discrete_points", ("fixed_point_iteration", "quadrature", "Neumann_series"), "the kernel has no elementary integral", details={"numerical_method": "fixed_point_iteration"}),
        Template("exponential_decay", "exp(-abs(x - t))", "x", "", "0.3D", True, "discrete_points", ("quadrature", "collocation", "Nyström"), "the kernel has a kink", details={"numerical_method": "quadrature"}),
        Template("sinc_kernel", "sin(x*t) / (x*t)", "cos(x)", "", "0.2D", True, "discrete_points", ("quadrature", "Neumann_series", "spectral_methods"), "the kernel has no elementary integral", details={"numerical_method": "quadrature"}),
    ),
    "near_resonance": (
        Template("separable_near_eigenvalue", "sin(pi*x) * sin(pi*t)", "sin(pi*x)", "", "2.1D", True, "discrete_points", ("regularization", "iterative_refinement", "preconditioned_gmres", "continuation_methods"), "lambda is near an eigenvalue", details={"near_critical_value": "2.0", "distance_to_resonance": str(DISTANCE)}),
        Template("constant_near_eigenvalue", "1", "1", "", "1.05D", True, "discrete_points", ("regularization", "iterative_methods", "tikhonov_regularization"), "lambda is nearer to an eigenvalue", details={"near_critical_value": "1.0", "distance_to_resonance": str(DISTANCE / 2)}),
        Template("very_near_eigenvalue", "sin(pi*x) * sin(pi*t)", "sin(pi*x) + 0.1*sin(2*pi*x)", "", "2.01D", True, "discrete_points", ("strong_regularization", "continuation_from_away", "preconditioned_iterative"), "lambda is very near to an eigenvalue", details={"near_critical_value": "2.0", "distance_to_resonance": str(DISTANCE / 10)}),
    ),
    "neumann_series": (
        Template("separable_kernel", "sin(x) * cos(t)", None, "{series}", f"lambda_val * {SERIES_SCALE}D", True, "series", ("series_acceleration", "richardson_extrapolation", "pade_approximation"), "four terms for a separable kernel", details={"series_type": "neumann", "series_terms": str(SERIES_TERMS), "kernel_structure": "separable"}),
        Template("polynomial_kernel", "x * t", None, "{series}", f"lambda_val * {SERIES_SCALE}D", True, "series", ("polynomial_acceleration", "recursive_evaluation", "symbolic_simplification"), "four terms for a polynomial kernel", details={"series_type": "neumann", "series_terms": str(SERIES_TERMS), "kernel_structure": "polynomial"}),
        Template("exponential_kernel", "exp(-abs(x - t))", None, "f(x) + {l1}*Integral(exp(-Abs(x - t))*f(t), (t, {a}, {b})) + {l2}*Integral(Integral(exp(-Abs(x - s))*exp(-Abs(s - t))*f(t), (t, {a}, {b})), (s, {a}, {b}))", f"lambda_val * {SERIES_SCALE}D", True, "series", ("numerical_quadrature_per_term", "monte_carlo_integration", "fast_convergence_acceleration"), "terms of a decaying kernel", details={"series_type": "neumann", "series_terms": str(SERIES_TERMS), "kernel_structure": "exponential_decay"}),
    ),
    "ill_posed": (
        Template("simple_first_kind", "x*t", "x**2", "", "0.0D", True, "regularized", ("Tikhonov", "Truncated SVD", "Landweber iteration"), "an equation of the first kind", details={"equation_type": "fredholm_first_kind", "is_ill_posed": "true", "regularization_param": str(ALPHA)}),
        Template("exponential_first_kind", "exp(x*t)", "exp(x)", "", "0.0D", True, "regularized", ("Tikhonov", "Spectral cutoff", "Iterative methods"), "an equation of the first kind with a smooth kernel", details={"equation_type": "fredholm_first_kind", "is_ill_posed": "true", "regularization_param": str(ALPHA)}),
        Template("oscillatory_first_kind", "sin(x - t)", "sin(2*x)", "", "0.0D", True, "regularized", ("Tikhonov with L² penalty", "Total variation regularization", "Wavelet-based methods"), "an equation of the first kind with an oscillating kernel", details={"equation_type": "fredholm_first_kind", "is_ill_posed": "true", "regularization_param": str(ALPHA)}),
    ),
    "resonance": (
        Template("separable_eigenvalue_exact", "sin(pi*x) * sin(pi*t)", "0", "C * sin(pi*x)", "2.001D", True, "family", _RESONANCE, "every multiple of an eigenfunction solves it", details={"is_critical": "true", "solution_multiplicity": "infinite"}),
        Template("constant_kernel_resonance", "1", "0", "C", "1.001D", True, "family", _RESONANCE, "every constant solves it", details={"is_critical": "true", "solution_multiplicity": "infinite"}),
    ),
}
#: Strategies by the type of solution that they make: fixed values.
GROUPS = {
    "none_solution": ("eigenvalue_cases", "range_violation", "divergent_kernel", "disconnected_support"),
    "approx_coef": ("weakly_singular", "boundary_layer", "oscillatory_solution", "mixed_type", "compact_support"),
    "discrete_points": ("complex_kernels", "near_resonance"),
    "series": ("neumann_series",),
    "regularized": ("ill_posed",),
    "family": ("resonance",),
}


def series_text(f: str, lam: float, a: float, b: float, separable: bool) -> str | None:
    """f and three more terms for sin(x) cos(t), or for x t, their integrals by quadrature; null if f can't be read."""
    tree = parse(f)
    if tree is None or symbols(tree) - {"x"}:
        return None

    def over(weight) -> float | None:
        out = _integrals(lambda at, t: weight(t) * on(tree, x=t), np.array([[a]]), np.array([[b]]), 1)
        return None if out is None else float(out[0])

    first = over(np.cos if separable else lambda t: t)
    second = over(lambda t: np.cos(t) * np.sin(t)) if separable else None if first is None else first * (b**3 - a**3) / 3
    return None if first is None or second is None else _series_words(tree, first, second, lam, a, b, separable)


def _series_words(tree, first: float, second: float, lam: float, a: float, b: float, separable: bool) -> str:
    if separable:
        factors = ((lam * first, "sin(x)"), (lam**2 * second, "sin(x)"), (lam**3 * first / 2, "sin(x)*cos(x)"))
    else:
        factors = ((lam * first, "x"), (lam**2 * second, "x"), (lam**3 * second * (b**4 - a**4) / 4, "x"))
    return show(tree) + "".join(f" {'-' if c < 0 else '+'} {abs(c):.15g}*{g}" for c, g in factors)


def _series_of_each(f: _Alike, lam, a, b, separable, rows):
    if f.free() - {"x"}:
        return None
    out: list = [None] * len(rows)
    for kind in (True, False):
        own = np.flatnonzero(separable == kind)
        if not len(own):
            continue
        over = lambda weight: _settled(lambda at, t: weight(t) * f.on(own[at], x=t), a[None, own], b[None, own], own)  # noqa: B023, E731
        first = over(np.cos if kind else lambda t: t)
        second = over(lambda t: np.cos(t) * np.sin(t)) if kind else first * (b[own] ** 3 - a[own] ** 3) / 3
        for k, p, q in zip(own, first.tolist(), second.tolist(), strict=True):
            out[k] = None if np.isnan(p) or np.isnan(q) else _series_words(parse(rows[k][0]), p, q, *rows[k][1:])
    return out


_series = _column(T.StringType(), series_text, by_pattern(_series_of_each, 0))


def six_digits(c: Column) -> Column:
    """A number to six significant digits, without a trailing .0."""
    return F.regexp_replace(F.format_string("%.5e", c).cast("double").cast("string"), r"\.0$", "")


def augmented(equations: DataFrame, *strategies: str) -> DataFrame:
    """Template rows of each equation (a, b, lambda_val doubles; f and u texts); the other columns come along.

    ``strategies`` are names of STRATEGIES or GROUPS. Rows have augmentation_type and
    augmentation_variant, edge_case, reason, recommended_methods and ``details`` (a map). A row whose a, b
    or lambda_val is null gives rows with a null lambda where that depends on it, and none where a
    condition on it can't be decided. Templates that keep the equation's f or u have null where there is no
    such column. An unknown strategy is an error.
    """
    names = [n for s in strategies for n in GROUPS.get(s, (s,))]
    if unknown := set(names) - set(STRATEGIES):
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    own = {c: F.col(c).cast("string") if c in equations.columns else F.lit(None).cast("string") for c in ("f", "u")}
    lam = F.expr(f"lambda_val * {SERIES_SCALE}D")
    words = {k: six_digits(F.expr(v)) if k[0] == "g" else F.expr(v).cast("string") for k, v in NAMES.items()}
    words |= {"l1": lam.cast("string"), "l2": (lam * lam).cast("string")}
    # a UDF can't stand inside a conditional row, so the series texts are columns of their own
    source = equations.withColumns({f"_series_{k}": _series(own["f"], lam, F.expr("a"), F.expr("b"), F.lit(k == "separable")) for k in ("separable", "polynomial")}) if "neumann_series" in names else equations

    def text(template: str | None, name: str, variant: str) -> Column:
        if template is None:
            return own[name]
        if template == "{series}":
            return F.col(f"_series_{variant.removesuffix('_kernel')}")
        return filled(template, words) if "{" in template else F.lit(template)

    rows = [
        F.when(
            F.expr(t.where),
            F.struct(
                *(F.lit(v).alias(k) for k, v in (("augmentation_type", name), ("augmentation_variant", t.variant))),
                text(t.kernel, "kernel", t.variant).alias("kernel"),
                *(text(v, k, t.variant).alias(k) for k, v in (("f", t.f), ("u", t.u))),
                F.expr(t.lam).cast("double").alias("lambda_val"),
                F.lit(t.has_solution).alias("has_solution"),
                F.lit(t.kind).alias("solution_type"),
                F.lit("no_solution" if name == "disconnected_support" else name).alias("edge_case"),
                F.lit(t.reason).alias("reason"),
                F.array(*map(F.lit, t.methods)).alias("recommended_methods"),
                (F.create_map(*(F.lit(x) for kv in t.details.items() for x in kv)) if t.details else F.create_map().cast("map<string, string>")).alias("details"),
            ),
        )
        for name in names
        for t in STRATEGIES[name]
    ]
    made = source.select(*equations.columns, F.explode(F.array_compact(F.array(*rows))).alias("_made"))
    fresh = ("augmentation_type", "augmentation_variant", "kernel", "f", "u", "lambda_val", "has_solution", "solution_type", "edge_case", "reason", "recommended_methods", "details", "augmented")
    kept = [F.col(c) for c in equations.columns if c not in fresh]
    return made.select(*kept, "_made.*", F.lit(True).alias("augmented"))


def per_equation(*strategies: str) -> tuple[int, int]:
    """Rows that a strategy or group makes of an equation, at least and at most."""
    each = [t for s in strategies for n in GROUPS.get(s, (s,)) for t in STRATEGIES[n]]
    return sum(t.where == "true" for t in each), len(each)


def augment_dataset(equations: DataFrame, key: str, strategies: tuple[str, ...] = ("none_solution", "approx_coef", "discrete_points"), multiplier: float = 2.0) -> DataFrame:
    """Originals, marked so, and generated rows up to ``multiplier`` times their number.

    Equations are taken by their unique numeric ``key`` and strategies in their order; a strategy's rows of an equation are
    all taken while there are fewer rows than wanted, so the last may pass the number. How many rows were made before is
    found from counts by range of the key, not in one task.
    """
    from .relational import running, union_all

    total = equations.count()
    wanted = int(total * multiplier) - total
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in equations.columns else F.lit(v)
    originals = equations.withColumns({"augmented": default("augmented", False), "augmentation_type": default("augmentation_type", "original"), "has_solution": default("has_solution", True), "solution_type": default("solution_type", "exact_symbolic")})
    if wanted <= 0:
        return originals
    sizes = [sum((F.coalesce(F.expr(t.where), F.lit(False)).cast("long") for n in GROUPS.get(s, (s,)) for t in STRATEGIES[n]), F.lit(0)) for s in strategies]
    counted = equations.withColumn("_rows", sum(sizes, F.lit(0)).cast("long"))
    placed = running(counted, key, "_rows", "_before").where(F.col("_before") < wanted)
    parts, ahead = [originals], F.col("_before")
    for s, size in zip(strategies, sizes, strict=True):
        chosen = placed.where(ahead < wanted).drop("_rows", "_before")
        parts.append(augmented(chosen, s))
        ahead = ahead + size
    return union_all(*parts)


def evaluation_points(u: str, a: float, b: float, points: int = 50, samples=(-1.0, 1.0, 2.0)) -> dict | None:
    """Places of a uniform grid, its ends, middle and near its ends, and u there; with free constants for each of ``samples`` too.

    Places where a value isn't finite go; None if none is left or u can't be read.
    """
    tree = parse(u)
    if tree is None or not u.strip():
        return None
    x = np.unique(np.concatenate([np.linspace(a, b, points), [a, b, (a + b) / 2, a + 0.1 * (b - a), b - 0.1 * (b - a)]]))
    free = symbols(tree) - {"x", "t"}
    if "t" in symbols(tree):
        return None
    rows = [on(with_constants(tree, c) if free else tree, x=x) for c in (samples if free else samples[:1])]
    good = np.all([np.isfinite(r) for r in rows], axis=0)
    if not good.any():
        return None
    rows = [r[good].tolist() for r in rows]
    one = rows[list(samples).index(1.0) if free and 1.0 in samples else 0]
    return {"x_values": x[good].tolist(), "u_values": one, "u_values_samples": rows if free else None, "constant_samples": list(samples) if free else None, "n_points": int(good.sum())}


POINTS = "x_values array<double>, u_values array<double>, u_values_samples array<array<double>>, constant_samples array<double>, n_points int"


def _points(u, a, b):
    import json

    found = evaluation_points(u, float(a), float(b))
    return None if found is None else json.dumps(found)


_points_text = _column(T.StringType(), _points)


def with_evaluation_points(rows: DataFrame) -> DataFrame:
    """``rows`` with ``evaluation_points`` where they have a solution u that can be evaluated and no points yet; type none has none."""
    made = F.from_json(_points_text(F.nullif(F.col("u").cast("string"), F.lit("")), F.col("a").cast("double"), F.col("b").cast("double")), POINTS)
    skip = F.coalesce(F.col("solution_type") == "none", F.lit(False)) | ~F.coalesce(F.col("has_solution"), F.lit(True))
    fresh = F.when(~skip, made)
    if "evaluation_points" in rows.columns:
        fresh = F.coalesce(F.col("evaluation_points"), fresh)
    return rows.withColumn("evaluation_points", fresh)


def sample_values(kernel: str, f: str, lam: float, a: float, b: float, points: int = SAMPLES, away: float = 0.0) -> dict | None:
    """f plus lam times the integral of K f at places of a uniform grid from a, or from ``away`` if zero lies in the domain."""
    if away and a <= 0 <= b:
        a = away
    trees = parse(kernel), parse(f)
    if None in trees:
        return None
    x = np.linspace(a, b, points)
    inner = _integrals(lambda at, t: on(trees[0], x=x[at], t=t) * on(trees[1], x=t), np.array([np.full(points, a), x]), np.array([x, np.full(points, b)]), points)
    return None if inner is None else {"x_values": x.tolist(), "u_values": (on(trees[1], x=x) + lam * inner).tolist(), "n_points": points}


#: For each kind of solution where it changes fast: (place between the ends, width as a share of the domain, how much denser).
LAYERS = {
    "uniform": (), "fine": (), "graded": ((0.0, 0.2, 4.0),), "left": ((0.0, LAYER, 40.0),), "right": ((1.0, LAYER, 40.0),),
    "double": ((0.0, LAYER, 40.0), (1.0, LAYER, 40.0)), "adaptive": ((0.0, 0.1, 3.0), (1.0, 0.1, 3.0)),
}


def graded_places(a: float, b: float, n: int, layers=()) -> np.ndarray:
    """``n`` places from a to b that share out a density evenly: 1, and around each layer a bell of its strength.

    The bell 1 / (1 + (distance / width)**2) has an arc tangent as its integral, so the places are where the sum of these
    reaches equal steps, found by halving.
    """
    size = b - a

    def mass(x):
        bells = (s * w * (np.arctan((x - p) / w) - np.arctan(-p / w)) for p, w, s in layers)
        return x + sum(bells, np.zeros_like(x))

    wanted = np.linspace(0, 1, n) * mass(np.ones(1))
    low, high = np.zeros(n), np.ones(n)
    for _ in range(50):
        middle = (low + high) / 2
        short = mass(middle) < wanted
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return a + size * np.clip((low + high) / 2, 0, 1)


def mesh(kind: str, a: float, b: float, n: int) -> list[list[float]]:
    """``n`` sample places (x, t) for a kind of equation, graded in x and t by LAYERS and off the diagonal but for fine.

    Each place is an x once and a t once: a lattice whose step is near the golden section of n spreads them over the square.
    """
    if kind not in LAYERS:
        raise ValueError(f"unknown mesh: {kind}")
    if n < 1:
        return []
    x = graded_places(a, b, n, LAYERS[kind])
    step = next(k for k in range(max(1, round(n * 0.618)), n + 1) if np.gcd(k, n) == 1) if n > 1 else 1
    other = (np.arange(n) * step + (1 if kind != "fine" else 0)) % n
    keep = other != np.arange(n) if kind != "fine" else np.ones(n, bool)
    return np.stack([x[keep], x[other[keep]]], 1).tolist()


#: (kind, a, b, n): sample places as ``array<array<double>>``.
mesh_points = _column(T.ArrayType(T.ArrayType(T.DoubleType())), lambda kind, a, b, n: mesh(kind, float(a), float(b), int(n)))


def _sampled(kernel, f, lam, a, b):
    import json

    found = sample_values(kernel, f, float(lam), float(a), float(b), away=0.1 if "/ (x*t)" in kernel else 0.0)
    return None if found is None else json.dumps(found)


def _samples_of_each(kernel: _Alike, f: _Alike, lam, a, b, rows):
    import json

    if kernel.free() - {"x", "t"} or f.free() - {"x"}:
        return None
    start = np.where([("/ (x*t)" in row[0]) & (row[3] <= 0 <= row[4]) for row in rows], 0.1, a)
    x = np.linspace(start, b, SAMPLES, axis=1)
    inner = kernel_integrals(kernel, f, start, b, x, [(*row[:2], *row[3:]) for row in rows])
    u = f.on(np.arange(len(rows))[:, None], x=x) + lam[:, None] * inner
    lost = np.isnan(inner).any(axis=1)
    return [None if none else json.dumps({"x_values": p, "u_values": q, "n_points": SAMPLES}) for p, q, none in zip(x.tolist(), u.tolist(), lost, strict=True)]


_samples_text = _column(T.StringType(), _sampled, by_pattern(_samples_of_each, 0, 1, most=1024))


def with_sample_points(rows: DataFrame) -> DataFrame:
    """``rows`` of generated equations with ``evaluation_points`` where their solution is a list of points: f plus lambda times the integral of K f at SAMPLES places.

    Rows of other types keep the points that they have, or have none. A kernel or f that can't be read, or an integral that doesn't settle, gives null.
    """
    made = F.from_json(_samples_text("kernel", "f", *(F.col(c).cast("double") for c in ("lambda_val", "a", "b"))), POINTS)
    own = F.col("evaluation_points") if "evaluation_points" in rows.columns else F.lit(None).cast(f"struct<{POINTS.replace(' array', ': array').replace(' int', ': int')}>")
    return rows.withColumn("evaluation_points", F.when(F.col("solution_type") == "discrete_points", F.coalesce(own, made)).otherwise(own))


def applied(text: Column, f: Column, name: str = "f") -> Column:
    """A generated text with an expression in x for a function it only names, as in f(x) + Integral(K*f(t), (t, a, b)); null if either can't be read."""
    return _applied(text, f, F.lit(name))


def _apply(text, f, name):
    tree = parse(f)
    if tree is None or "Integral" in f:
        return None
    out = re.sub(rf"\b{name}\(([A-Za-z])\)", lambda m: f"({show(renamed(tree, 'x', m[1]))})", text)
    return show(parse(out)) if parse(out) is not None else None


_applied = _column(T.StringType(), _apply)
