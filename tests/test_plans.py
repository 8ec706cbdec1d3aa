"""The scoring job, several methods for an equation, scripts, splits and generated sets on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from eqlake.functions import expressions as X
from eqlake.functions import notation, prompts, terms, text
from eqlake.operators import calls, generators
from eqlake.operators import relational as R
from eqlake.plans import scoring, solvers

PREDICTIONS = "equation_id string, solution_str string, ground_truth string, has_solution boolean, ground_truth_has_solution boolean, solution_type string, ground_truth_solution_type string"


def test_none_detection(spark):
    rows = [("a", None, None, False, False, None, "none"), ("b", "x", None, True, False, None, "none"), ("c", None, None, None, False, None, "none"), ("d", "x", "x", False, True, None, "exact_symbolic"), ("e", "x", "x", True, True, None, None)]
    r = {x.solution_kind: x for x in scoring.report(scoring.scored(spark.createDataFrame(rows, PREDICTIONS))).collect()}
    assert (r["all"].none_tp, r["all"].none_fn, r["all"].none_fp) == (1, 2, 1)
    assert (r["all"].none_precision, r["all"].none_recall) == (0.5, pytest.approx(1 / 3)) and r["all"].none_f1 == pytest.approx(0.4)
    assert r["unknown"].accuracy == 1.0 and r["none"].correct == 1 and r["none"].total == 3
    assert r["all"].has_solution_total == 4 and r["all"].has_solution_accuracy == 0.5


def test_scores_by_type(spark):
    rows = [
        ("sym", "sin(x)**2 + cos(x)**2", "1", True, True, "exact_symbolic", "exact_symbolic"),
        ("abs", "abs(x)", "x", True, True, "exact_symbolic", "exact_symbolic"),
        ("fam", "c_1*sin(x)", "C*sin(x)", True, True, "family", "family"),
        ("reg", None, None, None, True, "regularized", "regularized"),
        ("bad", "x +", "x", True, True, "series", "series"),
        ("gone", None, "x", None, True, None, "series"),
        ("huge", "1e999", "x", True, True, "series", "series"),
        ("deep", "+".join(["x"] * 3000), "3000*x", True, True, "series", "series"),
    ]
    out = {r.equation_id: r for r in scoring.scored(spark.createDataFrame(rows, PREDICTIONS)).collect()}
    assert out["sym"].correct and out["sym"].symbolic_match and out["reg"].correct and out["fam"].correct and out["fam"].family.naming_valid
    # they agree on [0, 1], so the numeric match stands, but not as expressions
    assert out["abs"].numeric_match and not out["abs"].symbolic_match
    assert out["bad"].correct is None and out["bad"].unreadable and out["gone"].correct is None and not out["gone"].unreadable
    assert out["deep"].correct in (True, None)


def test_stored_points_and_tolerances(spark):
    df = spark.createDataFrame([("a", "x", "odd(", True, True, "approx_coef", "approx_coef")], PREDICTIONS)
    stored = F.struct(F.array(F.lit(0.0), F.lit(1.0)).alias("x_values"), F.array(F.lit(0.0), F.lit(1.004)).alias("u_values"), F.lit(None).cast("array<array<double>>").alias("u_values_samples"), F.lit(None).cast("array<double>").alias("constant_samples"))
    df = df.withColumn("ground_truth", F.lit("2*x")).withColumn("evaluation_points", stored)
    assert scoring.scored(df).first().max_error == pytest.approx(0.004) and not scoring.scored(df).first().correct
    assert scoring.scored(df, type_tolerances={"approx_coef": 0.01}).first().correct
    failed = df.withColumn("api_error", F.lit(True))
    r = scoring.scored(failed).first()
    assert r.correct is None and not r.evaluated and not r.unreadable


def test_residuals_at_kinks_and_waves():
    # u = 1 with K = |x - t| and log|x - t| on [0, 1]
    assert X.residual("1", "abs(x - t)", "1 - 0.5*(x**2 - x + 0.5)", 0.5, 0.0, 1.0) < 1e-9
    f = "1 - 0.5*(x*log(x) + (1 - x)*log(1 - x) - 1)"
    assert X.residual("1", "log(abs(x - t))", f, 0.5, 0.0, 1.0) < 1e-6
    inner = X._integrals(lambda at, t: t * __import__("numpy").sin(100 * math.pi * t), __import__("numpy").array([[0.0]]), __import__("numpy").array([[1.0]]), 1)
    assert float(inner[0]) == pytest.approx(-1 / (100 * math.pi), abs=1e-9)


def test_odd_expressions(spark):
    e = spark.createDataFrame([("1e999",), ("+".join(["x"] * 3000),), ("x",)], "t string")
    got = e.select(X.convert("t", F.lit("infix"), F.lit("rpn")).alias("c"), X.value_at("t", F.lit(2.0)).alias("v")).collect()
    assert got[0].c is None and got[2].c == "x" and got[2].v == 2.0
    assert X.separate("(1 + x*t + x + t)**6*(1 + x*t + x + t)**6") is None
    p = X.parse("Piecewise((1, (x>=0) & (x<=0.2)), (x*t, Abs(x - t) < 0.1), (0, True))")
    assert [float(X.value(p, {"x": a, "t": b})) for a, b in ((0.1, 9.0), (0.5, 0.45), (0.5, 0.9))] == [1.0, 0.225, 0.0]
    assert X.parse(X.show(p)) == p and math.isnan(float(X.value(X.parse("Piecewise((1, x < 0))"), {"x": 1.0})))


def test_nearest_keeps_rows(spark):
    left = spark.createDataFrame([(1, 0.05), (1, 0.52), (1, 0.52), (2, 0.3), (1, None)], "k int, x double")
    right = spark.createDataFrame([(1, 0.19, 1.0), (1, 0.5, 2.0)], "k int, x double, y double")
    got = sorted(((r.k, r.x, r.nearest_y) for r in R.nearest(left, right, "k", "x", "y", 0.1).collect()), key=repr)
    assert got == sorted([(1, 0.05, None), (1, 0.52, 2.0), (1, 0.52, 2.0), (2, 0.3, None), (1, None, None)], key=repr)


def test_splits(spark):
    rows = spark.range(100).select("id", F.lit(False).alias("augmented"), F.lit("exact_symbolic").alias("solution_type"), F.lit("").alias("edge_case"))
    sizes = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes(R.split_dataset(rows, "id", 0.8, 0.1)) == {"train": 80, "val": 10, "test": 10}
    assert sizes(R.split_dataset(rows, "id", 1.0, 0.0)) == {"train": 100}
    assert sizes(R.split_dataset(rows, "id", 0.9, 0.6)) == {"train": 54, "val": 36, "test": 10}
    odd = rows.withColumn("edge_case", F.when(F.col("id") == 3, "alone").otherwise("none"))
    assert sizes(R.split_dataset(odd, "id", 0.8, 0.1)) == {"train": 80, "val": 10, "test": 10}
    assert R.split_dataset(rows.where("false"), "id").count() == 0
    hot = spark.range(1000).select("id", F.when(F.col("id") < 990, None).otherwise("b").alias("s"))
    placed = R.places(hot, "s", "id").collect()
    assert sorted(r._rank for r in placed if r.s is None) == list(range(1, 991)) and {r._size for r in placed if r.s == "b"} == {10}
    sums = {r.id: r.before for r in R.running(spark.range(500).withColumn("n", F.col("id") % 3), "id", "n", "before", 16).collect()}
    assert all(sums[k] == sum(i % 3 for i in range(k)) for k in range(500))


def test_generated_sets(spark):
    e = spark.createDataFrame([(k, "x**2", "x", 0.0, 1.0, 0.5) for k in range(10)], "id int, u string, f string, a double, b double, lambda_val double")
    kept = generators.augment_dataset(e, "id", ("family",), 1.35)
    # rows of an equation come whole: two, then two more, as three are wanted
    assert kept.where("augmented").count() == 4 and {r.id for r in kept.where("augmented").collect()} == {0, 1}
    assert {r.augmentation_type for r in kept.where("not augmented").collect()} == {"original"}
    assert generators.augment_dataset(e, "id", multiplier=1.0).count() == 10
    points = {r.augmentation_variant: r.evaluation_points for r in generators.with_evaluation_points(generators.augmented(e.where("id = 0"), *generators.GROUPS)).collect()}
    assert points["constant_kernel_resonance"].constant_samples == [-1.0, 1.0, 2.0] and points["constant_kernel_resonance"].u_values == [1.0] * 53
    assert points["cauchy_singularity"] is None and points["left_exponential_layer"].u_values[0] == 1.0
    made = generators.augmented(e.where("id = 0"), "disconnected_support", "neumann_series").collect()
    assert all(X.parse(r.kernel) is not None and r.recommended_methods and r.reason for r in made)
    poly = next(r for r in made if r.augmentation_variant == "polynomial_kernel")
    # f + l x I, l^2 x I / 3, l^3 x I / 12 with l = 0.15 and I = 1/3
    at_one = 1 + 0.15 / 3 + 0.15**2 / 9 + 0.15**3 / 36
    assert X._at(poly.u, 1.0) == pytest.approx(at_one, abs=1e-12)
    gauss = generators.sample_values("exp(-(x**2 + t**2))", "1", 0.5, 0.0, 1.0)
    assert gauss["u_values"][0] == pytest.approx(1 + 0.5 * 0.746824132812427, abs=1e-9) and len(gauss["x_values"]) == 10
    for kind in ("uniform", "graded", "left", "right", "double", "fine", "adaptive"):
        pairs = generators.mesh(kind, 0.0, 1.0, 20)
        assert 0 < len(pairs) <= 20 and all(-1e-6 <= v <= 1.0 + 1e-6 for p in pairs for v in p)
        assert kind == "fine" or all(x != t for x, t in pairs)
    left = generators.graded_places(0.0, 1.0, 101, generators.LAYERS["left"])
    assert (left < 0.05).sum() > 35 and left[0] == pytest.approx(0) and left[-1] == pytest.approx(1) and (left[1:] > left[:-1]).all()
    assert generators.graded_places(2.0, 4.0, 5).tolist() == pytest.approx([2, 2.5, 3, 3.5, 4])
    with pytest.raises(ValueError):
        generators.mesh("odd", 0, 1, 5)


def test_notation(spark):
    cases = {"x 2 ^ x sin +": "rpn", "x t * exp": "rpn", "\\frac{x}{2}": "latex", "x**2 + sin(x)": "infix", "exp(-x)*cos(t)": "infix", "": "infix", "x^{2}": "latex"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", notation.notation(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
    files = spark.createDataFrame([("a", "infix"), ("b", "rpn")], "name string, notation string")
    with pytest.raises(Exception, match="differ"):
        notation.one_notation(files).collect()
    assert notation.one_notation(files.where("name = 'a'")).first().notation == "infix"
    one = spark.range(1)
    say = lambda *c: tuple(one.select(*c).first())
    L = F.lit
    assert say(notation.taylor_text(L("exp(x)"), L(0.0), L(4)), notation.taylor_polynomial(L("1/(1 - x)"), L(0.0), L(3)), notation.taylor_text(L("log(x)"), L(1.0), L(3))) == (
        "1 + x + 0.5*x**2 + 0.166666666667*x**3 + O(x**4)", "1 + x + x**2", "(x - 1) - 0.5*(x - 1)**2 + O((x - 1)**3)")
    assert say(notation.infix(L("\\frac{\\sin(x)}{2}")), notation.infix(L("solution")), notation.infix(L("a b c d"))) == ("sin(x)/2", "solution", None)
    assert say(F.element_at(notation.neumann_terms(L("x*t"), L("x"), 3), 3), notation.truncated_text(L("x"), 3)) == ("Term 2: λ^2 * ∫ K_1*x*t * f(t) dt", "u(x) ≈ x + λ^1 * K^1(f) + λ^2 * K^2(f)")
    assert say(text.rounded_numbers(L("0.123456*x + 2 - 12345.678")), text.solution_class(L(" EXP(x)")), text.solution_class(L("bessel(x)"))) == ("0.1235*x + 2 - 12350", "Exponential", "Special Function")
    rows = notation.converted(spark.createDataFrame([("x**2", "x"), ("x +", "x")], "u string, f string"), "rpn").collect()
    assert [(r.u_rpn, r.f_rpn) for r in rows] == [("x 2 ^", "x")]


def test_prompt_templates(spark):
    L = F.lit
    one = spark.range(1).select(prompts.token_prompt(prompts.SPECIAL, L("0.123456*x"), L("x"), L(0.5), L(0), L(1)), prompts.script_block(L("x*t"), L("x"), L(0.0), L(0), L(1))).first()
    assert one[0] == "<|fred|> <|kernel|> 0.1235*x <|lambda|> 0.5 <|rhs|> x <|domain|> 0 1 <|solve|>"
    assert "alone" in one[1] and "return x*t" in one[1] and "lower, upper, scale = 0, 1, 0.0" in one[1]
    rows = spark.createDataFrame([(k, "a", "w " * (k % 4), "v") for k in range(20)], "id int, kind string, p string, r string")
    assert sorted(r.id for r in prompts.fitting(rows, "p", "r", "kind", "id", 5, 3).collect()) == [0, 1, 2, 4, 5]


def test_validation(spark):
    e = spark.createDataFrame([(1, "x*t", "x", "0.5", 0.0, 1.0, "x"), (2, "x*(", "x", "0.5", 0.0, 1.0, "x"), (3, "x*t", "x", "odd", 1.0, 0.0, "x")], "id int, kernel string, f string, lambda_val string, a double, b double, solution string")
    rows = terms.checked(e, {"long": F.when(F.col("id") == 1, "too long"), "warn_odd": F.lit("odd")})
    assert [r.valid for r in rows.orderBy("id").collect()] == [False, False, False] and "odd" in rows.first().warnings
    r = terms.validation_report(terms.checked(e), "id").first()
    assert (r.total, r.valid, r.invalid, [x.key for x in r.first_errors]) == (3, 1, 2, [2, 3])


def fake():
    def call(prompt):
        if "Decompose" in prompt:
            raise OSError("down")
        if "Find the mistake" in prompt:
            return "SOLUTION: u(x) = 3*x/2\nHAS_SOLUTION: yes\nSOLUTION_TYPE: exact_symbolic"
        return "SOLUTION: u(x) = \\frac{x}{2}\nHAS_SOLUTION: yes\nSOLUTION_TYPE: exact_symbolic"

    return call


def test_methods(spark, tmp_path):
    p = spark.createDataFrame([("e1", "Solve.", "x*t", "x", 1.0, 0.0, 1.0), ("e2", "Solve.", "x*t", "x", 0.0, 0.0, 1.0)], "equation_id string, prompt string, kernel string, f string, lambda_val double, a double, b double")
    first = solvers.verified(solvers.candidates(p, fake, wait=0.0, attempts=1))
    status = {(r.equation_id, r.method): r.status for r in first.collect()}
    assert len(status) == 10 and status[("e1", "neumann")] == "failed" and status[("e1", "adomian")] == status[("e2", "neumann")] == "unverifiable"
    out = {r.equation_id: r for r in solvers.solved(p, fake, f"{tmp_path}/run", wait=0.0, attempts=1).collect()}
    assert (out["e1"].selection_reason, out["e1"].method, out["e1"].round) == ("verified", "degenerate_kernel", 1)
    # of the first kind, so nothing can be verified, but four methods agree
    assert (out["e2"].selection_reason, out["e2"].method) == ("majority_vote", "degenerate_kernel")
    assert {r.method for r in solvers.wins(spark.createDataFrame([("m", "verified")], "method string, selection_reason string")).collect()} == {"m"}
    # the rounds stand, so no call is made again

    def never():
        raise AssertionError("called")

    assert solvers.solved(p, never, f"{tmp_path}/run").count() == 2


def test_scripts(spark):
    good = "x\n```python\nprint('SOLUTION: u(x) = x')\n```"
    rows = spark.createDataFrame([(1, "p", good), (2, "p", "```py\n1/0\n```"), (3, "p", "no block"), (4, "p", "```\nprint(1)\n```")], "id int, prompt string, response string")
    with pytest.raises(PermissionError):
        solvers.scripted(rows)
    out = {r.id: (r.outcome, r.text) for r in solvers.scripted(rows, lambda: lambda p: good, timeout=20, allow=True).collect()}
    assert out[1] == out[2] == out[4] == ("exec_ok", "SOLUTION: u(x) = x\n") and out[3] == ("no_code", "no block")
    assert solvers.scripted(rows.where("id = 2"), timeout=20, allow=True).first().outcome == "fallback_raw"


def test_costs(spark):
    c = spark.createDataFrame([(100, 50, 300, 400, 1.0), (0, 0, 0, 0, 1.0), (1, 0, 1, 2, None)], "prompt_tokens int, cached_tokens int, completion_tokens int, total_tokens int, cost double")
    got = [[float(v) for v in r] for r in calls.billed(c).select("prompt_cost_usd", "completion_cost_usd", "cached_cost_usd", "total_cost_usd").collect()]
    assert got == [[0.25, 0.75, 0.125, 1.0], [0, 0, 0, 1.0], [0, 0, 0, 0]]
    m = spark.createDataFrame([("a", 1.0, 2.0, 1000, 500), ("b", 0.0, 4.0, 10, 250)], "model string, input double, output double, prompt_tokens int, completion_tokens int")
    assert {r.model: r.cost for r in calls.panel_cost(m, 1000).collect()} == {"a": pytest.approx(2.0), "b": pytest.approx(1.0), None: pytest.approx(3.0)}


def test_calls_run_at_once_and_in_order(spark):
    import time

    def client():
        def call(prompt):
            time.sleep(0.5)
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return call

    df = spark.createDataFrame([(k, f"p{k}" if k != 3 else "bad") for k in range(16)] + [(16, None)], "id int, prompt string").coalesce(1)
    calls.responses(df.limit(1), client, 1).collect()
    began = time.time()
    rows = calls.responses(df, client, attempts=1, parallel=8).collect()
    took = time.time() - began
    assert {r.id: r.response for r in rows} == {k: "" if k in (3, 16) else f"P{k}" for k in range(17)} and took < 5
    assert {r.id: r.error for r in rows if r.error} == {3: "ValueError: no", 16: "no prompt"}


def test_settings_are_read(spark):
    from eqlake.sources import readers

    df = spark.createDataFrame([("x + 0.005", "x", "series"), ("x + 0.005", "x", "exact_symbolic")], "solution_str string, ground_truth string, ground_truth_solution_type string")
    rows, _, _ = scoring.evaluate(df, settings=readers.settings())
    assert [r.correct for r in rows.collect()] == [True, False]
