"""Work that grows with rows: rows of one pattern at once, tasks for all cores, no pairs of near rows, parts of an answer computed once."""

import json

import pytest
from pyspark.sql import functions as F

from eqlake import catalog, catalog_jobs, catalog_symbolic  # noqa: F401
from eqlake.functions import canonical, responses
from eqlake.functions import expressions as X
from eqlake.operators import generators as G
from eqlake.operators import relational as R

SPREAD = (
    "discrete_rows integral_values latex_readings residual_check varied_equations strategy_texts series_arithmetic separable_solutions "
    "grid_max_error augment_strategies canonical_texts notation_convert response_answers parse_responses score_report evaluation_points symbolic_pairs"
).split()


@pytest.mark.parametrize("name", SPREAD)
def test_rows_are_dealt_over_all_cores(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 32, true" in plan


def alone(f):
    def run(row):
        try:
            return f(*row)
        except X.TROUBLE:
            return None

    return run


TEXTS = ("{k}*x", "{k}*x + sin({k}*x)/3", "Integral({k}*t*x, (t, 0, x))", "{k}*x + (", "", "y*{k}", "1/(x - {k})", "Piecewise((x*{k}, x < 1), (1, True))", "sqrt(-{k}*x)", "Integral(1/(t - 1), (t, 0, {k}))", ".", "1e999*{k}")


def test_values_of_one_pattern_are_those_of_each_row():
    rows = [(TEXTS[k % len(TEXTS)].replace("{k}", str(k)), k / 7) for k in range(48)]
    want, have = [alone(X._at)(r) for r in rows], X.by_pattern(X._at_each, 0)(rows, alone(X._at))
    assert [v is None for v in have] == [v is None for v in want]
    assert [v for v in have if v is not None] == pytest.approx([v for v in want if v is not None], rel=1e-12, nan_ok=True)


def test_an_integral_that_does_not_settle_spoils_its_own_row_alone():
    rows = [(f"{n}*x", "1/(x - t)" if n == 2 else "x*t", f"{n}*x", 0.3, 0.0, 1.0) for n in range(1, 5)]
    rows += [(f"{n}*x + 1/(x + {n})", "x*t", "x", 0.3, 0.0, 1.0) for n in (1, 0, 2)]
    have = X.by_pattern(X._residual_of_each, 0, 1, 2)(rows, alone(X.residual))
    want = [X.residual(*r) for r in rows]
    assert [v is None for v in have] == [v is None for v in want] and None in want
    assert [v for v in have if v is not None] == pytest.approx([v for v in want if v is not None], rel=1e-9)


@pytest.mark.parametrize("kernel", ["x*t", "1", "exp(x - t)", "sin(x*t)", "x*("])
def test_solutions_of_one_kernel_are_those_of_each_row(kernel):
    rows = [(kernel, f"{n}*x + 1", lam, 0.0, 1.0) for n in range(4) for lam in (0.0, 0.25, 1.0)]
    assert X.solved_together(rows, alone(X.solve)) == [X.solve(*r) for r in rows]


def test_points_and_series_of_one_pattern_are_those_of_each_row():
    rows = [(("exp(-abs(x - t))", "sin(x*t) / (x*t)")[n % 2], f"{n}*x", 0.3, -1.0 if n % 3 else 0.0, 1.0 + n / 10) for n in range(12)]
    assert [X.np.array(json.loads(v)["u_values"]) for v in X.by_pattern(G._samples_of_each, 0, 1)(rows, alone(G._sampled))] == [pytest.approx(json.loads(G._sampled(*r))["u_values"], rel=1e-11) for r in rows]
    rows = [(f"{n}*x + 1", 0.25, 0.0, 1.0, n % 2 == 0) for n in range(8)] + [("x + (", 0.25, 0.0, 1.0, True)] * 2
    assert X.by_pattern(G._series_of_each, 0)(rows, alone(G.series_text)) == [alone(G.series_text)(r) for r in rows]


def test_conversion_by_pattern():
    texts = ["2x + 3.5t", "1e-5*x", "-x**2*(t - 10)", "3 + (", "", ".", "1e999*x", "Piecewise((1, x < 2), (2, True))", "2**3**x"]
    rows = [(t, "infix", n) for t in texts for n in ("rpn", "latex", "python", "tokenized", "infix")]
    assert X._converted_together(rows, alone(X._convert)) == [alone(X._convert)(r) for r in rows]


def test_routed_equations_are_solved_together():
    from eqlake.plans import routing

    rows = [(k, f"{n}" + r" \cdot x", n / 10, 0.0, 1.0) for n in range(6) for k in (r"x \cdot t", r"\sin(x t)", r"\unknown{x}", "1")]
    assert routing._solve_together(rows, alone(routing._solve)) == [routing._solve(*r) for r in rows]


def test_quadrature_takes_rows_of_one_pattern_together(monkeypatch):
    calls = []
    monkeypatch.setattr(X, "_settled", lambda *a, f=X._settled: calls.append(len(a[3])) or f(*a))
    X.solved_together([("x*t", f"{n}*x", 0.25, 0.0, 1.0) for n in range(100)], alone(X.solve))
    assert calls == [100, 100]


def test_coefficients_that_differ_little_are_unequal():
    assert canonical.compare("1200002e-12*x", "1200002.5e-12*x") == canonical.UNEQUAL
    assert canonical.compare("7200013*x", "7200013*x + 1e-9") == canonical.UNDECIDED
    assert canonical.compare("0.3333333*x", "x/3") == canonical.UNDECIDED
    assert canonical.compare("0.33333333333333*x", "x/3") == canonical.EQUAL


def test_nearest_is_the_brute_force_one(spark):
    left = spark.range(400).selectExpr("id", "id % 3 k", "if(id % 19 = 0, null, pmod(hash(id), 1000) / 10D) x").union(spark.sql("SELECT 400L, null, 5D")).union(spark.sql("SELECT 401L, 1, double('nan')"))
    right = spark.range(300).selectExpr("id % 3 k", "if(id % 23 = 0, null, pmod(hash(id, 1), 1000) / 10D) x", "id * 1D y")
    have = {r["id"]: r["nearest_y"] for r in R.nearest(left, right, "k", "x", "y", 1.5).collect()}
    points = right.collect()
    for r in left.collect():
        near = [(abs(p["x"] - r["x"]), p["x"], p["y"]) for p in points if p["k"] == r["k"] and p["x"] is not None and r["x"] is not None and abs(p["x"] - r["x"]) < 1.5]
        assert have.pop(r["id"]) == (min(near)[2] if near else None)
    assert not have


def test_nearest_makes_no_pairs(spark):
    left = spark.range(60_000).selectExpr("id", "0 k", "id / 60000D x")
    right = spark.range(60_000).selectExpr("0 k", "(id + 0.25D) / 60000D x", "id * 1D y")
    out = R.nearest(left, right, "k", "x", "y", 2.0)
    assert out.where("nearest_y = id").count() == 60_000


def test_an_answer_names_each_part_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("r")).select(responses.answer(F.col("r")).alias("a")).select("a.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SOLUTION[_\\s]TYPE") <= 1


def test_ranges_of_running_sums(spark):
    rows = spark.range(5_000).selectExpr("id * 3 id", "id % 5 n")
    out = {r["id"]: r["s"] for r in R.running(rows, "id", "n", "s", ranges=100).collect()}
    total = 0
    for k in range(5_000):
        assert out[k * 3] == total
        total += k % 5


def test_null_lists_are_not_sent_to_python(spark, sf_dir):
    plan = catalog.QUERIES["score_report"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert "ArrowEvalPython" in plan.toJSON() and "u_values_samples" not in plan.toJSON()


def test_stored_points_arrive_as_given(spark):
    from eqlake.plans import scoring

    rows = [(None,), (([0.0, 1.0], None, [], None),), (([], [None, 2.0], [[1.0], []], [0.5]),)]
    out = spark.createDataFrame(rows, f"v {scoring.STORED}").select(scoring.sent_lists(F.col("v")).alias("s"))
    assert out.where("s is null or s.x_values is null or s.u_values is null or s.u_values_samples is null or s.constant_samples is null").count() == 0
    have = [scoring._received(r) for r in out.toArrow()["s"].to_pylist()]
    assert have[0] is None and have[1] == {"x_values": [0.0, 1.0], "u_values": None, "u_values_samples": [], "constant_samples": None}
    assert have[2]["u_values"][0] != have[2]["u_values"][0] and have[2]["u_values_samples"] == [[1.0], []] and have[2]["constant_samples"] == [0.5]


def test_rows_that_repeat_are_not_looked_at_one_by_one(monkeypatch):
    import pyarrow as pa

    from eqlake.plans import scoring

    seen = []
    monkeypatch.setattr(scoring, "_received", lambda v, f=scoring._received: seen.append(v) or f(v))
    monkeypatch.setattr(scoring, "_known", {})
    lists = {"none": False, "nulls": [False, False, True, True], "x_values": [0.0, 1.0], "u_values": [0.0, 2.0], "u_values_samples": [], "constant_samples": []}
    base = {"kind": "exact_symbolic", "pred": "2*x", "truth": "x*2", "a": 0.0, "b": 1.0, "kernel": None, "f": None, "lam": None, "stored": None, "tolerance": 1e-6}
    # rows alike in all but one column, null and NaN among them
    odd = [{}, {"pred": "3*x"}, {"pred": None}, {"truth": "3*x"}, {"kind": None}, {"b": 2.0}, {"lam": float("nan")}, {"tolerance": 2.0}, {"pred": "x + ("}, {"stored": lists}, {"stored": lists | {"u_values": [0.0, 3.0]}}]
    rows = [base | {"stored": {"none": True, "nulls": [], "x_values": [], "u_values": [], "u_values_samples": [], "constant_samples": []}} | odd[k * k % 13 % len(odd)] for k in range(5_000)]
    numbers = pa.list_(pa.float64())
    stored = pa.struct({"none": pa.bool_(), "nulls": pa.list_(pa.bool_()), "x_values": numbers, "u_values": numbers, "u_values_samples": pa.list_(numbers), "constant_samples": numbers})
    given = pa.array(rows, pa.struct({c: stored if c == "stored" else pa.float64() if c in ("a", "b", "lam", "tolerance") else pa.string() for c in base}))
    form = pa.struct({"readable": pa.bool_(), "symbolic": pa.bool_(), "status": pa.string(), "numeric": pa.struct({"max_error": pa.float64(), "match": pa.bool_()})})
    have = scoring._scores(given, 100, form)
    assert len(seen) <= len(odd)
    assert have == pa.concat_arrays([scoring._scores(given[k : k + 1], 100, form) for k in range(len(rows))])


def test_points_are_matched_once_for_all_that_is_told_of_them(spark):
    from eqlake.functions.terms import point_scores

    plan = spark.sql("SELECT array(struct(0D x, 1D y)) p, array(struct(id * 1D x, 1D y)) q FROM range(1)").select(point_scores(F.col("p"), F.col("q")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 1
