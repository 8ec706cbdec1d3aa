"""Canonical forms, LaTeX read twice, integrals, routing with a table of solutions, and workers that don't have the package."""

import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from hypothesis import given, settings

from eqlake.functions import canonical as C
from eqlake.functions import expressions as X
from eqlake.functions import latex as L
from eqlake.plans import routing, scoring

from .test_expressions import TREES


@settings(deadline=None, max_examples=150)
@given(TREES)
def test_canonical_form_keeps_values(tree):
    form = C.canonical_tree(tree)
    if form is None:
        return
    again = C.canonical_tree(form)
    assert again is None or X.show(again) == X.show(form)
    at = {"x": np.array([0.3, 0.9, 1.3]), "t": np.array([0.7, 0.2, 1.1])}
    p, q = X.on(tree, **at), X.on(form, **at)
    both = np.isfinite(p) & np.isfinite(q)
    assert np.allclose(p[both], q[both], rtol=1e-5, atol=1e-5 * max(1.0, np.abs(p[both]).max(initial=0)))


@pytest.mark.parametrize(
    ("one", "other", "state"),
    [
        ("1e-8*x", "2e-8*x", "unequal"), ("1e-8*x", "0", "unequal"), ("Piecewise((x, x < 2), (0, True))", "x", "unequal"), ("log(x)", "log(abs(x))", "unequal"),
        ("Piecewise((x, x < 500), (0, True))", "x", "unequal"), ("tan(x)", "sin(x)/cos(x)", "equal"), ("cosh(x)**2 - sinh(x)**2", "1", "equal"), ("sqrt(2)/2", "cos(pi/4)", "equal"),
        ("sin(pi/6)", "1/2", "equal"), ("log(x**2)", "2*log(abs(x))", "equal"), ("0.333333333333333*x", "x/3", "equal"), ("0.3333333*x", "x/3", "undecided"), ("x", "x + 1e-12", "undecided"),
        ("(x + t)**50", "(t + x)**50", "too_complex"), ("x + (", "x", "unreadable"), ("2**x", "exp(x*log(2))", "equal"), ("1/(x - 1) - 1/(x + 1)", "2/(x**2 - 1)", "equal"),
        ("sqrt(x**2)", "x", "unequal"), ("Integral(t*exp(x*t), (t, 0, 1))", "exp(x)/x - (exp(x) - 1)/x**2", "equal"), ("Integral(f, (f, 0, x))", "x**2/2", "equal"),
        ("Integral(log(s + 1), (s, 0, 1))", "Integral(log(t + 1), (t, 0, 1))", "equal"), ("exp(-Abs(x - t))", "exp(-Abs(t - x))", "equal"),
    ],
)
def test_comparison(one, other, state):
    assert C.compare(one, other) == state == C.compare(other, one)


def test_canonical_and_simplified_texts():
    assert [C.canonical(e) for e in ("x + x", "(x**2 - 1)/(x - 1)", "sin(x)**2", "exp(x)*exp(-x)", "x + (", "x/0")] == ["2*x", "x + 1", "1/2 - cos(2*x)/2", "1", None, None]
    assert C.canonical("1/(1 + exp(-x))") == C.canonical("exp(x)/(1 + exp(x))") and C.canonical("t + x") == C.canonical("x + t")
    assert C.simplified("sin(x)**2") == "sin(x)**2" and C.simplified("x*1 + 0") == "x" and C.canonical("x 2 ^ x x * +", "rpn") == "2 x 2 ^ *"


def test_latex_that_is_not_known_has_no_reading():
    for text in (r"\unknown{x}", r"\text{no solution}", "u(t)", r"\frac{d}{dx} x", r"\int x", "x +", r"\sum_{n} x", r"x \pm 1", r"\begin{matrix} x \end{matrix}", r"\left. x \right|"):
        assert L.read(text) is None, text
    want = {
        r"\dfrac{x}{2}": "x/2", r"\operatorname{sinh}(x)": "sinh(x)", r"\mathrm{e}^{x}": "exp(x)", "x_{1}+2": "x_1 + 2", r"\frac12": "1/2", r"\sqrt[3]{x}": "x**(1/3)",
        r"\int_0^1 x t \, dt": "Integral(x*t, (t, 0, 1))", r"\sin^2 x": "sin(x)**2", r"\sin 2x \cos t": "sin(2*x)*cos(t)", r"\log_{2} x": "log(x)/log(2)",
        r"\left|-\left|t\right|\right|": "Abs(-Abs(t))", r"\sin^{-1} x": "asin(x)",
    }
    assert {k: X.show(L.read(k)) for k in want} == want
    assert [X.parse(e) and X.show(X.parse(e)) for e in ("sin x", "2 sin x cos t", "sin")] == ["sin(x)", "2*sin(x)*cos(t)", None]


@settings(deadline=None, max_examples=150)
@given(TREES)
def test_both_readings_agree_on_what_is_printed(tree):
    assert L.state(X.show(tree, "latex")) == L.AGREED


def test_integrals_in_every_notation_and_nested():
    tree = X.parse("Integral(Integral(x*s*t, (s, 0, t)), (t, 0, 1))")
    assert float(X.value(tree, {"x": 0.5})) == pytest.approx(0.0625)
    for notation in ("infix", "rpn", "latex"):
        assert X.parse(X.show(tree, notation), notation) == tree
    assert X.symbols(tree) == {"x"} and np.isnan(X.value(X.parse("Integral(1/t, (t, 0, 1))"), {}))


def test_solutions_outlive_the_job(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "solutions")
    rows = [("e1", r"x \cdot t", "3 x", 0.3, 0.0, 1.0), ("e2", r"x \cdot t", "3 x", 0.3, 0.0, 1.0), ("e3", r"\sin(x t)", "x", 0.1, 0.0, 1.0), ("e4", r"\foo{x}", "x", 0.1, 0.0, 1.0), ("e5", None, "x", 0.1, 0.0, 1.0)]
    schema = "equation_id string, kernel string, f string, lambda_val double, a double, b double"
    first = routing.solutions(spark.createDataFrame(rows[:3], schema), path).collect()
    assert sorted(r.state for r in first) == ["not_solved", "solved"]
    files = set(os.listdir(path))
    assert sorted(r.state for r in routing.solutions(spark.createDataFrame(rows, schema), path).collect()) == ["not_solved", "solved", "unreadable", "unreadable"]
    later = {f for f in os.listdir(path) if f.endswith(".parquet")} - files
    assert sum(spark.read.parquet(os.path.join(path, f)).count() for f in later) == 2
    assert routing.solutions(spark.createDataFrame([], schema)).collect() == []


def test_routing_of_odd_answers(spark):
    items = spark.createDataFrame([("a", "x*t", "x", 0.3, 0.0, 1.0, "x/0.9", "exact_symbolic"), ("b", None, None, None, None, None, None, None)], "equation_id string, kernel string, f string, lambda_val double, a double, b double, ground_truth string, ground_truth_solution_type string")
    answers = spark.createDataFrame([("a", "<|T_family|> <|sol|> C x <|end|>"), ("a", "<|sol|> x"), ("b", None), ("c", "x")], "equation_id string, text string")
    rows = routing.routed(answers.select("equation_id", routing.token_answer(answers.text).alias("answer")), items, routing.solutions(items)).collect()
    assert sorted((r.equation_id, r.solution_type, r.solver_used) for r in rows if r.solution_type) == [("a", "exact_symbolic", True), ("a", "family", False)]
    assert len(rows) == 3


def test_statuses(spark):
    long = " + ".join(f"sin({k}*x)" for k in range(3000))
    rows = [("x", "x"), ("x + (", "x"), (long, "x"), ("(x + 1)**40", "(1 + x)**40"), (None, "x")]
    df = spark.createDataFrame([(p, t, "exact_symbolic") for p, t in rows], "solution_str string, ground_truth string, ground_truth_solution_type string")
    got = [(r.status, r.evaluated, r.correct) for r in scoring.scored(df).collect()]
    assert got == [("scored", True, True), ("unreadable", False, None), ("too_complex", False, None), ("symbolic_limit", True, True), ("missing", False, None)]


ELSEWHERE = """
import sys
sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.remove({top!r})
sys.path.insert(0, {top!r})
import __spark_entry__ as entry
queries = entry.queries()
for name in {names!r}:
    print(name, len(queries[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_workers_without_the_package():
    """A query of each module with functions in Python, started from another folder and without PYTHONPATH."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = ["separable_solutions", "score_rows", "coefficient_match", "evaluation_points", "equation_texts", "select_candidates", "symbolic_pairs", "latex_readings"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE.format(top=top, names=names)], cwd=tempfile.mkdtemp(prefix="spark-"), env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert [line.split()[0] for line in out.stdout.splitlines()] == names
