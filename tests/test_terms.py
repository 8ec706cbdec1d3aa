"""Terms, series, families, points and checks."""

import math

from pyspark.sql import functions as F

from eqlake.functions import terms as M


def test_terms():
    assert M._coefficients("2*x*x - x**2/4 + 3") == {"(x)**2": 1.75, "1": 3.0}
    assert M._coefficients("(x + 1)**2*sin(x)") == {"sin(x)*(x)**2": 1, "sin(x)*x": 2, "sin(x)": 1}
    assert M._coefficients("x - x") == {} and M._coefficients("x + (") is None
    assert M._coefficients("(x + 1)**8*(x + t)**8*(x + 2)**8") is None


def test_series():
    got = M._series("1 + x + x**2", "x**2 + x + 2", 0.0, 1.0)
    assert (got["terms_compared"], got["match"], round(got["max_rmse"], 9)) == (3, False, 1.0)
    assert M._series("x/2 + 1", "1 + 0.5*x", 0.0, 1.0)["match"] and M._series("C*x", "x", 0.0, 1.0) is None


def test_family():
    assert M._family("3*sin(x)", "C*sin(x)") and M._family("A*sin(x)", "C*sin(x)") and M._family("x + 5", "x + C")
    assert not M._family("cos(x)", "C*sin(x)") and not M._family("sin(x)", "sin(x)") and not M._family("x +", "C")


def test_columns(spark):
    e = spark.sql("SELECT * FROM VALUES ('x + 1', '1 + x'), ('x', null), ('C*x', 'x') AS v(p, q)")
    rows = e.select(M.series_scores("p", "q", F.lit(0.0), F.lit(1.0)).alias("s"), M.family_match("q", "p").alias("f"), M.n_terms("p").alias("n")).collect()
    assert rows[0].s.match and rows[1].s is None and rows[2].s is None and [r.n for r in rows] == [2, 1, 1] and rows[2].f


def test_points(spark):
    kind = "array<struct<x: double, y: double>>"
    cases = [([(0, 1), (1, 2)], [(0, 1), (1, 2)]), ([(0, 1), (1, 3)], [(0, 1), (1, 2)]), ([(5, 5)], [(0, 1)]), ([], [(0, 1)]), (None, None)]
    df = spark.createDataFrame([(i, *(v and [tuple(map(float, x)) for x in v] for v in case)) for i, case in enumerate(cases)], f"i int, p {kind}, q {kind}")
    got = [r.s for r in df.orderBy("i").select(M.point_scores(F.col("p"), F.col("q")).alias("s")).collect()]
    assert [(s.match, s.matched_points, s.accuracy) for s in got] == [(True, 2, 1), (False, 1, 0.5), (False, 0, 0), (False, 0, 0), (False, 0, 0)]
    assert got[1].max_error == 1 and got[1].rmse == math.sqrt(0.5) and all(s.mae == math.inf for s in got[2:])


def test_checks(spark):
    df = spark.createDataFrame([("x*t", "x", "0.5", 0.0, 1.0, "x"), ("x*t*z", None, "abc", 1.0, 0.0, "x+("), ("x*t", "x", "0", None, 1.0, None)], "kernel string, f string, lambda_val string, a double, b double, solution string")
    good, bad, odd = M.checked(df).collect()
    assert good.valid and not good.errors and not good.warnings
    assert bad.errors == ["Missing required field: f", "Invalid kernel: z", "lambda_val must be a number", "Invalid domain: a must be less than b"] and bad.warnings == ["Invalid solution format: unreadable"]
    assert odd.valid and len(odd.warnings) == 3
