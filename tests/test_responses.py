"""Answers, prompts, calls and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from eqlake.functions import notation, prompts
from eqlake.functions import responses as A
from eqlake.operators import calls
from eqlake.streaming import predictions

CASES = [
    ("SOLUTION: u(x) = x**2\nHAS_SOLUTION: yes", "x**2", True, None),
    ("HAS_SOLUTION: there is none\nSOLUTION_TYPE: none", None, False, "none"),
    (r"So \( u(x) = \sin(x) \) holds.", r"\sin(x)", None, None),
    ("The answer: u(x) = 3*x/2, where x is real.", "3*x/2", None, None),
    ("No solution exists.", None, False, None),
    ("SOLUTION TYPE: approx coef\n---", None, None, "approx_coef"),
    ("   ", None, None, None),
    (None, None, None, None),
]


@pytest.mark.parametrize("text,solution,has,kind", CASES)
def test_answers(spark, text, solution, has, kind):
    a = spark.createDataFrame([(text,)], "r string").select(A.answer(F.col("r")).alias("a")).first().a
    assert (a.solution, a.has_solution, a.solution_type) == (solution, has, kind)


def test_points_steps_formulas_names(spark):
    texts = ["SOLUTION: [(0,1), (1e-1, -2)]", "[(0,1)]", "[(0,1), (1,2e10)]", "[(0,1), (1,--2)]", "x [(0 , 1 ),(1 , 2 )] y", "1. first\nmore\n2) second", "$$a$$ and \\begin{align}b\\end{align}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.point_list(F.col("t")).alias("p"), A.steps(F.col("t")).alias("s"), A.formulas(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.p and [tuple(p) for p in r.p] for r in rows[:5]] == [[(0, 1), (0.1, -2)], None, None, None, [(0, 1), (1, 2)]]
    assert rows[5].s == "first\nmore\nsecond" and rows[0].s is None
    assert "a" in rows[6].f and rows[6].f[-1] == "b"
    names = spark.createDataFrame([("a/rpn/test_latex.csv",), ("a/x.csv",)], "n string").select(notation.notation_of_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["latex", None]


def test_prompts(spark):
    e = spark.createDataFrame([("e1", "x*t", "x", 0.5, 0.0, 1.0, None, "series"), ("e2", "x*t", None, 0.5, 0.0, 1.0, True, None)], "equation_id string, kernel string, f string, lambda_val double, a double, b double, has_solution boolean, solution_type string")
    out = prompts.prompts(e, "all", "latex", "hints").collect()
    assert len(out) == 8 and all(r.prompt.endswith("\n[Type: series]") and "latex" in r.prompt for r in out if r.equation_id == "e1")
    assert all(r.prompt is None for r in out if r.equation_id == "e2")
    with pytest.raises(ValueError, match="unknown"):
        prompts.styles("basic,odd")
    with pytest.raises(ValueError, match="unknown"):
        prompts.prompts(e, mode="odd")


def client():
    seen = {}

    def call(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "never" or prompt == "later" and seen[prompt] < 3:
            raise OSError("busy")
        return prompt.upper()

    return call


def test_calls(spark):
    p = spark.createDataFrame([(1, "now"), (2, "later"), (3, "never"), (4, None)], "i int, prompt string").coalesce(1)
    rows = {r.i: (r.response, r.attempts, r.error) for r in calls.responses(p, client, wait=0.0).collect()}
    assert rows == {1: ("NOW", 1, None), 2: ("LATER", 3, None), 3: ("", 3, "OSError: busy"), 4: ("", 0, "no prompt")}
    assert [r.i for r in calls.pending(p, p.where("i < 3"), "i").orderBy("i").collect()] == [3, 4]


def test_stream(spark, tmp_path):
    def put(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def drain():
        s = predictions.arriving(spark, str(tmp_path / "in"))
        assert predictions.appended(predictions.parsed(s), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    one = {"equation_id": "a", "response": "HAS_SOLUTION: yes\nSOLUTION: x", "ground_truth_has_solution": True, "at": "2024-01-01T00:00:00Z"}
    put("1.json", one, one)
    assert drain().count() == 1
    put("2.json", one, one | {"equation_id": "b", "response": "No solution exists", "at": "2024-01-01T00:10:00Z"})
    out = drain()
    assert sorted((r.equation_id, r.has_solution) for r in out.collect()) == [("a", True), ("b", False)]
    assert [tuple(r)[1:] for r in predictions.accuracy(out).collect()] == [(2, 2, 1)]
