"""Preparation that goes on where it was stopped, faulty rows, metric files, answers in prose, series, and a caller's strategies and notations."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from eqlake import plugins
from eqlake.functions import answers, series
from eqlake.functions import expressions as X
from eqlake.operators import generators
from eqlake.plans import preparation, runs

LINES = ["u,f,kernel,lambda_val,a,b", "x,x,x*t,0.5,0,1", '"x, t",x,x*t,,0,1', "x,x,,0.5,0,1", "x,x,x*t,much,0,1", "x,x,x*t,0.5,1,0", "x,x,x*t,0.5,0,1,more", "x,x", "2x,x**2,1,0.25,-1,1", "x,x,x*t,0.5,low,high"]


def folder(*files):
    path = tempfile.mkdtemp(prefix="spark-")
    for name, text in files:
        with open(os.path.join(path, name), "w") as out:
            out.write(text)
    return path


def test_faulty_rows(spark):
    path = folder(("a.csv", "\n".join(LINES)), ("b.csv", LINES[0]))
    rows = preparation.loaded(spark, path)
    got = sorted(tuple(r.reasons) for r in rows.collect())
    assert got == sorted([(), (), ("kernel",), ("lambda_val",), ("domain",), ("malformed",), ("malformed",), (), ("a", "b")])
    bad = preparation.quarantine(rows).where(F.array_contains("reasons", "malformed")).collect()
    assert sorted(r[preparation.CORRUPT] for r in bad) == ["x,x", "x,x,x*t,0.5,0,1,more"] and all(r.source_file.endswith("a.csv") for r in bad)
    good = preparation.usable(rows)
    assert sorted((r.u, r.lambda_val) for r in good.collect()) == [("2*x", 0.25), ("x", 0.5), ("x, t", 1.0)] and good.select("equation_id").distinct().count() == 3


def test_preparation_goes_on_after_each_stage(spark, monkeypatch):
    path = folder(("a.csv", "\n".join([LINES[0], *(f"{k}*x,x,x*t,0.5,0,1" for k in range(40))])))
    whole = preparation.prepare(spark, path, tempfile.mkdtemp(prefix="spark-"), "basic")
    want = {k: sorted(map(repr, v.drop("source_file").collect())) for k, v in whole.items() if k != "manifest"}
    stages = ["loaded", "equations", "quarantine", "splits", "prompts"]
    assert sorted(r.stage for r in whole["manifest"].collect()) == sorted(stages)
    plain = preparation.Job.stage
    for stop in stages:
        root, built = tempfile.mkdtemp(prefix="spark-"), []

        def stage(self, name, build, depends, by=(), stop=stop, built=built):
            if name == stop and not built.count("stopped"):
                built.append("stopped")
                build().write.mode("overwrite").parquet(f"{self.root}/{name}/half")  # written, not entered
                raise KeyboardInterrupt
            out = plain(self, name, build, depends, by)
            built.extend(self.built)
            self.built.clear()
            return out

        monkeypatch.setattr(preparation.Job, "stage", stage)
        with pytest.raises(KeyboardInterrupt):
            preparation.prepare(spark, path, root, "basic")
        again = preparation.prepare(spark, path, root, "basic")
        assert [b for b in built if b != "stopped"] == stages  # each once, over both runs
        assert {k: sorted(map(repr, v.drop("source_file").collect())) for k, v in again.items() if k != "manifest"} == want
        monkeypatch.setattr(preparation.Job, "stage", plain)
    root = tempfile.mkdtemp(prefix="spark-")
    preparation.prepare(spark, path, root, "basic")
    with open(os.path.join(path, "b.csv"), "w") as out:
        out.write("\n".join(LINES[:2]))
    assert preparation.prepare(spark, path, root, "basic")["equations"].count() == 41


def test_metric_files(spark):
    path = folder(("one.json", '{"accuracy": 0.5, "per_type": {"series": {"accuracy": 1.0, "n": 3}}}'), ("two.json", '{"accuracy": Infinity}'), ("three.json", '[1, 2]'))
    files = runs.metric_files(spark, path)
    table = spark.createDataFrame([("a", "one.json"), ("b", "two.json"), ("c", "three.json"), ("d", "four.json")], "run string, file string")
    got = {r.run: (r.state, r.accuracy, r.evaluated) for r in runs.run_table(table, files).collect()}
    assert got == {"a": ("done", 0.5, None), "b": ("unreadable", None, None), "c": ("done", None, None), "d": ("not_run", None, None)}
    assert {r.run: (r.series, r.family) for r in runs.type_table(table, files, ["series", "family"]).collect()}["a"] == (1.0, None)
    assert sorted((r.file, r.kind, r.metric, r.value) for r in runs.long_table(files).collect()) == [("one.json", "series", "accuracy", 1.0), ("one.json", "series", "n", 3.0)]


def test_answers_in_prose():
    cases = {
        "Thus u(x) = x.": "x", "u(x) = 5": "5", "The answer: `exp(x) - 1`": "exp(x) - 1", "I think it is x^2 + 3 sin(x), which solves it": "x**2 + 3*sin(x)",
        "First $x + 1$, later $u(x) = \\frac{x}{2}$.": "x/2", "Let K = x*t. Then u(x) = 3x/2.": "3*x/2", "$$u(x) = C_1 e^{x}$$": "C_1*exp(x)",
        "so it is 42.": None, "no solution": None, "": None, "a b c d": None, "$\\unknown{x}$ only": None, "x": "x",
    }
    assert {k: answers.extracted(k) for k in cases} == cases and answers.extracted(None) is None


def test_answers_of_long_runs(spark):
    whole = " + ".join(f"{k}*x" for k in range(1, 3001))
    constants = "1 + 2 * 3 " * 60
    cases = {
        "so it is " + whole: whole, constants + "* x": answers.extracted("1 + " + constants[4:] + "*x"), "x + 1 , " + constants + ", x * (x - 2) + 3": "x*(x - 2) + 3",
        "|x| + " * 500 + "1": "Abs(x) + " * 500 + "1", "(" * 300 + "x + 1" + ")" * 300: "x + 1", "a * " * 500 + "b": "a*a*a", constants: None, "1e999 * x + 2 * x": "x + 2*x",
    }
    assert {k: answers.extracted(k) for k in cases} == cases and cases[constants + "* x"].endswith("3*x")
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.value_at(answers.answer_text("t"), F.lit(1.0)).alias("v")).collect()
    have = {r.t: r.v for r in rows}
    assert have["so it is " + whole] == 4501500 and have["|x| + " * 500 + "1"] == 501 and have["x + 1 , " + constants + ", x * (x - 2) + 3"] == 2


def test_the_longest_span_is_the_brute_force_one():
    def brute(line, run):
        for size in range(len(run), 1, -1):
            for k in range(len(run) - size + 1):
                raw = line[run[k][0] : run[k + size - 1][1]]
                tree = X.parse(raw.replace("^", "**"))
                if answers._usable(tree):
                    return tree, raw
        return None

    pieces = ("x a b 2 + - * / ^ ( ) | , sin", "x | + a * |", "a b * / c - ( ) d x", "sin ^ x 2 ( ) - | cos **", "Integral ( x , ( t , 0 , 1 ) ) + | - e", "1 pi e + 1e999 x * ( )")
    draw, count = random.Random(7), 0
    for n in range(3_000):
        line = " ".join(draw.choices(pieces[n % len(pieces)].split(), k=draw.randint(2, 14)))
        if n % 3 == 0:
            line = f"Integral({line}, (x, 0, 1)) + {line}"
        for _, run in answers._runs(line):
            want = brute(line, run)
            count += want is not None
            assert answers._longest(line, run) == want, line
    assert count > 1_000


def test_series():
    both = lambda rule, p, q: series.show(rule(series.read(p), series.read(q)))
    assert both(series.add, "1 + x + O(x**2)", "x - x**2 + O(x**5)") == "1 + 2*x + O(x**2)"
    assert both(series.multiply, "1 + x + O(x**2)", "x - x**2 + O(x**5)") == "x + O(x**3)"
    assert both(series.multiply, "x + 1", "x - 1") == "-1 + x**2" and both(series.multiply, "O(x**2)", "x**3 + O(x**4)") == "O(x**5)"
    assert series.add(series.read("x"), series.read("(x - 1) + O((x - 1)**2)")) is None
    assert [series.show(series.read(t), False) for t in ("(x - 1) - (x - 1)**2/2 + O((x - 1)**3)", "1 + O(x)", "0", "sin(x) + O(x)", "x + (")] == ["(x - 1) - 1/2*(x - 1)**2", "1", "0", None, None]


def test_taylor_text_reads_back(spark):
    from eqlake.functions import notation

    texts = spark.createDataFrame([("exp(x)", 0.0), ("log(x)", 1.0), ("1/(1 - x)", 0.0)], "e string, at double")
    row = texts.select(notation.taylor_text(F.col("e"), F.col("at"), F.lit(5)).alias("full"), notation.taylor_polynomial(F.col("e"), F.col("at"), F.lit(5)).alias("bare")).collect()
    for r in row:
        assert series.read(r.full).order == 5 and series.read(r.full).terms == series.read(r.bare + f" + O({'(x - 1)' if '(x - 1)' in r.full else 'x'}**5)").terms


def test_own_strategy_and_notation(spark):
    def rows(equation):
        for k in range(2):
            yield {"kernel": f"{k}*{equation['kernel']}", "lambda_val": equation.get("lambda_val")}

    plugins.register_strategy(spark, "scaled", rows)
    spark.createDataFrame([(1, "x*t", 0.5), (2, None, None)], "id int, k string, l double").createOrReplaceTempView("own_equations")
    got = spark.sql("SELECT id, s.kernel, s.lambda_val, s.u, s.edge_case FROM own_equations, LATERAL scaled(kernel => k, lambda_val => l) s").collect()
    assert sorted(map(tuple, got)) == sorted([(1, "0*x*t", 0.5, None, "scaled"), (1, "1*x*t", 0.5, None, "scaled"), (2, "0*None", None, None, "scaled"), (2, "1*None", None, None, "scaled")])
    with pytest.raises(Exception, match="unknown arguments"):
        spark.sql("SELECT * FROM own_equations, LATERAL scaled(color => k)").collect()

    def reader(text):  # Polish: operators before their operands
        tokens = text.split()[::-1]
        stack = []
        for token in tokens:
            if token in "+*":
                stack.append((token, stack.pop(), stack.pop()))
            else:
                stack.append(("num", float(token)) if token[0].isdigit() else ("sym", token))
        return stack[0] if len(stack) == 1 else None

    def printer(tree):
        return f"{tree[0]} {printer(tree[1])} {printer(tree[2])}" if tree[0] in "+*" else str(tree[1])

    read, write = plugins.register_notation(spark, "polish", reader, printer)
    df = spark.createDataFrame([("+ * 2 x t",), ("+ 2",), (None,)], "t string")
    assert [r[0] for r in df.select(read("t")).collect()] == ["2*x + t", None, None]
    assert spark.sql("SELECT to_polish('2*x + t') AS t, from_polish('* x t') AS u, to_polish('x + (') AS v").first() == ("+ * 2.0 x t", "x*t", None)
    assert df.select(write(F.lit("x*t"))).first()[0] == "* x t"


def test_generated_series_with_their_function(spark):
    df = spark.createDataFrame([("f(x) + 2*Integral(x*f(t), (t, 0, 1))", "x**2"), ("f(x)", "x + ("), (None, "x")], "u string, f string")
    assert [r[0] for r in df.select(generators.applied(F.col("u"), F.col("f"))).collect()] == ["x**2 + 2*Integral(x*t**2, (t, 0, 1))", None, None]
