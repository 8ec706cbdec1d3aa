"""Answers by several methods for each equation, checked by their residuals, repaired once, and the best of them; and scripts that models write.

Candidates are rows: an equation by method explode, a call for each row, a residual check, another round for what
failed, then one choice a group. Nothing is kept in a process between rows, so a lost task costs its own calls alone.
"""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import responses as A
from ..functions.expressions import _column, parse, residuals, show, with_constants
from ..functions.notation import infix
from ..functions.text import last_block
from ..operators.calls import responses
from ..shipping import ship

#: Methods and what each is asked to do, in the order that breaks ties: our own words.
METHODS = {
    "degenerate_kernel": "Write the kernel as a sum of products g(x) h(t), reduce the equation to a linear system and solve it exactly.",
    "adomian": "Decompose u into components, each the integral of the one before, from u_0 = f, and add up at least four.",
    "neumann": "Check that successive approximations converge, iterate from u_0 = f and sum the series, in closed form if you can.",
    "nystrom": "Replace the integral by a quadrature, solve the linear system at its nodes and find the function through them.",
    "eigenfunction": "Expand in eigenfunctions of the kernel, look for resonance, and treat each coefficient by itself.",
}
REPAIR = "\n\nYour answer was u(x) = {solution}, but it leaves a residual of {residual} in the equation. Find the mistake and answer again in the same format."
#: Characters of a script's output that count, and of what it complains.
OUTPUT, COMPLAINT = 20_000, 2_000


def _checked(solution, kernel, f, lam, a, b, tolerance, points):
    tree = parse(solution)
    if tree is None:
        return None
    found = residuals(show(with_constants(tree, 1.0)), kernel, f, lam, a, b, int(points), None, tolerance)
    return None if found is None else found["residual_max"]


_residual = _column(T.DoubleType(), _checked)


def candidates(prompts: DataFrame, make_client: Callable, methods: dict[str, str] = METHODS, **options) -> DataFrame:
    """``prompts`` (equation_id, prompt, kernel, f, lambda_val, a, b) by method, with the method's place, its own prompt and the response."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(i).alias("place"), F.lit(text).alias("ask")) for i, (m, text) in enumerate(methods.items())))
    rows = prompts.select("*", F.explode(each).alias("_m"))
    ask = F.concat(F.col("_m.ask"), F.lit("\n\n"), F.col("prompt")).alias("prompt")
    rows = rows.select(*(c for c in prompts.columns if c != "prompt"), ask, "_m.method", "_m.place")
    return responses(rows, make_client, **options)


def verified(rows: DataFrame, round_no: int = 0, tolerance: float = 1e-6, points: int = 12) -> DataFrame:
    """``rows`` with round, solution_str, has_solution, solution_type, residual_max and status.

    verified: the residual is within ``tolerance``; failed: it isn't; unverifiable: no answer, a denial, points, an equation of the first
    kind, or something that can't be read. Free constants count as 1.
    """
    fresh = ("round", "solution_str", "has_solution", "solution_type", "residual_max", "status", "_a")
    rest = rows.select(*(c for c in rows.columns if c not in fresh))
    parsed = rest.withColumn("_a", A.answer(F.col("response")))
    parsed = parsed.select(*rest.columns, F.lit(round_no).alias("round"), F.col("_a.solution").alias("solution_str"), F.col("_a.has_solution").alias("has_solution"), F.col("_a.solution_type").alias("solution_type"))
    told = F.coalesce(F.col("has_solution"), F.lit(True)) & (F.col("lambda_val") != 0)
    plain = parsed.withColumn("_infix", infix("solution_str"))
    found = _residual(F.when(told, F.col("_infix")), "kernel", "f", F.col("lambda_val").cast("double"), F.col("a").cast("double"), F.col("b").cast("double"), F.lit(tolerance), F.lit(points))
    out = plain.withColumn("residual_max", found).drop("_infix")
    return out.withColumn("status", F.when(F.col("residual_max").isNull(), "unverifiable").when(F.col("residual_max") < tolerance, "verified").otherwise("failed"))


def rank() -> list[Column]:
    """Verified first, then failed, then unverifiable; the least residual; the method's place."""
    status = F.when(F.col("status") == "verified", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "unverifiable", 2).otherwise(3)
    return [status, F.coalesce("residual_max", F.lit(float("inf"))), F.col("place")]


def repairs(rows: DataFrame, template: str = REPAIR) -> DataFrame:
    """The failed candidates of equations none of whose candidates is verified, with the prompt of another round."""
    solved = F.max(F.col("status") == "verified").over(Window.partitionBy("equation_id"))
    todo = rows.withColumn("_solved", solved).where(~F.col("_solved") & (F.col("status") == "failed")).drop("_solved")
    before, rest = template.split("{solution}")
    between, after = rest.split("{residual}")
    ask = F.concat(F.col("prompt"), F.lit(before), F.col("solution_str"), F.lit(between), F.col("residual_max").cast("string"), F.lit(after))
    return todo.withColumn("prompt", ask).drop("response", "attempts", "error", "round", "solution_str", "has_solution", "solution_type", "residual_max", "status")


def merged(rows: DataFrame, again: DataFrame) -> DataFrame:
    """The better of each equation's and method's candidates of both rounds; the earlier one if they are equal."""
    both = rows.unionByName(again)
    w = Window.partitionBy("equation_id", "method").orderBy(*rank(), "round")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def selected(rows: DataFrame) -> DataFrame:
    """One candidate of each equation, with selection_reason.

    verified: the best verified one; majority_vote: the best of the largest group of two and more that agree on whether there
    is a solution and of what type, the group of the first method if several are as large; best_effort: the best;
    all_calls_failed: none answered.
    """
    live = F.coalesce(F.col("response"), F.lit("")) != ""
    group = Window.partitionBy("equation_id", "_live", "has_solution", "solution_type")
    whole = Window.partitionBy("equation_id")
    out = rows.withColumn("_live", live)
    out = out.withColumn("_votes", F.when(F.col("_live"), F.count("*").over(group)).otherwise(0)).withColumn("_first", F.min("place").over(group))
    sure = F.col("_live") & (F.col("status") == "verified")
    out = out.withColumn("_sure", F.max(sure).over(whole)).withColumn("_most", F.max("_votes").over(whole))
    out = out.withColumn("_lead", F.min(F.when(F.col("_live") & (F.col("_votes") == F.col("_most")), F.col("_first"))).over(whole))
    reason = F.when(F.col("_most") == 0, "all_calls_failed").when(F.col("_sure"), "verified").when(F.col("_most") > 1, "majority_vote").otherwise("best_effort")
    fits = F.when(F.col("_sure"), sure).when(F.col("_most") > 1, F.col("_live") & (F.col("_votes") == F.col("_most")) & (F.col("_first") == F.col("_lead"))).otherwise(F.col("_live") | (F.col("_most") == 0))
    out = out.withColumn("selection_reason", reason).where(fits)
    out = out.withColumn("_rn", F.row_number().over(Window.partitionBy("equation_id").orderBy(*rank()))).where("_rn = 1")
    return out.drop("_rn", "_live", "_votes", "_first", "_sure", "_most", "_lead")


def solved(prompts: DataFrame, make_client: Callable, path: str, methods: dict[str, str] = METHODS, rounds: int = 1, **options) -> DataFrame:
    """The chosen answer of each equation; every round's candidates are written below ``path`` before they are used, so no call is made twice.

    A round whose table stands there already isn't asked again, so a job that stopped goes on.
    """
    spark = prompts.sparkSession

    def kept(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        place = f"{path}/{name}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            make().write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)

    now = kept("round-0", lambda: verified(candidates(prompts, make_client, methods, **options)))
    for k in range(1, rounds + 1):
        again = kept(f"round-{k}", lambda now=now, k=k: verified(responses(repairs(now), make_client, **options), k))
        now = merged(now, again)
    return selected(now)


def wins(rows: DataFrame) -> DataFrame:
    """``method, selection_reason, n`` of chosen candidates."""
    return rows.groupBy("method", "selection_reason").agg(F.count("*").alias("n"))


def run_script(code: str, timeout: int = 60) -> tuple[bool, str, str]:
    """(whether it ended well and printed a solution, what it printed last, what went wrong) of a script in a process of its own."""
    with tempfile.TemporaryDirectory() as folder:
        script = Path(folder) / "solve.py"
        script.write_text(code, encoding="utf-8")
        try:
            done = subprocess.run([sys.executable, "-I", str(script)], capture_output=True, text=True, timeout=timeout, cwd=folder)
        except subprocess.TimeoutExpired:
            return False, "", f"timed out after {timeout}s"
    printed = done.stdout[-OUTPUT:]
    if done.returncode:
        return False, printed, done.stderr[-COMPLAINT:]
    return ("SOLUTION:" in printed), printed, "" if "SOLUTION:" in printed else "script printed no SOLUTION: line"


def scripted(rows: DataFrame, make_client: Callable | None = None, timeout: int = 60, rounds: int = 1, allow: bool = False) -> DataFrame:
    """``rows`` (prompt, response) with text and outcome: what the last python block of a response prints.

    exec_ok: it printed a solution; no_code: there is no block; fallback_raw: it failed, and so did its repair by the client, and the response
    stands as it is. Scripts come from a model and can do what the workers' account can, so nothing runs unless ``allow`` is set.
    """
    if not allow:
        raise PermissionError("running scripts that models wrote has to be allowed")
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("outcome", T.StringType())])
    marked = rows.withColumn("_code", F.trim(last_block(F.col("response"))))

    def run(frames):
        import re

        client = make_client() if make_client else None
        block = re.compile(r"```(?:python|py)?\s*\n(.*?)```", re.DOTALL)
        for frame in frames:
            texts, outcomes = [], []
            for prompt, response, code in zip(frame["prompt"], frame["response"], frame["_code"], strict=True):
                text, outcome = response, "fallback_raw"
                for turn in range(rounds + 1):
                    if not isinstance(code, str) or not code:
                        outcome = "no_code"
                        break
                    good, printed, wrong = run_script(code, timeout)
                    if good:
                        text, outcome = printed, "exec_ok"
                        break
                    if client is None or turn == rounds:
                        break
                    try:
                        text = client(f"{prompt}\n\nThis script:\n```python\n{code}\n```\nfailed:\n{wrong or printed[-1000:]}\n\nMend it and answer with one python block alone.")
                    except Exception:  # the client's own errors, of any kind
                        break
                    found = block.findall(text or "")
                    code = found[-1].strip() if found else None
                texts.append(text)
                outcomes.append(outcome)
            out = frame.drop(columns=["_code"])
            out["text"], out["outcome"] = texts, outcomes
            yield out

    ship(marked.sparkSession)
    return marked.mapInPandas(run, schema)
