"""Solver routing: where an answer claims a solution of a kind that a solver can find, the solver's own takes its place.

Different equations are solved once: they are told apart by a digest of their content, and a table of solutions by
digest outlives the job, so a later run solves only what no run has seen. Answers are joined back to it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import responses as A
from ..functions.expressions import TROUBLE, _column, solve, solved_together
from ..functions.notation import _either, infix

#: The types that are routed, and tolerances by type of the scoring that follows.
SOLVABLE = ("exact_symbolic", "approx_coef", "series")
TYPE_TOLERANCES = {"series": 0.01, "approx_coef": 0.001, "regularized": 0.001}

EQUATION = ("kernel", "f", "lambda_val", "a", "b")
SOLUTIONS = "equation_key string, solution string, state string"

#: Bytes of solutions, measured, up to which they are broadcast to the answers; more are joined by key, hot keys split at run time.
BROADCAST_BYTES = 8 << 20

#: Outcomes of a solution.
SOLVED, NOT_SOLVED, NOT_READ = "solved", "not_solved", "unreadable"


def token_answer(c: Column) -> Column:
    """``struct<solution, has_solution, solution_type>`` of a response in tokens: a type token, then the solution between tokens of its own.

    Without a type token it is exact_symbolic; without a solution the text is empty. A null response gives null.
    """
    kind = F.coalesce(F.nullif(F.regexp_extract(c, r"<\|T_(\w+)\|>", 1), F.lit("")), F.lit("exact_symbolic"))
    body = F.trim(F.regexp_extract(c, r"(?s)<\|sol\|>(.*?)(?:<\|end\|>|$)", 1))
    return F.when(c.isNotNull(), F.struct(body.alias("solution"), (kind != "none").alias("has_solution"), kind.alias("solution_type")))


def plain_answer(c: Column) -> Column:
    """The same of a response in words; what isn't said counts as a solution of type exact_symbolic."""
    a = A.answer(c)
    said = F.struct(
        F.coalesce(a["solution"], F.lit("")).alias("solution"),
        F.coalesce(a["has_solution"], F.lit(True)).alias("has_solution"),
        F.coalesce(a["solution_type"], F.lit("exact_symbolic")).alias("solution_type"),
    )
    return F.when(c.isNotNull(), said)


def keyed(items: DataFrame) -> DataFrame:
    """``items`` with equation_key, a digest of kernel, f, lambda_val, a and b; nulls have a form of their own."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in EQUATION]
    return items.withColumn("equation_key", F.sha2(F.concat_ws("|", *parts), 256))


def _solve(kernel, f, lam, a, b):
    texts = _either(kernel), _either(f)
    if None in texts:
        return f"{NOT_READ}:"
    found = solve(*texts, float(lam), float(a), float(b))
    return f"{NOT_SOLVED}:" if found is None else f"{SOLVED}:{found}"


def _solve_together(rows: list[tuple], alone) -> list:
    """``_solve`` for many rows: each different text is read once, rows of one kernel are solved together."""

    def text(t):
        try:
            return _either(t)
        except TROUBLE:
            return None

    texts = {t: text(t) for t in {t for row in rows for t in row[:2]}}
    out, places, given = [None] * len(rows), [], []
    for k, (kernel, f, *numbers) in enumerate(rows):
        if texts[kernel] is None or texts[f] is None:
            out[k] = alone(rows[k])
        else:
            places.append(k)
            given.append((texts[kernel], texts[f], *map(float, numbers)))
    failed = object()

    def one(row):
        try:
            return solve(*row)
        except TROUBLE:
            return failed

    for k, found in zip(places, solved_together(given, one), strict=True):
        out[k] = None if found is failed else f"{NOT_SOLVED}:" if found is None else f"{SOLVED}:{found}"
    return out


_solved = _column(T.StringType(), _solve, _solve_together)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table of solutions at a path; empty where there is none yet. A key that two runs added at once counts once."""
    try:
        return spark.read.schema(SOLUTIONS).parquet(path).dropDuplicates(["equation_key"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SOLUTIONS)


def solutions(items: DataFrame, path: str | None = None) -> DataFrame:
    """(equation_key, solution, state) of the different equations of ``items`` (kernel, f in LaTeX or infix, lambda_val, a, b).

    ``state`` is solved, not_solved (the kernel isn't separable, or the system is singular) or unreadable (in LaTeX
    also where two readings differ, or something is null). With ``path``, solutions are appended there, and those that
    stand there already aren't computed again.
    """
    spark = items.sparkSession
    each = keyed(items).groupBy("equation_key").agg(*(F.first(c).alias(c) for c in EQUATION))
    if path:
        each = each.join(stored(spark, path).select("equation_key"), "equation_key", "left_anti")
    # few bytes but much work a row: more tasks than their size asks for
    each = each.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "equation_key")
    text = F.coalesce(_solved(*(F.col(c) for c in EQUATION)), F.lit(f"{NOT_READ}:"))
    new = each.select("equation_key", text.alias("_found")).select(
        "equation_key", F.nullif(F.regexp_replace("_found", r"^\w+:", ""), F.lit("")).alias("solution"), F.substring_index("_found", ":", 1).alias("state")
    )
    if path is None:
        return new
    new.write.mode("append").parquet(path)
    return stored(spark, path)


def attached(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with equation_key) and their solution and state; ``found`` is broadcast if its measured bytes allow it."""
    size = found.agg(F.sum(F.octet_length("equation_key") + F.coalesce(F.octet_length("solution"), F.lit(0)) + 16)).head()[0] or 0
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    return rows.join(side, "equation_key", "left")


def routed(answers: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with an answer (equation_id and ``answer``, a struct of the functions above), as rows that ``scoring.scored`` takes.

    An answer that claims a solution of a SOLVABLE type gets the solver's solution, if there is one, and ``solver_used``. Texts come out in infix; one that can't
    be read stays as it is. An answer without an item goes, an item without an answer too.
    """
    rows = attached(keyed(items.join(answers.select("equation_id", "answer"), "equation_id")), found)
    said = F.col("answer")
    used = F.coalesce(said["has_solution"] & said["solution_type"].isin(*SOLVABLE) & F.col("solution").isNotNull(), F.lit(False))
    own = F.coalesce(infix(said["solution"]), said["solution"])
    return _scorable(rows, F.when(used, F.col("solution")).otherwise(own), said["has_solution"], said["solution_type"], used)


def always(items: DataFrame, found: DataFrame) -> DataFrame:
    """Every item with the solver's solution, empty where it found none, claimed as exact_symbolic."""
    used = F.col("solution").isNotNull()
    return _scorable(attached(keyed(items), found), F.coalesce("solution", F.lit("")), F.lit(True), F.lit("exact_symbolic"), used)


def _scorable(rows: DataFrame, text: Column, says: Column, kind: Column, used: Column) -> DataFrame:
    truth = F.coalesce(infix(F.col("ground_truth")), F.col("ground_truth"))
    return rows.select(
        "equation_id", text.alias("solution_str"), truth.alias("ground_truth"), says.alias("has_solution"), kind.alias("solution_type"),
        (F.col("ground_truth_solution_type") != "none").alias("ground_truth_has_solution"), "ground_truth_solution_type",
        F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("ground_truth_domain"), used.alias("solver_used"),
    )


def configurations(answers: dict[str, DataFrame], items: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of every configuration in one table (``configuration``): each set of answers with the solver, and the solver alone."""
    out = always(items, found).withColumn("configuration", F.lit("solver_always"))
    for name, rows in answers.items():
        out = out.unionByName(routed(rows, items, found).withColumn("configuration", F.lit(f"{name}_solver")))
    return out
