"""Queries of symbolic work: canonical forms, LaTeX, integrals and solver routing, each row with an expression of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import by_case, query
from .functions import canonical, latex, notation
from .functions import expressions as X
from .plans import routing, scoring
from .staging import spread, written


PAIRS = (
    ("sin({k}*x)**2 + cos({k}*x)**2", "1", "equal"),
    ("(x + {k})*(x - {k})", "x**2 - {k}**2", "equal"),
    ("{k}e-12*x", "{k}.5e-12*x", "unequal"),
    ("log({k}*x)", "log({k}) + log(x)", "equal"),
    ("Piecewise((x, x < {k}), (0, True))", "x", "unequal"),
    ("exp({k}*x)*exp(-x)", "exp({k}*x - x)", "equal"),
    ("{k}*log(x)", "{k}*log(abs(x))", "unequal"),
    ("(x + t + {k})**40", "(t + x + {k})**40", "too_complex"),
    ("{k}*sinh(2*x)", "2*{k}*sinh(x)*cosh(x)", "equal"),
    ("sqrt({k}**2*x**2)", "{k}*x", "unequal"),
    ("cos(x - {k}*t)", "cos(x)*cos({k}*t) + sin(x)*sin({k}*t)", "equal"),
    ("x +* {k}", "{k}*x", "unreadable"),
    ("{k}/(1 + exp(-x))", "{k}*exp(x)/(exp(x) + 1)", "equal"),
    ("{k}*x", "{k}*x + 1e-9", "undecided"),
    ("Integral({k}*t*exp(t), (t, 0, x))", "{k}*(x - 1)*exp(x) + {k}", "equal"),
)


@query("SELECT p_partkey, ['" + "', '".join(p[2] for p in PAIRS) + f"'][p_partkey % {len(PAIRS)} + 1] AS state FROM part")
def symbolic_pairs(t, spark):
    """Pairs of texts that are equal by an identity, differ where points don't look at first, or can't be told."""
    k = F.col("p_partkey")
    one, other = (by_case(k, [p[side] for p in PAIRS]) for side in (0, 1))
    return spread(t("part").select("p_partkey")).select("p_partkey", canonical.comparison(one, other).alias("state"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_partkey + 2) || '*x' WHEN 1 THEN 'x**2 - ' || (p_partkey * p_partkey) WHEN 2 THEN (p_partkey + 1) || '*sin(x)' WHEN 3 THEN 'x + ' || p_partkey WHEN 4 THEN '1/2 - cos(' || (2 * p_partkey) || '*x)/2' ELSE 'exp(x)/' || p_partkey END AS canonical, "
    "CASE p_partkey % 6 WHEN 0 THEN 'x ' || (p_partkey + 2) || ' *' END AS product_rpn FROM part WHERE p_partkey % 6 <> 5 OR p_partkey > 64"
)
def canonical_texts(t, spark):
    k = F.col("p_partkey")
    e = by_case(k, ("{k}*x + 2*x", "(x - {k})*(x + {k})", "sin(x) + sin(x)*{k}", "(x**2 - {k}**2)/(x - {k})", "sin({k}*x)**2", "exp(x + 1)*{k}/({k}*{k}*exp(1))"))
    rows = spread(t("part").select("p_partkey")).where((k % 6 != 5) | (k > 64))
    text = canonical.canonical_text(e, F.lit("infix"))
    # a quotient by a large number without a finite decimal is shown as a factor
    text = F.when(k % 6 == 5, F.concat(F.lit("exp(x)/"), F.round(F.exp(F.lit(1.0)) / X.value_at(text, F.lit(1.0)), 6).cast("long").cast("string"))).otherwise(text)
    rpn = F.when(k % 6 == 0, F.concat(F.lit("x "), F.split(X.convert(text, F.lit("infix"), F.lit("rpn")), " ")[0], F.lit(" *")))
    return rows.select("p_partkey", text.alias("canonical"), rpn.alias("product_rpn"))


TEXTS = (
    (r"\dfrac{{k}x}{2}", "agreed", "k / 2"),
    (r"\operatorname{sinh}(x) + {k}", "agreed", "(exp(1) - exp(-1)) / 2 + k"),
    (r"{k}\mathrm{e}^{x}", "agreed", "k * exp(1)"),
    (r"\frac12 \sqrt[3]{x} \cdot {k}", "agreed", "k / 2"),
    (r"\int_{0}^{1} {k} x t \, dt", "agreed", "k / 2"),
    (r"{k}\unknowncommand{x}", "neither", "NULL"),
    (r"\sin^{2} x + \cos^2(x) + {k}", "agreed", "1 + k"),
    (r"\left|x - {k}\right| + \ln e^{x}", "agreed", "abs(1 - k) + 1"),
    (r"\begin{cases} x & x < {k} \\ 0 & \text{otherwise} \end{cases}", "agreed", "CASE WHEN 1 < k THEN 1 ELSE 0 END"),
    (r"{k} \sin \pi x \cos x", "agreed", "0"),
    (r"\text{no solution for } {k}", "neither", "NULL"),
    (r"\int_0^{1} \int_0^{1} {k} s t x \, ds \, dt + u(t)", "neither", "NULL"),
    (r"\frac{{k}^{x}}{\log_{2} 4}", "agreed", "k / 2"),
)


@query(
    "SELECT p_partkey, state, round(value, 4) AS at_one FROM (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS k, p_partkey % "
    + str(len(TEXTS)) + " AS g FROM part) p, LATERAL (SELECT ['" + "', '".join(x[1] for x in TEXTS) + "'][g + 1] AS state, CAST(CASE g " + " ".join(f"WHEN {n} THEN {x[2]}" for n, x in enumerate(TEXTS)) + " END AS DOUBLE) AS value)"
)
def latex_readings(t, spark):
    """LaTeX texts by two readings: how they relate, and the value at 1 of those on which both agree."""
    text = by_case(F.col("p_partkey"), [x[0] for x in TEXTS])
    (how,) = latex.states(text)
    infix = X.convert(text, F.lit("latex"), F.lit("infix"))
    return spread(t("part").select("p_partkey")).select("p_partkey", how.alias("state"), (F.round(X.value_at(infix, F.lit(1.0)), 4) + 0.0).alias("at_one"))


INTEGRALS = (
    ("Integral({k}*x*t, (t, 0, 1))", "k * x / 2"),
    ("Integral({k}*exp(x*t), (t, 0, 1))", "k * (exp(x) - 1) / x"),
    ("x + Integral(sin(t)*{k}, (t, 0, x))", "x + k * (1 - cos(x))"),
    ("Integral(Integral({k}*s*t*x, (s, 0, t)), (t, 0, 1))", "k * x / 8"),
    ("Integral(abs(x - t)*{k}, (t, 0, 1))", "k * (x * x + (1 - x) * (1 - x)) / 2"),
    ("Integral(t**2*exp(-t)*{k}, (t, 0, x))", "k * (2 - exp(-x) * (x * x + 2 * x + 2))"),
)


@query(
    "SELECT p_partkey, round(value, 6) AS value, round(value, 6) AS canonical_value, g <> 4 AS worked_out FROM (SELECT p_partkey, p_partkey::DOUBLE AS k, p_size / 50.0 AS x, p_partkey % "
    + str(len(INTEGRALS)) + " AS g FROM part) p, LATERAL (SELECT CAST(CASE g " + " ".join(f"WHEN {n} THEN {x[1]}" for n, x in enumerate(INTEGRALS)) + " END AS DOUBLE) AS value)"
)
def integral_values(t, spark):
    """Definite integrals by quadrature, and by their canonical form, which has no integral left where a rule works it out."""
    e, x = by_case(F.col("p_partkey"), [i[0] for i in INTEGRALS]), F.col("p_size") / 50
    form = canonical.canonical_text(e, F.lit("infix"))
    return spread(t("part").select("p_partkey", "p_size")).select("p_partkey", F.round(X.value_at(e, x), 6).alias("value"), F.round(X.value_at(form, x), 6).alias("canonical_value"), (~form.contains("Integral")).alias("worked_out"))


def routed_items(t) -> DataFrame:
    """An equation a part in LaTeX, each with a lambda of its own: three kernels with known solutions, one that isn't separable, one without a solution."""
    k = F.col("p_partkey")
    s = F.col("p_size").cast("string")
    lam = (k % 20011 + 1) / 50000
    kernels = (r"x \cdot t", r"e^{x-t}", r"\frac{x^{2} t^{2}}{2}", r"\sin(x t)", r"1")
    rights = (r"{s} \cdot x", r"{s} e^{x}", r"{s}x^{2}", r"{s}x", r"{s}")
    chosen = lambda options: F.element_at(F.array(*map(F.lit, options)), (k % 5 + 1).cast("int"))
    shrink = F.element_at(F.array(1 - lam / 3, 1 - lam, 1 - lam / 10, F.lit(1.0), F.lit(1.0)), (k % 5 + 1).cast("int"))
    f = F.replace(chosen(rights), F.lit("{s}"), s)
    truth = F.concat(F.lit(r"\frac{"), f, F.lit("}{"), F.format_string("%.17f", shrink), F.lit("}"))
    return spread(t("part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("equation_id"), chosen(kernels).alias("kernel"), f.alias("f"), lam.alias("lambda_val"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"),
        truth.alias("ground_truth"), F.when(k % 5 == 4, "none").otherwise("exact_symbolic").alias("ground_truth_solution_type"),
    )


def routed_answers(items: DataFrame) -> dict[str, DataFrame]:
    """Responses of two models: in tokens right, wrong or denying by key, in words right or wrong."""
    k, truth = F.col("equation_id"), F.col("ground_truth")
    body = F.when(k % 3 == 1, F.concat(truth, F.lit(" + 1"))).otherwise(truth)
    tokens = F.when(k % 3 == 2, F.lit(r"<|T_none|> <|sol|> \text{no} <|end|>")).otherwise(F.concat(F.lit("<|T_exact_symbolic|> <|sol|> "), body, F.lit(" <|end|>")))
    words = F.concat(F.lit("SOLUTION: u(x) = "), F.when(k % 2 == 0, truth).otherwise(F.concat(truth, F.lit(" + x"))), F.lit("\nHAS_SOLUTION: yes\nSOLUTION_TYPE: "), F.when(k % 7 == 0, "family").otherwise("exact_symbolic"))
    return {
        "special": items.select("equation_id", routing.token_answer(tokens).alias("answer")),
        "plain": items.select("equation_id", routing.plain_answer(words).alias("answer")),
    }


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS g, CASE WHEN p_partkey % 5 = 4 THEN 'none' ELSE 'exact_symbolic' END AS kind, p_partkey % 5 IN (0, 1, 2) OR p_partkey % 5 = 4 AS solvable FROM part),
c AS (SELECT 'solver_always' AS configuration, k, g, kind, solvable AS used, true AS says, solvable AS ok, solvable AS known FROM p
  UNION ALL SELECT 'special_solver', k, g, kind, solvable AND k % 3 <> 2, k % 3 <> 2, CASE WHEN k % 3 = 2 THEN false ELSE solvable OR k % 3 = 0 END, k % 3 <> 2 FROM p
  UNION ALL SELECT 'plain_solver', k, g, kind, solvable AND k % 7 <> 0, true, CASE WHEN solvable AND k % 7 <> 0 THEN true ELSE k % 2 = 0 END, true FROM p),
d AS (SELECT configuration, kind, used, CASE WHEN kind = 'none' THEN NOT says ELSE ok END AS ok, kind = 'none' OR known AS known FROM c)
SELECT configuration, kind, count(*) AS results, count(*) FILTER (known) AS evaluated, count(*) FILTER (known AND ok) AS correct, count(*) FILTER (used) AS solver_used FROM d GROUP BY 1, 2""")
def solver_routing(t, spark):
    """Three configurations of answers and solver, each different equation solved once."""
    items = routed_items(t)
    found = written(routing.solutions(items), "solutions")
    rows = routing.configurations(routed_answers(items), items, found)
    scored = scoring.scored(rows, type_tolerances=routing.TYPE_TOLERANCES)
    return scored.groupBy("configuration", "kind").agg(
        F.count("*").alias("results"), F.count_if("evaluated").alias("evaluated"), F.count_if(F.col("evaluated") & F.col("correct")).alias("correct"), F.count_if("solver_used").alias("solver_used")
    )
