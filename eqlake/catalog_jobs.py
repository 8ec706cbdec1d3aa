"""Queries of whole jobs: preparation with faulty rows, tables of runs, answers in prose, series, generated series, and a caller's own strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plugins
from .catalog import by_case, query
from .functions import answers, series
from .functions import expressions as X
from .operators import generators
from .plans import preparation, runs
from .staging import scratch, spread


@query("""WITH r AS (SELECT CASE p_partkey % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'kernel' WHEN 2 THEN 'lambda_val' WHEN 3 THEN 'domain' END AS reason FROM part), n AS (SELECT count(*) AS good FROM r WHERE reason IS NULL)
SELECT 'quarantine' AS stage, reason AS detail, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'equations', NULL, good FROM n
UNION ALL SELECT 'splits', s, CASE s WHEN 'train' THEN floor(0.8 * good + 0.5) WHEN 'val' THEN floor(0.9 * good + 0.5) - floor(0.8 * good + 0.5) ELSE good - floor(0.9 * good + 0.5) END::BIGINT FROM n, (VALUES ('train'), ('val'), ('test')) v(s)
UNION ALL SELECT 'prompts', s, good FROM n, (VALUES ('basic'), ('few-shot')) v(s)""")
def preparation_job(t, spark):
    """CSV lines with faulty ones among them, loaded, set apart, split and rendered by the staged job."""
    k = F.col("p_partkey").cast("string")
    line = F.concat(
        k, F.lit("*x,"), k, F.lit("*x,"), F.when(F.col("p_partkey") % 10 == 1, "").otherwise("x*t"), F.lit(","), F.when(F.col("p_partkey") % 10 == 2, "much").otherwise("0.5"), F.lit(","),
        F.when(F.col("p_partkey") % 10 == 3, "2").otherwise("0"), F.lit(",1"), F.when(F.col("p_partkey") % 10 == 0, ",more,fields").otherwise(""),
    )
    source = scratch(spark, "equations-csv")
    t("part").select(line.alias("value")).write.text(source)
    made = preparation.prepare(spark, source, scratch(spark, "preparation"), "basic,few-shot", header=False)
    counted = lambda rows, stage, detail: rows.groupBy(detail.alias("detail")).agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "detail", "n")
    return (
        counted(made["quarantine"], "quarantine", F.col("reasons")[0])
        .unionByName(counted(made["equations"], "equations", F.lit(None).cast("string")))
        .unionByName(counted(made["splits"], "splits", F.col("split")))
        .unionByName(counted(made["prompts"], "prompts", F.col("style")))
    )


@query("""WITH d AS (SELECT lang, toxic, l.quality = CAST(d.n_chars > 1500 AS INT) AS good FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT lang AS run, round(avg(good::INT), 9) AS accuracy, count(*) AS evaluated, round(avg(good::INT) FILTER (toxic = 0), 9) AS clean, round(avg(good::INT) FILTER (toxic = 1), 9) AS toxic FROM d WHERE lang <> 'es' GROUP BY lang),
r AS (SELECT DISTINCT lang AS run FROM d)
SELECT run, CASE WHEN accuracy IS NULL THEN 'not_run' ELSE 'done' END AS state, evaluated, accuracy, clean, toxic FROM r LEFT JOIN m USING (run)""")
def run_tables(t, spark):
    """Metric files of ragged JSON, one a language, all but one written; the runs joined to them by file, and their accuracy by type."""
    d = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("good", (F.col("quality") == (F.col("n_chars") > 1500).cast("int")).cast("double"))
    kind = lambda n: F.struct(F.round(F.avg(F.when(F.col("toxic") == n, F.col("good"))), 9).alias("accuracy"))
    each = d.where("lang <> 'es'").groupBy("lang").agg(F.count("*").alias("evaluated_count"), F.round(F.avg("good"), 9).alias("accuracy"), F.struct(kind(0).alias("clean"), kind(1).alias("toxic")).alias("per_type"))
    path = scratch(spark, "metrics")
    each.select("lang", F.to_json(F.struct("evaluated_count", "accuracy", "per_type")).alias("value")).write.partitionBy("lang").text(path)
    files = runs.metric_files(spark, path, r"lang=([^/]+)/")
    wanted = d.select(F.col("lang").alias("run"), F.col("lang").alias("file")).distinct()
    one = runs.run_table(wanted, files).select("run", "state", "evaluated", "accuracy")
    by_type = runs.type_table(wanted, files, ["clean", "toxic"]).select("run", "clean", "toxic")
    return one.join(by_type, "run")


RESPONSES = (
    ("We find the result $\\frac{{k} x}{2} + 1$ after some work.", "p_partkey / 2 + 1"),
    ("After integrating, u(x) = {k}*x + x**2 is what remains.", "p_partkey + 1"),
    ("There is no answer here at all, only words; number {k} of them.", "NULL"),
    ("Hence \\[ u(x) = \\sin(x) + {k} \\] which takes {k} steps.", "sin(1) + p_partkey"),
    ("Let K = x*t and f = x. I think it is x^2 + {k} cosh(x) - exp(-x), which can be checked.", "1 + p_partkey * (exp(1) + exp(-1)) / 2 - exp(-1)"),
    ("So the number is {k}.", "NULL"),
)


@query("SELECT p_partkey, round(CASE p_partkey % 6 " + " ".join(f"WHEN {n} THEN ({x[1]})::DOUBLE" for n, x in enumerate(RESPONSES)) + " END, 4) AS at_one FROM part")
def response_answers(t, spark):
    """Answers found in responses that label nothing, by their value at 1."""
    text = by_case(F.col("p_partkey"), [x[0] for x in RESPONSES])
    return spread(t("part").select("p_partkey")).select("p_partkey", F.round(X.value_at(answers.answer_text(text), F.lit(1.0)), 4).alias("at_one"))


@query("""SELECT p_partkey, '1 + ' || (p_partkey + 2) || '*x + O(x**2)' AS total, (p_partkey + 2) || '*x + ' || (2 * (p_partkey + 2) + 1) || '*x**2 + ' || (p_partkey + 4) || '*x**3 + O(x**4)' AS product, '1 + 2*x + x**2' AS polynomial FROM part""")
def series_arithmetic(t, spark):
    """Sums and products of series that are known to an order, a polynomial each part."""
    k = (F.col("p_partkey") + 2).cast("string")
    one = F.lit("1 + 2*x + x**2 + O(x**3)")
    other = F.concat(k, F.lit("*x + x**2 + O(x**5)"))
    total = series.series_sum(F.lit("1 + O(x**2)"), other)
    return spread(t("part").select("p_partkey")).select("p_partkey", total.alias("total"), series.series_product(one, other).alias("product"), series.polynomial(one).alias("polynomial"))


@query("""WITH b AS (SELECT p_brand, count(*) AS k, 0.003::DOUBLE * max(p_size) AS l FROM part GROUP BY 1), g AS (SELECT *, 0.5 AS x FROM b),
v AS (SELECT *, 2 * x + exp(-x) - 2 * exp(x - 1) AS once FROM g),
w AS (SELECT *, 2 * once + x * exp(-x) + (exp(-x) - exp(x - 2)) / 2 - (exp(x - 1) - exp(-x - 1)) - 2 * (1 - x) * exp(x - 1) AS twice FROM v)
SELECT p_brand, round(k * (x + l * once + l * l * twice), 5) AS at_half FROM w""")
def neumann_rows(t, spark):
    """The generated series of a decaying kernel, its function put in and its nested integrals evaluated."""
    b = t("part").groupBy("p_brand").agg(F.concat(F.count("*").cast("string"), F.lit("*x")).alias("f"), (F.max("p_size") / 100).alias("lambda_val"))
    e = b.select("p_brand", "f", F.lit("").alias("u"), "lambda_val", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    rows = generators.augmented(e, "neumann_series").where("augmentation_variant = 'exponential_kernel'")
    return rows.select("p_brand", F.round(X.value_at(generators.applied(F.col("u"), F.col("f")), F.lit(0.5)), 5).alias("at_half"))


@query("""SELECT p_partkey, variant, 10 AS n_points, round(CASE variant WHEN 'exponential_decay' THEN 0.3 * (1 - (b + 1) * exp(-b)) END, 6) AS first_u, round(CASE variant WHEN 'exponential_decay' THEN b + 0.3 * (b - 1 + exp(-b)) END, 6) AS last_u
FROM (SELECT p_partkey, 1 + p_size / 100.0::DOUBLE + (p_partkey % 1009) / 1e5::DOUBLE AS b FROM part), (VALUES ('gaussian_kernel'), ('exponential_decay'), ('sinc_kernel')) v(variant)""")
def discrete_rows(t, spark):
    """Generated equations without a closed solution carry its values at places of their own domain; one kernel's are known."""
    e = spread(t("part").select("p_partkey", "p_size")).select("p_partkey", F.lit("x").alias("f"), F.lit("").alias("u"), F.lit(0.1).alias("lambda_val"), F.lit(0.0).alias("a"), (1 + F.col("p_size") / 100 + (F.col("p_partkey") % 1009) / 1e5).alias("b"))
    rows = generators.with_sample_points(generators.augmented(e, "complex_kernels"))
    p, known = F.col("evaluation_points"), F.col("augmentation_variant") == "exponential_decay"
    return rows.select(
        "p_partkey", F.col("augmentation_variant").alias("variant"), p["n_points"].alias("n_points"), F.round(F.when(known, F.element_at(p["u_values"], 1)), 6).alias("first_u"), F.round(F.when(known, F.element_at(p["u_values"], -1)), 6).alias("last_u"),
    )


def doubled_kernels(equation):
    """A caller's strategy: the equation with its kernel doubled and lambda halved, and with its sides exchanged in sign."""
    yield {"kernel": f"2*({equation['kernel']})", "f": equation["f"], "lambda_val": equation["lambda_val"] / 2, "solution_type": "exact_symbolic"}
    yield {"kernel": equation["kernel"], "f": f"-({equation['f']})", "lambda_val": equation["lambda_val"], "solution_type": "exact_symbolic"}


@query("""SELECT p_partkey, kernel, f, round(lam, 9) AS lambda_val, 'doubled_kernels' AS edge_case FROM (SELECT p_partkey, '2*(x*t)' AS kernel, p_size || '*x' AS f, (p_partkey + 1) / 1e6::DOUBLE / 2 AS lam FROM part
UNION ALL SELECT p_partkey, 'x*t', '-(' || p_size || '*x)', (p_partkey + 1) / 1e6::DOUBLE FROM part)""")
def own_strategy(t, spark):
    """A strategy that a caller registers, used in SQL."""
    plugins.register_strategy(spark, "doubled_kernels", doubled_kernels)
    t("part").createOrReplaceTempView("_eqlake_part")
    rows = spark.sql(
        "SELECT p_partkey, d.kernel, d.f, d.lambda_val, d.edge_case FROM _eqlake_part, "
        "LATERAL doubled_kernels(kernel => 'x*t', f => concat(p_size, '*x'), lambda_val => CAST((p_partkey + 1) / 1e6D AS DOUBLE)) d"
    )
    return rows.withColumn("lambda_val", F.round("lambda_val", 9))


#: Variants of generated rows, their kernel (null: it depends on the row's domain) and right side on a domain from 0 (null: it is the row's own or depends on its end).
VARIANTS = (
    ("constant_kernel_eigenvalue", "1", "x"), ("separable_kernel_eigenvalue", "x*t", "x**2"), ("symmetric_kernel_eigenvalue", "cos(x - t)", "sin(x)"),
    ("even_odd_mismatch", "cos(x) * cos(t)", "x"), ("separable_orthogonal", "sin(pi*x) * sin(pi*t)", "cos(pi*x)"), ("finite_rank_incompatible", "sin(x)*sin(t) + cos(x)*cos(t)", "x**2"),
    ("cauchy_singularity", "1 / (abs(x - t) + 1e-10)", None), ("second_order_pole", "1 / (abs(x - t) + 1e-10)**2", None), ("mixed_smooth_divergent", "(1 + x*t) / (abs(x - t) + 1e-10)", None),
    ("two_disconnected_regions", None, None), ("three_disconnected_regions", None, None),
    ("logarithmic_kernel", "log(abs(x - t) + 1e-10)", None), ("power_law_kernel", "1/sqrt(abs(x - t) + 1e-8)", None), ("algebraic_mixed_kernel", "(x + t + 1) / sqrt(abs(x - t) + 1e-8)", None),
    ("left_exponential_layer", "x * t", "exp(-(x - 0.0)/0.01)"), ("right_exponential_layer", "1 + x + t", None), ("double_tanh_layers", "sin(x) * cos(t)", None),
    ("high_frequency_sine", "x * t", "sin(100.0 * pi * x)"), ("amplitude_modulated", "1 + x + t", "(1 + x) * sin(80.0 * pi * x)"),
    ("multi_frequency_beating", "sin(x) * cos(t)", "sin(100.0 * pi * x) + sin(120.0 * pi * x)"),
    ("piecewise_split", "Piecewise((t, t <= x), (x, True))", None), ("smooth_transition", "tanh((x - t) / 0.1)", None), ("explicit_two_integral", "x*t", None),
    ("band_limited", "Piecewise((x*t, Abs(x - t) < 0.1), (0, True))", None), ("localized_box", None, None),
    ("gaussian_kernel", "exp(-(x**2 + t**2))", "1"), ("exponential_decay", "exp(-abs(x - t))", "x"), ("sinc_kernel", "sin(x*t) / (x*t)", "cos(x)"),
    ("separable_near_eigenvalue", "sin(pi*x) * sin(pi*t)", "sin(pi*x)"), ("constant_near_eigenvalue", "1", "1"), ("very_near_eigenvalue", "sin(pi*x) * sin(pi*t)", "sin(pi*x) + 0.1*sin(2*pi*x)"),
    ("separable_kernel", "sin(x) * cos(t)", None), ("polynomial_kernel", "x * t", None), ("exponential_kernel", "exp(-abs(x - t))", None),
    ("simple_first_kind", "x*t", "x**2"), ("exponential_first_kind", "exp(x*t)", "exp(x)"), ("oscillatory_first_kind", "sin(x - t)", "sin(2*x)"),
    ("separable_eigenvalue_exact", "sin(pi*x) * sin(pi*t)", "0"), ("constant_kernel_resonance", "1", "0"),
)


@query("SELECT variant, (SELECT count(*) FROM part) AS n, kernel, f FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for v in VARIANTS) + ") v(variant, kernel, f)")
def strategy_texts(t, spark):
    """Kernels and right sides of every variant over all equations; null where they differ from row to row."""
    k = F.col("p_partkey").cast("string")
    e = spread(t("part").select("p_partkey")).select(F.concat(k, F.lit("*x + 1")).alias("f"), F.concat(k, F.lit("*x")).alias("u"), F.lit(0.5).alias("lambda_val"), F.lit(0.0).alias("a"), (1 + F.col("p_partkey") / 1000).alias("b"))
    rows = generators.augmented(e, *generators.GROUPS)
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return rows.groupBy(F.col("augmentation_variant").alias("variant")).agg(F.count("*").alias("n"), same("kernel"), same("f"))
