"""Queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .functions import metrics, notation, prompts, terms, text
from .functions import responses as A
from .operators import calls, generators
from .operators import relational as R
from .plans import scoring, solvers
from .staging import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "per_type_accuracy"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        ORACLES[f.__name__] = sql
        return f

    return add


def scored(t) -> DataFrame:
    """Labels against a rule's answer: the scored table of the accuracy queries."""
    docs = t("documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("said"))
    return t("labels").join(docs, "doc_id").withColumnRenamed("quality", "truth")


SCORED = "(SELECT l.doc_id, l.quality AS truth, l.toxic, d.lang, CAST(d.n_chars > 1500 AS INT) AS said FROM labels l JOIN documents d USING (doc_id))"


@query(f"SELECT coalesce(lang, 'unknown') AS solution_type, count(*) AS n, count(*) FILTER (truth = said) AS n_correct, round(count(*) FILTER (truth = said) / count(*), 9) AS accuracy FROM {SCORED} GROUP BY 1")
def per_type_accuracy(t, spark):
    return (
        scored(t)
        .groupBy(F.coalesce("lang", F.lit("unknown")).alias("solution_type"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("said")).alias("n_correct"), F.round(metrics.accuracy(F.col("truth"), F.col("said")), 9).alias("accuracy"))
    )


@query(f"SELECT concat(truth, '_predicted_as_', said) AS cell, count(*) AS n FROM {SCORED} WHERE truth <> said GROUP BY 1")
def confusion_matrix(t, spark):
    return scored(t).where("truth != said").groupBy(F.concat_ws("_predicted_as_", "truth", "said").alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH c AS (SELECT count(*) FILTER (truth = 0 AND said = 0) AS tp, count(*) FILTER (truth = 0 AND said <> 0) AS fn, count(*) FILTER (truth <> 0 AND said = 0) AS fp FROM {SCORED}) SELECT tp, fn, fp, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 9) END AS recall FROM c")
def none_detection(t, spark):
    c = scored(t).agg(F.count_if((F.col("truth") == 0) & (F.col("said") == 0)).alias("tp"), F.count_if((F.col("truth") == 0) & (F.col("said") != 0)).alias("fn"), F.count_if((F.col("truth") != 0) & (F.col("said") == 0)).alias("fp"))
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return c.select("tp", "fn", "fp", F.round(metrics.ratio(tp, tp + fp), 9).alias("precision"), F.round(metrics.ratio(tp, tp + fn), 9).alias("recall"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def composition_rollup(t, spark):
    return t("documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT o_orderstatus, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def value_counts_pct(t, spark):
    return R.shares(t("orders"), "o_orderstatus")


@query("PIVOT (SELECT lang, coalesce(source, 'unknown') AS source FROM documents) ON source USING count(*) GROUP BY lang")
def pivot_counts(t, spark):
    """A column a source, all that there are: their names are read first."""
    named = t("documents").select("lang", F.coalesce("source", F.lit("unknown")).alias("source"))
    return named.groupBy("lang").pivot("source").count().na.fill(0)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def count_distinct_by(t, spark):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT lang, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS mean_chars, round(quantile_cont(n_chars, 0.5), 6) AS median_chars, round(stddev_samp(n_chars), 6) AS std_chars FROM documents GROUP BY lang")
def describe_stats(t, spark):
    c = F.col("n_chars")
    return t("documents").groupBy("lang").agg(F.min(c).alias("min_chars"), F.max(c).alias("max_chars"), F.round(F.avg(c), 6).alias("mean_chars"), F.round(F.percentile(c, 0.5), 6).alias("median_chars"), F.round(F.stddev_samp(c), 6).alias("std_chars"))


@query("SELECT CAST(least(floor((l_quantity - 1) / 49 * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_bins(t, spark):
    return t("lineitem").groupBy(F.least(F.floor((F.col("l_quantity") - 1) / 49 * 40), F.lit(39)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang, count(source) AS source FROM documents")
def column_counts(t, spark):
    return t("documents").agg(*(F.count(c).alias(c) for c in ("doc_id", "text", "lang", "source")))


@query("SELECT event_type, round(avg(value) FILTER (value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)), 6) AS mean_value FROM events GROUP BY 1")
def finite_mean(t, spark):
    return t("events").groupBy("event_type").agg(F.round(metrics.finite_mean(F.col("value")), 6).alias("mean_value"))


@query(f"SELECT round(sum(CAST(truth = said AS INT)) / (SELECT count(*) FROM documents), 9) AS strict_accuracy FROM {SCORED}")
def strict_accuracy(t, spark):
    right = scored(t).agg(F.count_if(F.col("truth") == F.col("said")).alias("r"))
    return right.crossJoin(t("documents").agg(F.count("*").alias("n"))).select(F.round(F.col("r") / F.col("n"), 9).alias("strict_accuracy"))


@query("SELECT event_type AS model, count(*) AS calls, sum(CAST(value AS DECIMAL(18,4))) AS cost FROM events GROUP BY 1")
def cost_breakdown(t, spark):
    return t("events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).alias("cost"))


MD5 = "md5(concat('42|', {0}))"


@query(f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def stratified_sample_k(t, spark):
    return R.stratified_sample(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5)


@query(f"SELECT o_orderkey, CASE WHEN p <= 0.8 THEN 'train' WHEN p <= 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5.format('o_orderkey')}, o_orderkey) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS p FROM orders)")
def stratified_split(t, spark):
    return R.split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "split")


@query(f"SELECT doc_id FROM documents ORDER BY {MD5.format('doc_id')}, doc_id LIMIT 50")
def fixed_sample_n(t, spark):
    return t("documents").select("doc_id").orderBy(R.hash_order("doc_id"), "doc_id").limit(50)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_anti_join(t, spark):
    return R.unseen(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t, spark):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT s_suppkey, coalesce(n, 0) AS n_lines FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON s_suppkey = l_suppkey")
def left_outer_coalesce(t, spark):
    n = t("lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t("supplier").select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT event_id, prev_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id FROM events)")
def asof_previous_event(t, spark):
    from pyspark.sql import Window

    return t("events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev_id"))


@query("""WITH v AS (SELECT c_nationkey AS k, c_acctbal AS x, min(c_custkey)::DOUBLE AS y FROM customer GROUP BY 1, 2), p AS (SELECT s_nationkey AS k, s_acctbal AS x, s_suppkey FROM supplier)
SELECT p.k, p.x, s_suppkey, (SELECT v.y FROM v WHERE v.k = p.k AND abs(v.x - p.x) < 40 ORDER BY abs(v.x - p.x), v.x LIMIT 1) AS nearest_y FROM p""")
def nearest_point_match(t, spark):
    """For each supplier the customer of its nation whose balance is nearest to its own, if one is near."""
    p = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"), "s_suppkey")
    v = t("customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x")).agg(F.min("c_custkey").cast("double").alias("y"))
    return R.nearest(p, v, "k", "x", "y", 40.0)


@query("SELECT item_id, style FROM benchmark CROSS JOIN (VALUES ('basic'), ('chain-of-thought'), ('few-shot'), ('tool-assisted')) s(style)")
def cross_join_styles(t, spark):
    styles = F.array(*map(F.lit, ("basic", "chain-of-thought", "few-shot", "tool-assisted")))
    return t("benchmark").select("item_id", F.explode(styles).alias("style"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_per_group(t, spark):
    return R.best(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2 HAVING count(*) > 1)) WHERE rn = 1")
def majority_vote(t, spark):
    return R.majority(t("events"), "user_id", "event_type")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def topk_values(t, spark):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_missing_columns(t, spark):
    return R.union_all(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(t, spark):
    return t("documents").select("doc_id").exceptAll(t("labels").select("doc_id")).distinct()


@query("SELECT count(DISTINCT concat_ws('_', lang, source)) AS strata FROM documents")
def distinct_strata(t, spark):
    return t("documents").agg(F.count_distinct(F.concat_ws("_", "lang", "source")).alias("strata"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substring(text, 1, 80), '...') ELSE text END AS short FROM documents WHERE lang = 'en'")
def truncate_text(t, spark):
    return t("documents").where("lang = 'en'").select("doc_id", text.shortened(F.col("text")).alias("short"))


@query("SELECT p_partkey FROM part WHERE greatest(coalesce(p_size, 0), 0) <= 10")
def filter_max_degree(t, spark):
    return t("part").where(F.greatest(F.coalesce("p_size", F.lit(0)), F.lit(0)) <= 10).select("p_partkey")


@query("SELECT conv_id, turn, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM conversations")
def prompt_lengths(t, spark):
    return t("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))


@query("SELECT l_returnflag, round(avg(abs(p)), 6) AS mae, round(max(abs(p)), 6) AS max_error, round(sqrt(avg(p * p)), 6) AS rmse, round(sqrt(sum(p * p)) / sqrt(sum(l_extendedprice * l_extendedprice)), 9) AS rel_l2 FROM (SELECT *, l_extendedprice * (1 - l_discount) - l_extendedprice AS p FROM lineitem) GROUP BY 1")
def error_norms(t, spark):
    norms = metrics.error_norms(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"))
    return t("lineitem").groupBy("l_returnflag").agg(*(F.round(v, 9 if k == "rel_l2" else 6).alias(k) for k, v in norms.items()))


def by_case(key, texts):
    """A column of texts in which {k} is the key's number, chosen by the key."""
    k = key.cast("string")
    out = None
    for n, text in enumerate(texts):
        parts = [F.lit(p) for p in text.split("{k}")]
        filled = parts[0] if len(parts) == 1 else F.concat(*(x for p in parts[:-1] for x in (p, k)), parts[-1])
        out = F.when(key % len(texts) == n, filled) if out is None else out.when(key % len(texts) == n, filled)
    return out


def sql_case(texts) -> str:
    """The same in SQL, over p_partkey; None is null."""
    each = ("NULL" if x is None else "'" + x.replace("{k}", "' || p_partkey || '") + "'" for x in texts)
    return f"CASE p_partkey % {len(texts)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(each)) + " END"


EXPRESSIONS = ("{k}x + 3.5t", "exp({k}x)*t", "sinh({k}x)", "cos(x - {k}t)", "x {k} ^ x sin +", "\\frac{x}{{k}}", "{k}", "x**2 + {k}*x*t")


@query(
    rf"SELECT p_partkey, e AS expr, regexp_replace(e, '(\d+\.?\d*(?:[eE][+-]?\d+)?)([a-zA-Z])', '\1*\2', 'g') AS fixed, CASE WHEN regexp_matches(lower(e), 'exp|e\*\*|e\^') THEN 'exponential' WHEN regexp_matches(lower(e), 'sinh|cosh|tanh') THEN 'hyperbolic' WHEN regexp_matches(lower(e), 'sin|cos|tan') THEN 'trigonometric' WHEN regexp_matches(lower(e), '[xt]') THEN 'polynomial' ELSE 'real_value' END AS kind, CASE WHEN regexp_matches(trim(e), '^[^()\\]*\s([-+*/^]|sin|cos|tan|exp|log|sqrt|neg)$') THEN 'rpn' WHEN regexp_matches(trim(e), '\\[a-zA-Z]+|[\^_]\{{') THEN 'latex' ELSE 'infix' END AS notation FROM (SELECT p_partkey, {sql_case(EXPRESSIONS)} AS e FROM part)"
)
def expression_functions(t, spark):
    c = F.col("expr")
    e = t("part").select("p_partkey", by_case(F.col("p_partkey"), EXPRESSIONS).alias("expr"))
    return e.select("p_partkey", "expr", text.explicit_product(c).alias("fixed"), text.expression_type(c).alias("kind"), notation.notation(c).alias("notation"))


CONVERTED = (
    ("{k}x + 3.5t", "{k} x * 3.5 t * +", "{k} \\cdot x + 3.5 \\cdot t", "{k}*x + 3.5*t"),
    ("sin(x)**2/{k}", "x sin 2 ^ {k} /", "\\frac{\\sin(x)^{2}}{{k}}", "math.sin(x)**2/{k}"),
    ("-x**2*(t - {k})", "x 2 ^ neg t {k} - *", "-x^{2} \\cdot (t - {k})", "-x**2*(t - {k})"),
    ("{k} + (", None, None, None),
    ("Integral(exp(x*t), (t, 0, {k}))", "x t * exp 0 {k} t int", "\\int_{0}^{{k}} e^{x \\cdot t} \\, dt", "Integral(math.exp(x*t), (t, 0, {k}))"),
)


@query("SELECT p_partkey, " + ", ".join(f"{sql_case([c[n] for c in CONVERTED])} AS {name}" for n, name in enumerate(("expr", "rpn", "latex", "python"))) + " FROM part")
def notation_convert(t, spark):
    e = spread(t("part").select("p_partkey")).select("p_partkey", by_case(F.col("p_partkey"), [c[0] for c in CONVERTED]).alias("expr"))
    return e.select("p_partkey", "expr", *(X.convert("expr", F.lit("infix"), F.lit(k)).alias(k) for k in ("rpn", "latex", "python")))


def equations(t) -> DataFrame:
    """An equation a part, with a lambda of its own: kernel x t on [0, 1], f = size x; so u = 3 f / (3 - lambda)."""
    f = F.concat(F.col("p_size").cast("string"), F.lit("*x"))
    return spread(t("part").select("p_partkey", "p_brand", "p_size")).select("p_partkey", "p_brand", F.lit("x*t").alias("kernel"), f.alias("f"), ((F.col("p_partkey") % 20011 + 1) / 25000).alias("lam"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))


@query("SELECT p_partkey, round(p_size * 3 / (3 - (p_partkey % 20011 + 1) / 25000.0::DOUBLE), 6) AS at_one FROM part")
def separable_solutions(t, spark):
    u = X.separable_solution("kernel", "f", "lam", "a", "b")
    return equations(t).select("p_partkey", F.round(X.value_at(u, F.lit(1.0)), 6).alias("at_one"))


# f in place of the solution leaves lambda f / 3, which is largest near 1
@query("SELECT p_brand, count(*) AS n, count(*) AS n_verified, count(*) FILTER (l * p_size / 3 < 0.05) AS n_wrong_small FROM (SELECT *, (p_partkey % 20011 + 1) / 25000.0::DOUBLE AS l FROM part) GROUP BY 1")
def residual_check(t, spark):
    rest = ("kernel", "f", "lam", "a", "b")
    at_end = X.value_at("f", F.lit(1.0)) * F.col("lam") / 3
    e = equations(t).select("p_brand", X.max_residual(X.separable_solution(*rest), *rest).alias("own"), X.max_residual("f", *rest).alias("wrong"), at_end.alias("known"))
    # seeded points come near 1 but don't reach it
    small = (F.col("known") < 0.05) & (F.col("wrong") <= F.col("known")) & (F.col("wrong") >= 0.9 * F.col("known"))
    return e.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("own") < 1e-6).alias("n_verified"), F.count_if(small).alias("n_wrong_small"))


@query("SELECT p_partkey, round(abs(p_size - p_retailprice), 6) AS max_error FROM part")
def grid_max_error(t, spark):
    pred, truth = (F.concat(F.col(c).cast("string"), F.lit("*x")) for c in ("p_size", "p_retailprice"))
    return spread(t("part").select("p_partkey", "p_size", "p_retailprice")).select("p_partkey", F.round(X.max_error(pred, truth, F.lit(0.0), F.lit(1.0)), 6).alias("max_error"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.333333 WHEN 1 THEN 1.0 ELSE 0.0 END AS op_precision, CASE p_partkey % 3 WHEN 2 THEN 0.0 ELSE 1.0 END AS op_recall, CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END AS op_f1 FROM part")
def operator_scores(t, spark):
    k = F.col("p_partkey")
    pred, truth = by_case(k, ("x**{k} + sin(x)", "{k}", "cos({k})")), by_case(k, ("sin({k})", "t", "exp({k})"))
    e = t("part").select("p_partkey", X.operator_set(pred).alias("p"), X.operator_set(truth).alias("q"))
    return e.select("p_partkey", *(F.round(v, 6).alias(k.replace("set_", "op_")) for k, v in metrics.set_scores(F.col("p"), F.col("q")).items()))


@query(
    "WITH e AS (SELECT p_partkey, -(p_partkey % 2)::DOUBLE AS a, p_size::DOUBLE AS b FROM part) SELECT p_partkey, v AS variant, kernel, f, k AS solution_type, round(CASE n WHEN 1 THEN 1 / (b - a) WHEN 2 THEN 3 / (b * b * b - a * a * a) ELSE c END, 9) AS lambda_val FROM e, "
    "(VALUES (1, 'constant_kernel_eigenvalue', '1', 'x', 'none', 0::DOUBLE), (2, 'separable_kernel_eigenvalue', 'x*t', 'x**2', 'none', 0), (3, 'symmetric_kernel_eigenvalue', 'cos(x - t)', 'sin(x)', 'none', 1), (4, 'simple_first_kind', 'x*t', 'x**2', 'regularized', 0), (5, 'exponential_first_kind', 'exp(x*t)', 'exp(x)', 'regularized', 0), (6, 'oscillatory_first_kind', 'sin(x - t)', 'sin(2*x)', 'regularized', 0)) t(n, v, kernel, f, k, c) WHERE n <> 2 OR a >= 0"
)
def augment_templates(t, spark):
    e = t("part").select("p_partkey", (-(F.col("p_partkey") % 2)).cast("double").alias("a"), F.col("p_size").cast("double").alias("b"), F.lit(0.1).alias("lambda_val"))
    out = generators.augmented(e, "eigenvalue_cases", "ill_posed")
    return out.select("p_partkey", F.col("augmentation_variant").alias("variant"), "kernel", "f", "solution_type", F.round("lambda_val", 9).alias("lambda_val"))


def responses(t) -> DataFrame:
    """A response an order: a labelled answer, prose, points, or a denial, by its key."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    return spread(t("orders").select("o_orderkey")).select(
        "o_orderkey",
        F.when(k % 4 == 0, F.concat(F.lit("Step 1: integrate\nStep 2: solve\nHAS_SOLUTION: Yes\nSOLUTION: u(x) = "), s, F.lit("*x\nSOLUTION_TYPE: exact_symbolic")))
        .when(k % 4 == 1, F.concat(F.lit("Therefore, u(x) = $"), s, F.lit("*x + 1$.\nThat is all.")))
        .when(k % 4 == 2, F.concat(F.lit("Solution type: discrete-points\n: [(0, 1), (1e-1, "), s, F.lit("), (1, -2.5)]")))
        .otherwise("The kernel makes this inconsistent; it does not admit one.")
        .alias("response"),
    )


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '*x' WHEN 1 THEN o_orderkey || '*x + 1' END AS solution, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 3 THEN false END AS has_solution, CASE o_orderkey % 4 WHEN 0 THEN 'exact_symbolic' WHEN 2 THEN 'discrete_points' END AS solution_type, "
    "CASE WHEN o_orderkey % 4 = 2 THEN 3 END AS n_points, CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey::DOUBLE END AS second_y, CASE WHEN o_orderkey % 4 = 0 THEN 'integrate' END AS first_step, CASE o_orderkey % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 ELSE 0.0 END AS confidence FROM orders"
)
def parse_responses(t, spark):
    a = responses(t).select("o_orderkey", A.answer(F.col("response")).alias("a"))
    readable = F.coalesce(X.readable("a.solution"), F.lit(False))
    return a.select(
        "o_orderkey", "a.solution", "a.has_solution", "a.solution_type", F.size("a.points").alias("n_points"), F.element_at("a.points", 2)["y"].alias("second_y"),
        F.substring_index("a.reasoning", "\n", 1).alias("first_step"), A.confidence(F.col("a"), readable).alias("confidence"),
    )


@query(
    "SELECT p_partkey, style, length(head || E'\\n\\nSolve the following Fredholm integral equation:\\n\\nu(x) - 0.5 * ∫[0, 1] (x*t) u(t) dt = ' || p_size || E'*x\\n\\nDomain: [0, 1]\\n\\nProvide the solution u(x).') AS n_chars, hint FROM "
    "(SELECT *, '[Has solution: ' || CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END || ', Type: ' || p_type || ']' AS hint FROM part) p, (VALUES "
    + ", ".join(f"('{k}', '{(v.format(notation='infix') + ''.join(chr(10) * 2 + x for x in prompts.EXAMPLES if k == 'few-shot') + chr(10) + prompts.REMARKS).replace(chr(39), chr(39) * 2)}')" for k, v in prompts.SYSTEM.items())
    + ") s(style, head)"
)
def render_prompts(t, spark):
    e = t("part").select(
        F.col("p_partkey").alias("equation_id"), F.lit("x*t").alias("kernel"), F.concat(F.col("p_size").cast("string"), F.lit("*x")).alias("f"), F.lit(0.5).alias("lambda_val"), F.lit(0).alias("a"), F.lit(1).alias("b"),
        (F.col("p_size") % 2 == 0).alias("has_solution"), F.col("p_type").alias("solution_type"),
    )
    p = prompts.prompts(e, "all", mode="hints")
    hint = F.substring_index("prompt", "\n", -1)
    return p.select(F.col("equation_id").alias("p_partkey"), "style", (F.length("prompt") - F.length(hint) - 1).cast("long").alias("n_chars"), hint.alias("hint"))


@query(
    "WITH c AS (SELECT event_type AS model, user_id % 2 AS provider, (event_id % 5000)::BIGINT AS tp, (event_id % 700)::BIGINT AS tc FROM events) SELECT provider, model, count(*) AS calls, sum(tp)::BIGINT AS prompt_tokens, sum(tc)::BIGINT AS completion_tokens, "
    "sum(CASE WHEN model = 'click' THEN tp * 25 + tc * 100 ELSE 0 END) / 1e7 AS cost FROM c GROUP BY ROLLUP (provider, model)"
)
def call_costs(t, spark):
    c = t("events").select(F.col("event_type").alias("model"), (F.col("user_id") % 2).alias("provider"), (F.col("event_id") % 5000).alias("prompt_tokens"), F.lit(0).alias("cached_tokens"), (F.col("event_id") % 700).alias("completion_tokens"))
    prices = spark.sql("SELECT 'click' AS model, 2.5 AS input, 1.25 AS cached, 10.0 AS output")
    out = calls.cost_summary(calls.priced(c, prices))
    return out.select("provider", "model", "calls", "prompt_tokens", "completion_tokens", F.col("total_cost_usd").cast("double").alias("cost"))


@query(
    "SELECT p_partkey, 2 AS terms_compared, CASE WHEN d / s <= 0.1 THEN 1.0 ELSE 0.5 END AS match_rate, d AS max_abs_error, round(d / s, 9) AS max_rel_error, d / s <= 0.1 AS match FROM (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 9)::DOUBLE AS d FROM part)"
)
def coefficient_match(t, spark):
    s, d = F.col("p_size"), F.col("p_partkey") % 9
    pred = F.concat((s + d).cast("string"), F.lit("*x*x - 2*sin(x) + exp(x)"))
    truth = F.concat(F.lit("-sin(x)*2 + "), s.cast("string"), F.lit("*x**2"))
    e = t("part").select("p_partkey", terms.coefficients(pred).alias("p"), terms.coefficients(truth).alias("q"))
    e = e.select("p_partkey", terms.coefficient_scores(F.col("p"), F.col("q")).alias("c"))
    return e.select("p_partkey", "c.terms_compared", "c.match_rate", "c.max_abs_error", F.round("c.max_rel_error", 9).alias("max_rel_error"), "c.match")


@query(
    "SELECT o_orderkey, 5 - k AS matched_points, (5 - k) / 5 AS accuracy, k <= 1 AS match, CASE WHEN k > 0 THEN 0.5 ELSE 0.0 END AS max_error, round(k * 0.5 / 5, 9) AS mae FROM (SELECT o_orderkey, (o_orderkey % 5)::INT AS k FROM orders)"
)
def point_list_scores(t, spark):
    k = (F.col("o_orderkey") % 5).cast("int")
    truth = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i / 4).alias("x"), i.cast("double").alias("y")))
    pred = F.transform(truth, lambda p: F.struct((p["x"] + 0.0005).alias("x"), F.when(p["y"] < k, p["y"] + 0.5).otherwise(p["y"]).alias("y")))
    e = t("orders").select("o_orderkey", terms.point_scores(pred, truth).alias("s"))
    return e.select("o_orderkey", "s.matched_points", "s.accuracy", "s.match", "s.max_error", F.round("s.mae", 9).alias("mae"))


@query(
    "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 3 <> 0 AND p_partkey % 4 <> 0) AS n_valid, count(*) FILTER (p_size % 3 = 0) AS n_bad_kernel, count(*) FILTER (p_partkey % 4 = 0) AS n_bad_domain FROM part GROUP BY 1"
)
def validate_equations(t, spark):
    e = t("part").select(
        "p_brand", F.when(F.col("p_size") % 3 == 0, "x*(t").otherwise("x*t").alias("kernel"), F.lit("x**2").alias("f"), F.col("p_size").cast("string").alias("lambda_val"),
        F.when(F.col("p_partkey") % 4 == 0, 2.0).otherwise(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit("x").alias("solution"),
    )
    has = lambda text: F.count_if(F.exists("errors", lambda m: m.startswith(text)))
    return terms.checked(e).groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), has("Invalid kernel").alias("n_bad_kernel"), has("Invalid domain").alias("n_bad_domain"))


def predictions(t) -> DataFrame:
    """A prediction a part, of each type of solution in turn, right or wrong by its key."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    kinds = F.array(*map(F.lit, ("exact_symbolic", "none", "regularized", "family", "series", "approx_coef", "discrete_points")))
    even, kind = k % 2 == 0, F.get(kinds, (k % 7).cast("int"))
    points = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i / 4).alias("x"), i.cast("double").alias("y")))
    said = F.transform(points, lambda p: F.struct(p["x"].alias("x"), F.when(even | (p["y"] == 4), p["y"]).otherwise(p["y"] + 0.5).alias("y")))
    pick = lambda **by: F.coalesce(*(F.when(kind == name, c) for name, c in by.items()))
    return spread(t("part").select("p_partkey", "p_size")).select(
        k.alias("equation_id"),
        kind.alias("ground_truth_solution_type"),
        F.when((kind == "regularized") & (k % 3 == 1), "series").otherwise(kind).alias("solution_type"),
        (kind != "none").alias("ground_truth_has_solution"),
        F.when(kind == "none", k % 3 != 0).otherwise(k % 11 != 0).alias("has_solution"),
        pick(exact_symbolic=F.concat(s, F.lit("*x")), family=F.concat(s, F.lit("*C*x")), series=F.lit("1 + x + x**2/2 + x**3/6"), approx_coef=F.concat(s, F.lit("*x + 1"))).alias("ground_truth"),
        pick(
            exact_symbolic=F.when(k % 5 == 0, F.concat(s, F.lit("*x + ("))).when(even, F.concat(F.lit("x*"), s)).otherwise(F.concat(s, F.lit("*x + 0.5"))),
            family=F.when(even, "c_1*x").otherwise("x**2"),
            series=F.when(even, "x**3/6 + x**2/2 + x + 1").otherwise("1 + x + x**2/2"),
            approx_coef=F.concat(F.when(k % 4 == 0, "").when(even, "1.05*").otherwise("1.5*"), s, F.lit("*x + 1")),
        ).alias("solution_str"),
        F.when(kind == "exact_symbolic", "x*t").alias("ground_truth_kernel"),
        F.when(kind == "exact_symbolic", F.concat(s, F.lit("*x*0.9"))).alias("ground_truth_f"),
        F.when(kind == "exact_symbolic", 0.3).alias("ground_truth_lambda"),
        F.when(kind == "discrete_points", points).alias("gt_points"),
        F.when(kind == "discrete_points", said).alias("pred_points"),
    )


PREDICTIONS = """p AS (SELECT *, ['exact_symbolic', 'none', 'regularized', 'family', 'series', 'approx_coef', 'discrete_points'][p_partkey % 7 + 1] AS kind, p_partkey % 2 = 0 AS even,
  p_partkey % 7 = 0 AND p_partkey % 5 = 0 AS bad, CASE WHEN p_partkey % 7 = 1 THEN p_partkey % 3 <> 0 ELSE p_partkey % 11 <> 0 END AS says FROM part),
q AS (SELECT *, NOT bad AS known, CASE kind WHEN 'none' THEN NOT says WHEN 'regularized' THEN p_partkey % 3 <> 1 WHEN 'approx_coef' THEN p_partkey % 4 = 0 ELSE even END AS ok,
  CASE WHEN bad THEN NULL WHEN kind = 'exact_symbolic' THEN CASE WHEN even THEN 0.0 ELSE 0.5 END WHEN kind = 'series' THEN CASE WHEN even THEN 0.0 ELSE 1 / 6.0 END
    WHEN kind = 'approx_coef' THEN CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN even THEN 0.05 ELSE 0.5 END * p_size END AS worst FROM p)"""


@query(f"""WITH {PREDICTIONS}, r AS (SELECT kind, count(*) AS results, count(*) FILTER (known) AS total, count(*) FILTER (known AND ok) AS correct, count(*) FILTER (bad) AS parse_errors,
  count(*) FILTER (kind = 'none' AND NOT says) AS none_tp, count(*) FILTER (kind <> 'none' AND NOT says) AS none_fp, count(*) FILTER (kind = 'none' AND says) AS none_fn,
  count(*) FILTER ((kind <> 'none') = says) AS said_right, count(*) FILTER (NOT (kind = 'regularized' AND p_partkey % 3 = 1)) AS typed_right,
  count(*) FILTER (kind = 'series') AS series_total, count(*) FILTER (kind = 'series' AND even) AS series_match, avg(CASE WHEN even THEN 4 ELSE 3 END) FILTER (kind = 'series') AS series_mean,
  count(*) FILTER (kind = 'approx_coef') AS coef_total, avg(CASE WHEN even THEN 1 ELSE 0.5 END) FILTER (kind = 'approx_coef') AS coef_match_rate, avg(CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN even THEN 0.025 ELSE 0.25 END) FILTER (kind = 'approx_coef') AS coef_rel_error,
  count(*) FILTER (kind = 'discrete_points') AS points_total, avg(CASE WHEN even THEN 1 ELSE 0.2 END) FILTER (kind = 'discrete_points') AS matched_point_rate,
  count(*) FILTER (kind = 'family') AS family_total, avg(CASE WHEN even THEN 1 ELSE 0 END) FILTER (kind = 'family') AS param_count_match_rate,
  count(*) FILTER (kind = 'exact_symbolic' AND known) AS residual_total, count(*) FILTER (kind = 'exact_symbolic' AND known AND even) AS verified_count, avg(worst) AS mean_worst FROM q GROUP BY ROLLUP (kind))
SELECT coalesce(kind, 'all') AS solution_kind, results, total, correct, parse_errors, round(correct / total, 9) AS accuracy, round(said_right / results, 9) AS has_solution_accuracy, round(typed_right / results, 9) AS solution_type_accuracy,
  none_tp, none_fp, none_fn, round(CASE WHEN none_tp = 0 THEN 0 ELSE 2 * none_tp / (2 * none_tp + none_fp + none_fn) END, 9) AS none_f1, series_total, series_match, round(series_mean, 9) AS series_mean,
  coef_total, round(coef_match_rate, 9) AS coef_match_rate, round(coef_rel_error, 9) AS coef_rel_error, points_total, round(matched_point_rate, 9) AS matched_point_rate,
  family_total, round(param_count_match_rate, 9) AS param_count_match_rate, residual_total, verified_count, round(mean_worst, 6) AS mean_worst FROM r""")
def score_report(t, spark):
    rows = scoring.scored(predictions(t))
    # a family's largest error depends on its sample constants, and other types have none here
    rows = rows.withColumn("max_error", F.when(F.col("kind").isin("exact_symbolic", "series", "approx_coef"), F.col("max_error")))
    r = scoring.report(rows)
    plain = ("solution_kind", "results", "total", "correct", "parse_errors", "none_tp", "none_fp", "none_fn", "series_total", "series_match", "coef_total", "points_total", "family_total", "residual_total", "verified_count")
    rounded = ("accuracy", "has_solution_accuracy", "solution_type_accuracy", "none_f1", "series_mean", "coef_match_rate", "coef_rel_error", "matched_point_rate", "param_count_match_rate")
    return r.select(*plain, *(F.round(c, 9).alias(c) for c in rounded), F.round("mean_max_error", 6).alias("mean_worst"))


@query(f"WITH {PREDICTIONS} SELECT p_partkey AS equation_id, CASE WHEN known THEN ok END AS correct FROM q")
def score_rows(t, spark):
    return scoring.scored(predictions(t)).select("equation_id", "correct")


STRATEGY_ROWS = ", ".join(
    f"('{name}', '{x.kind}', '{x.variant}', {x.lam.replace('lambda_val', 'l').replace('D', '').replace('if(b = a, 1.0, 1 / (b - a))', '1 / (b - a)').replace('if(b = a, 1.0, 3 / (b * b * b - a * a * a))', '3 / (b * b * b - a * a * a)')}, {str(x.u == '').lower()})"
    for name, rows in generators.STRATEGIES.items() for x in rows
)


@query(f"""SELECT augmentation_type, variant, kind AS solution_type, count(*) AS n, round(sum(lam), 6) AS lambda_sum, count(*) FILTER (no_u) AS n_without_u FROM (SELECT p_size::DOUBLE AS b, 0.0::DOUBLE AS a, p_retailprice / 1000 AS l FROM part) e,
  LATERAL (VALUES {STRATEGY_ROWS}) v(augmentation_type, kind, variant, lam, no_u) GROUP BY ALL""")
def augment_strategies(t, spark):
    e = spread(t("part").select("p_size", "p_retailprice")).select(F.lit(0.0).alias("a"), F.col("p_size").cast("double").alias("b"), (F.col("p_retailprice") / 1000).alias("lambda_val"), F.lit("x").alias("f"), F.lit("x**2").alias("u"))
    out = generators.augmented(e, *generators.GROUPS)
    return out.groupBy("augmentation_type", F.col("augmentation_variant").alias("variant"), "solution_type").agg(F.count("*").alias("n"), F.round(F.sum("lambda_val"), 6).alias("lambda_sum"), F.count_if(F.col("u") == "").alias("n_without_u"))


@query("""WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), g AS (SELECT *, n // 2 AS wanted, i * 13 AS ahead FROM o)
SELECT origin, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT 'original' AS origin, p_partkey FROM o
  UNION ALL SELECT 'family', p_partkey FROM g, range(2) WHERE ahead < wanted UNION ALL SELECT 'none', p_partkey FROM g, range(11) WHERE ahead + 2 < wanted) GROUP BY 1""")
def augment_to_size(t, spark):
    """Two rows of an equation for families, then eleven without a solution, until there are half as many again as originals."""
    e = spread(t("part").select("p_partkey")).select("p_partkey", F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.5).alias("lambda_val"), F.lit("x").alias("f"), F.lit("x").alias("u"))
    out = generators.augment_dataset(e, "p_partkey", ("family", "none_solution"), 1.5)
    return out.groupBy(F.when(F.col("augmented"), F.col("solution_type")).otherwise("original").alias("origin")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@query("SELECT p_partkey, 53 AS n_points, round(p_size * (SELECT sum(y * y) FROM (SELECT i / 49.0 AS y FROM range(50) r(i) UNION ALL SELECT unnest([0.5, 0.1, 0.9]))) + 53 * 1, 6) AS u_sum FROM part")
def evaluation_points(t, spark):
    e = spread(t("part").select("p_partkey", "p_size")).select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("*x**2 + 1")).alias("u"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(True).alias("has_solution"), F.lit("exact_symbolic").alias("solution_type"))
    p = generators.with_evaluation_points(e).select("p_partkey", "evaluation_points.n_points", F.aggregate("evaluation_points.u_values", F.lit(0.0), lambda s, v: s + v).alias("s"))
    return p.select("p_partkey", "n_points", F.round("s", 6).alias("u_sum"))


@query(r"""SELECT p_partkey, 'u(x) - 0.5 * ∫[0,' || p_size || '] (x*t) u(t) dt = ' || p_size || '*x' AS infix, 'u(x) - 0.5 \int_{0}^{' || p_size || '} x \cdot t \, u(t) \, dt = ' || p_size || ' \cdot x' AS latex,
  'u x ' || p_size || ' x * = x t * u t * 0.5 * 0 ' || p_size || ' ∫ -' AS rpn, 'u ( x ) - <LAMBDA> 0.5 <INT> <LOWER> 0 <UPPER> ' || p_size || ' x * t u ( t ) dt <SEP> ' || p_size || ' * x' AS tokenized,
  'u(x) = ' || p_size || '*x + (0.5)^1 * ∫[0,' || p_size || '] K^1(x,t) f(t) dt + O(λ^2)' AS neumann FROM part""")
def equation_texts(t, spark):
    f, b = F.concat(F.col("p_size").cast("string"), F.lit("*x")), F.col("p_size")
    parts = (F.lit("x*t"), f, F.lit("0.5"), F.lit(0), b)
    return t("part").select("p_partkey", *(notation.equation(*parts, k).alias(k) for k in ("infix", "latex", "rpn", "tokenized")), notation.neumann_text(f, F.lit("x*t"), F.lit(0.5), F.lit(0), b, 2).alias("neumann"))


@query("""SELECT p_brand, CASE WHEN i >= l AND i >= r THEN 'infix' WHEN l >= r THEN 'latex' ELSE 'rpn' END AS notation FROM (
  SELECT p_brand, count(*) FILTER (p_size % 3 = 0) * 2 AS i, count(*) FILTER (p_size % 3 = 1) * 2 AS l, count(*) FILTER (p_size % 3 = 2) * 2 AS r FROM part GROUP BY 1)""")
def file_notations(t, spark):
    k, s = F.col("p_size") % 3, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(s, F.lit("*x + sin(x)"))).when(k == 1, F.concat(F.lit("\\frac{x}{"), s, F.lit("}"))).otherwise(F.concat(F.lit("x "), s, F.lit(" ^")))
    return notation.notation_of_rows(t("part").select("p_brand", text.alias("u"), text.alias("f")), "p_brand")


@query("""WITH e AS (SELECT p_partkey, p_partkey % 4 AS g, p_size::DOUBLE AS s, (p_partkey % 20011 + 1) / 100000.0::DOUBLE AS l FROM part) SELECT p_partkey, round(CASE g WHEN 0 THEN s * 3 / (3 - l) WHEN 1 THEN s / (1 - 2 * l) WHEN 2 THEN s / (1 - l / 5) ELSE s * exp(1) / (1 - l) END, 6) AS at_one,
  NOT (g = 1 AND abs(1 - 2 * l) < 1e-9) AS solved, NOT (g = 1 AND abs(1 - 2 * l) < 1e-9) AS own_verified, false AS f_verified FROM e""")
def varied_equations(t, spark):
    """Four kernels on three domains, with what is known of their solutions."""
    g, s = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    e = spread(t("part").select("p_partkey", "p_size")).select(
        "p_partkey", F.when(g == 0, "x*t").when(g == 1, "1").when(g == 2, "x**2*t**2").otherwise("exp(x - t)").alias("kernel"),
        F.when(g == 0, F.concat(s, F.lit("*x"))).when(g == 1, s).when(g == 2, F.concat(s, F.lit("*x**2"))).otherwise(F.concat(s, F.lit("*exp(x)"))).alias("f"),
        ((F.col("p_partkey") % 20011 + 1) / 100000).alias("lam"), F.when(g == 1, -1.0).otherwise(0.0).alias("a"), F.lit(1.0).alias("b"),
    )
    rest = ("kernel", "f", "lam", "a", "b")
    e = e.withColumn("u", X.separable_solution(*rest))
    out = e.select("p_partkey", X.value_at("u", F.lit(1.0)).alias("at_one"), F.col("u").isNotNull().alias("solved"), X.max_residual("u", *rest).alias("own"), X.max_residual("f", *rest).alias("wrong"))
    return out.select("p_partkey", F.round("at_one", 6).alias("at_one"), "solved", (F.col("own") < 1e-6).alias("own_verified"), (F.col("wrong") < 1e-6).alias("f_verified"))


@query("""SELECT split, CASE WHEN g = 1 THEN solution_type END AS solution_type, CASE WHEN g = 2 THEN edge_case END AS edge_case, rows, originals, rows - originals AS augmented, round((rows - originals) / rows, 9) AS ratio FROM (
  SELECT split, solution_type, edge_case, GROUPING(split, solution_type, edge_case) AS g, count(*) AS rows, count(*) FILTER (k % 3 <> 0) AS originals FROM (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, o_orderpriority AS solution_type, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'P' THEN o_orderstatus END AS edge_case FROM orders)
  GROUP BY GROUPING SETS ((split), (split, solution_type), (split, edge_case))) WHERE g = 3 OR (g = 1 AND solution_type IS NOT NULL) OR (g = 2 AND edge_case IS NOT NULL)""")
def split_statistics(t, spark):
    k = F.col("o_orderkey")
    rows = t("orders").select(
        F.when(k % 10 < 8, "train").when(k % 10 == 8, "val").otherwise("test").alias("split"), F.col("o_orderpriority").alias("solution_type"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" ").alias("edge_case"), (k % 3 == 0).alias("augmented"),
    )
    return R.split_statistics(rows).withColumn("ratio", F.round("ratio", 9)).drop("level")


@query(f"SELECT o_orderkey, CASE WHEN rn <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MD5.format('o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)")
def quota_split(t, spark):
    return R.quotas(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "split")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 OR (rn = 2 AND o_orderpriority = '1-URGENT')")
def pilot_subset(t, spark):
    return R.pilot(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "1-URGENT").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE round(l_discount, 6) NOT IN (SELECT round(p_size / 100.0, 6) FROM part WHERE p_size <= 5)")
def without_leaks(t, spark):
    test = t("part").where("p_size <= 5").select((F.col("p_size") / 100).alias("l_discount"))
    return R.without_leaks(t("lineitem").select("l_orderkey", "l_linenumber", "l_discount"), test, "l_discount").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def resume_pending(t, spark):
    done = t("orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return calls.pending(t("customer").select("c_custkey"), done, "c_custkey")


@query("""WITH l AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), r AS (SELECT DISTINCT user_id, value FROM events WHERE event_type <> 'click')
SELECT event_id, round(nearest, 9) AS nearest FROM (SELECT l.event_id, r.value AS nearest, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.value - l.value), r.value) AS rn FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(r.value - l.value) < 0.5) WHERE rn = 1""")
def nearest_event_value(t, spark):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    right = e.where("event_type != 'click'").select("user_id", "value", F.col("value").alias("y")).distinct()
    return R.nearest(e.where("event_type = 'click'").select("event_id", "user_id", "value"), right, "user_id", "value", "y", 0.5).select("event_id", F.round("nearest_y", 9).alias("nearest"))


CANDIDATES = "c AS (SELECT p_partkey AS e, m, (p_partkey * (m + 3)) % 7 AS h, p_partkey, p_size FROM part, range(4) r(m))"


def candidate_rows(t) -> DataFrame:
    """Four candidates a part: what they claim, their residual and status follow from a number of their own."""
    rows = t("part").select(F.col("p_partkey").alias("equation_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    h = (F.col("equation_id") * (F.col("place") + 3)) % 7
    rows = rows.withColumn("h", h).withColumn("verified", (F.col("h") == 6) & (F.col("equation_id") % 2 == 0))
    return rows.select(
        "equation_id", F.concat(F.lit("m"), F.col("place").cast("string")).alias("method"), "place", F.when(F.col("equation_id") % 13 == 0, "").otherwise("said").alias("response"),
        (F.col("h") % 3 != 0).alias("has_solution"), F.when(F.col("h") < 5, "series").otherwise("none").alias("solution_type"),
        F.when(F.col("verified"), F.col("h") * 1e-9).when(F.col("h") > 2, F.col("h").cast("double")).alias("residual_max"), F.when(F.col("verified"), "verified").when(F.col("h") > 2, "failed").otherwise("unverifiable").alias("status"),
    )


@query(f"""WITH {CANDIDATES}, d AS (SELECT e, m, h, h = 6 AND e % 2 = 0 AS ver, h % 3 <> 0 AS has, h < 5 AS ser, CASE WHEN h = 6 AND e % 2 = 0 THEN 0 WHEN h > 2 THEN 1 ELSE 2 END AS st, CASE WHEN h = 6 AND e % 2 = 0 THEN h * 1e-9 WHEN h > 2 THEN h ELSE 1e300 END AS res FROM c),
g AS (SELECT *, count(*) OVER (PARTITION BY e, has, ser) AS votes, min(m) OVER (PARTITION BY e, has, ser) AS lead_m, bool_or(ver) OVER (PARTITION BY e) AS sure FROM d),
w AS (SELECT *, max(votes) OVER (PARTITION BY e) AS most FROM g), x AS (SELECT *, min(CASE WHEN votes = most THEN lead_m END) OVER (PARTITION BY e) AS lead_g FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY st, res, m) AS rn FROM x WHERE e % 13 = 0 OR CASE WHEN sure THEN ver WHEN most > 1 THEN votes = most AND lead_m = lead_g ELSE true END)
SELECT e AS equation_id, 'm' || m AS method, CASE WHEN e % 13 = 0 THEN 'all_calls_failed' WHEN sure THEN 'verified' WHEN most > 1 THEN 'majority_vote' ELSE 'best_effort' END AS selection_reason FROM y WHERE rn = 1""")
def select_candidates(t, spark):
    return solvers.selected(candidate_rows(t)).select("equation_id", "method", "selection_reason")


@query("""SELECT event_type, round(sum(c * tp / (tp + tc)), 4) AS prompt_cost, round(sum(c * tc / (tp + tc)), 4) AS completion_cost, round(sum(c), 4) AS cost FROM (
  SELECT event_type, (event_id % 5000 + 1)::DOUBLE AS tp, (event_id % 700)::DOUBLE AS tc, (event_id % 1000) / 1000.0 AS c FROM events) GROUP BY 1""")
def billed_costs(t, spark):
    tp, tc = F.col("event_id") % 5000 + 1, F.col("event_id") % 700
    c = t("events").select("event_type", tp.alias("prompt_tokens"), F.lit(0).alias("cached_tokens"), tc.alias("completion_tokens"), (tp + tc).alias("total_tokens"), ((F.col("event_id") % 1000) / 1000).alias("cost"))
    out = calls.billed(c).groupBy("event_type").agg(*(F.sum(k).cast("double").alias(n) for k, n in (("prompt_cost_usd", "prompt_cost"), ("completion_cost_usd", "completion_cost"), ("total_cost_usd", "cost"))))
    return out.select("event_type", *(F.round(c, 4).alias(c) for c in ("prompt_cost", "completion_cost", "cost")))


@query("SELECT lang, min(n_chars) AS low, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS q2, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS high FROM documents GROUP BY lang")
def describe_quartiles(t, spark):
    """Exact quartiles from counts of values, so that a task holds different lengths only, not rows."""
    n = t("documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    q = F.percentile("n_chars", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("n"))
    out = n.groupBy("lang").agg(q.alias("q"))
    return out.select("lang", F.get("q", F.lit(0)).cast("long").alias("low"), *(F.round(F.get("q", F.lit(k)), 6).alias(f"q{k}") for k in (1, 2, 3)), F.get("q", F.lit(4)).cast("long").alias("high"))


@query("""SELECT p_type, kind AS solution_class, count(*) AS n FROM (SELECT p_type, CASE p_size % 6 WHEN 0 THEN 'Constant' WHEN 1 THEN 'Exponential' WHEN 2 THEN 'Hyperbolic' WHEN 3 THEN 'Trigonometric' WHEN 4 THEN 'Polynomial' ELSE 'Rational' END AS kind FROM part) GROUP BY ALL""")
def solution_classes(t, spark):
    k, s = F.col("p_size") % 6, F.col("p_size").cast("string")
    u = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("*exp(x)"))).when(k == 2, "cosh(x)").when(k == 3, "sin(x)").when(k == 4, F.concat(s, F.lit("*x"))).otherwise("1/(x+1)")
    return t("part").groupBy("p_type", text.solution_class(u).alias("solution_class")).agg(F.count("*").alias("n"))


@query("""SELECT edge_case, solution_type, rows, valid, CASE WHEN g = 3 THEN round(100.0 * odd / rows, 6) END AS pct FROM (SELECT edge_case, solution_type, GROUPING(edge_case, solution_type) AS g, count(*) AS rows,
  count(*) FILTER (NOT (kind = 'none' AND p_size % 4 = 0)) AS valid, count(*) FILTER (edge_case <> 'none') AS odd FROM (SELECT p_size, CASE WHEN p_size % 5 = 0 THEN 'resonance' ELSE 'none' END AS edge_case, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'series' END AS kind,
  CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'series' END AS solution_type FROM part) GROUP BY GROUPING SETS ((edge_case), (solution_type), ()))""")
def augmented_report(t, spark):
    k = F.col("p_size")
    e = t("part").select(
        F.lit("x*t").alias("kernel"), F.lit("x").alias("f"), F.lit("0.5").alias("lambda_val"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit("x").alias("solution"),
        F.when(k % 5 == 0, "resonance").otherwise("none").alias("edge_case"), F.when(k % 2 == 0, "none").otherwise("series").alias("solution_type"), F.when(k % 4 == 0, "x").otherwise("").alias("u"),
    )
    return terms.augmented_report(terms.checked_augmented(e)).select("edge_case", "solution_type", "rows", "valid", F.round("pct", 6).alias("pct"))
