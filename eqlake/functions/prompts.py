"""Prompts as column expressions: a system text, remarks on edge cases, the equation and hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .notation import filled
from .text import equation_line, rounded_numbers

#: Default system texts; callers can give their own by style.
SYSTEM = {
    "basic": "You solve Fredholm integral equations. Write the answer in {notation} notation.",
    "chain-of-thought": "You solve Fredholm integral equations. Number your steps, check the result by insertion and write the answer in {notation} notation.",
    "few-shot": "You solve Fredholm integral equations as in these examples. Write the answer in {notation} notation.",
    "tool-assisted": "You solve Fredholm integral equations and may use symbolic and numeric tools. Write the answer in {notation} notation.",
}
EXAMPLES = (
    "Example: u(x) - 1 * ∫[0, 1] (x*t) u(t) dt = x\nHAS_SOLUTION: yes\nSOLUTION_TYPE: exact_symbolic\nSOLUTION: u(x) = 3*x/2",
    "Example: u(x) - 1 * ∫[0, 1] (1) u(t) dt = 1\nHAS_SOLUTION: no\nSOLUTION_TYPE: none",
)
REMARKS = "Answers can be exact, with numeric coefficients, points, a series, a family with free constants, regularized, or that there is none. State which of these it is."
MODES, NOTATIONS, HINTS = ("none", "guardrails", "hints"), ("infix", "latex", "rpn"), ("has_solution", "solution_type")


def styles(names: str) -> list[str]:
    """``all`` or a comma-separated list; an unknown style is an error."""
    out = list(SYSTEM) if names.strip() == "all" else [s.strip() for s in names.split(",") if s.strip()]
    if unknown := set(out) - set(SYSTEM):
        raise ValueError(f"unknown styles: {sorted(unknown)}")
    return out


def hint_text(columns: list[str], fields: tuple[str, ...] = HINTS) -> Column:
    """``[Has solution: Yes, Type: ...]`` of what is known, in this order; empty if nothing is."""
    known = {
        "has_solution": F.when(F.col("has_solution"), "Has solution: Yes").when(~F.col("has_solution"), "Has solution: No") if "has_solution" in columns else None,
        "solution_type": F.concat(F.lit("Type: "), F.col("solution_type")) if "solution_type" in columns else None,
    }
    parts = [known[f] for f in HINTS if f in fields and known[f] is not None]
    if not parts:
        return F.lit("")
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", "").otherwise(F.concat(F.lit("\n["), joined, F.lit("]")))


def prompts(equations: DataFrame, style: str = "all", notation: str = "infix", mode: str = "none", fields: tuple[str, ...] = HINTS, n_examples: int = 2, system: dict[str, str] | None = None, truth: bool = True) -> DataFrame:
    """``equation_id, style, format_type, prompt, ground_truth, metadata`` of each equation and style.

    ``equations`` has equation_id, kernel, f, lambda_val, a, b, and optionally u,
    has_solution and solution_type. A null in the equation gives a null prompt.
    One projection and an explode; nothing is shuffled.
    """
    if mode not in MODES or notation not in NOTATIONS or set(fields) - set(HINTS):
        raise ValueError(f"mode {mode}, notation {notation}, fields {fields}: unknown")
    c = {k: F.col(k) for k in equations.columns}
    line = equation_line(c["kernel"], c["f"], c["lambda_val"], c["a"], c["b"])
    user = F.concat(F.lit("Solve the following Fredholm integral equation:\n\n"), line, F.lit("\n\nDomain: ["), c["a"].cast("string"), F.lit(", "), c["b"].cast("string"), F.lit("]\n\nProvide the solution u(x)."))
    remarks = "" if mode == "none" else f"\n{REMARKS}"
    hints = hint_text(equations.columns, fields) if mode == "hints" else F.lit("")
    texts = SYSTEM | (system or {})
    made = []
    for name in styles(style):
        examples = "".join(f"\n\n{x}" for x in EXAMPLES[:n_examples]) if name == "few-shot" else ""
        head = texts[name].format(notation=notation) + examples + remarks
        made.append(F.struct(F.lit(name).alias("style"), F.concat(F.lit(f"{head}\n\n"), user, hints).alias("prompt")))
    meta = [c[k] for k in ("kernel", "f", "lambda_val") if k in c] + [F.array("a", "b").alias("domain")] + [c[k] for k in HINTS if k in c]
    truth_column = c["u"] if truth and "u" in c else F.lit(None).cast("string")
    out = equations.select("equation_id", truth_column.alias("ground_truth"), F.struct(*meta).alias("metadata"), F.explode(F.array(*made)).alias("_p"))
    return out.select("equation_id", "_p.style", F.lit(notation).alias("format_type"), "_p.prompt", "ground_truth", "metadata")


def code_prompt(line: Column) -> Column:
    """A request for a script that prints the answer."""
    return F.concat(F.lit("Write a Python script that solves this equation and prints SOLUTION: u(x) = ...\n\n"), line)


#: The prompts of a model with tokens of its own and of one without, and the equation as a script.
SPECIAL = "<|fred|> <|kernel|> {kernel} <|lambda|> {lam} <|rhs|> {f} <|domain|> {a} {b} <|solve|>"
PLAIN = (
    "Solve the Fredholm integral equation of the second kind:\nu(x) - λ ∫_a^b K(x, t) u(t) dt = f(x)\n"
    "with K(x, t) = {kernel}, f(x) = {f}, λ = {lam}, domain [{a}, {b}].\nRespond in the format:\n"
    "SOLUTION: u(x) = [your solution in LaTeX]\nHAS_SOLUTION: [yes/no]\n"
    "SOLUTION_TYPE: [exact_symbolic/approx_coef/discrete_points/series/family/regularized/none]"
)
#: An equation as a script, in our own words.
SCRIPT = "```python\n{line}\nlower, upper, scale = {a}, {b}, {lam}\n\ndef kernel(x, t):\n    return {kernel}\n\ndef right_side(x):\n    return {f}\n```"
SECOND_KIND = "# wanted: u such that u(x) minus scale times the integral of kernel(x, t) u(t) over t is right_side(x)"
FIRST_KIND = "# wanted: u such that the integral of kernel(x, t) u(t) over t is right_side(x) alone; small errors of it grow"


def short_number(c: Column) -> Column:
    """Four significant digits, without a trailing .0."""
    return F.regexp_replace(F.format_string("%.3e", c.cast("double")).cast("double").cast("string"), r"\.0$", "")


def token_prompt(template: str, kernel: Column, f: Column, lam: Column, a: Column, b: Column) -> Column:
    """SPECIAL or PLAIN with an equation, its numbers to four significant digits."""
    parts = {"kernel": rounded_numbers(kernel), "f": rounded_numbers(f), "lam": short_number(lam), "a": short_number(a), "b": short_number(b)}
    return filled(template, parts)


def script_block(kernel: Column, f: Column, lam: Column, a: Column, b: Column) -> Column:
    """An equation as definitions in a script; of the first kind where lambda is 0."""
    line = F.when(lam == 0, FIRST_KIND).otherwise(SECOND_KIND)
    return filled(SCRIPT, {"kernel": kernel, "f": f, "lam": lam.cast("string"), "a": a.cast("string"), "b": b.cast("string"), "line": line})


def fitting(rows: DataFrame, prompt: str, answer: str, stratum: str, key: str, target: int, most: int = 1000) -> DataFrame:
    """Up to ``target`` rows a stratum, by key, whose prompt and answer together have at most ``most`` words."""
    words = F.size(F.split(F.trim(F.concat_ws(" ", prompt, answer)), r"\s+"))
    fits = rows.where(words <= most)
    # the first of a stratum are found within parts of it before they are ranked together
    part = fits.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    near = part.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_part").orderBy(key))).where(F.col("_rn") <= target).drop("_part", "_rn")
    return near.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(key))).where(F.col("_rn") <= target).drop("_rn")
