"""A caller's own strategies and notations, as functions of SQL and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeResult

from .functions.expressions import TROUBLE, _column, parse, show
from .shipping import ship


def register_strategy(spark: SparkSession, name: str, rows: Callable[[dict], Iterable[dict]], schema: str = "kernel string, f string, u string, lambda_val double, solution_type string") -> None:
    """A strategy as a table function: ``SELECT ... FROM equations, LATERAL name(kernel => ..., f => ..., lambda_val => ..., a => ..., b => ...)``.

    ``rows`` is called with an equation's given arguments by name and gives dicts with names of ``schema``; a missing one is null. Columns are known when a
    statement is analysed: an argument of another name is an error there, before anything runs. ``edge_case`` is added, the strategy's name.
    """
    ship(spark)
    shape = T.StructType.fromDDL(f"{schema}, edge_case string")
    names = shape.fieldNames()
    known = ("equation_id", "kernel", "f", "u", "lambda_val", "a", "b", "seed")

    class Strategy:
        @staticmethod
        def analyze(**given):
            if strange := sorted(set(given) - set(known)):
                raise ValueError(f"unknown arguments: {strange}")
            return AnalyzeResult(schema=shape)

        def eval(self, **given):
            for row in rows(given):
                yield tuple(name if n == "edge_case" else row.get(n) for n in names)

    spark.udtf.register(name, F.udtf(Strategy))


def register_notation(spark: SparkSession, name: str, reader: Callable[[str], tuple | None], printer: Callable[[tuple], str]) -> tuple:
    """A notation by its reader (text to tree or None) and printer (tree to text), as SQL functions from_name (to infix) and to_name (of infix).

    Returned are the same two as column functions. What a reader or printer can't do gives null.
    """
    ship(spark)

    def read(text):
        tree = reader(text)
        return None if tree is None else show(tree)

    def write(text):
        tree = parse(text)
        return None if tree is None else printer(tree)

    def plain(f):
        def run(text):
            try:
                return None if text is None else f(text)
            except TROUBLE:
                return None

        return run

    for prefix, f in (("from", read), ("to", write)):
        spark.udf.register(f"{prefix}_{name}", F.udf(plain(f), T.StringType(), useArrow=True))
    return _column(T.StringType(), read), _column(T.StringType(), write)
