"""Calls of a model for each prompt by a client that the caller gives, what is left after a stop, and their cost."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def responses(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 1.0, parallel: int = 8) -> DataFrame:
    """``prompts`` with response, attempts and error.

    ``make_client`` is called once in each of a task's ``parallel`` threads, and gives a function from prompt to
    response; so many calls of a task are under way at once. A call that fails is repeated after 1, 2, 4 ... times ``wait`` seconds; if all
    fail, or the prompt is null, the response is empty and ``error`` says why. A lost task calls anew.
    """
    fresh = ("response", "attempts", "error")
    rest = prompts.select(*(c for c in prompts.columns if c not in fresh))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor
        from threading import local

        own = local()

        def call(prompt):
            if not isinstance(prompt, str):
                return "", 0, "no prompt"
            error = None
            for tried in range(1, attempts + 1):
                try:
                    if not hasattr(own, "client"):
                        own.client = make_client()
                    return own.client(prompt) or "", tried, None
                except Exception as e:  # the client's own errors, of any kind
                    error = f"{type(e).__name__}: {e}"
                    if tried < attempts:
                        time.sleep(wait * 2 ** (tried - 1))
            return "", attempts, error

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for frame in frames:
                rows = list(pool.map(call, frame["prompt"]))  # in the order of the prompts
                for k, name in enumerate(fresh):
                    frame[name] = [r[k] for r in rows]
                yield frame

    return rest.mapInPandas(run, f"{schema}, response string, attempts int, error string")


def pending(prompts: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Prompts whose keys aren't among those done; a null key is never done."""
    return prompts.join(done.select(*keys).distinct(), list(keys), "left_anti")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` (model, prompt_tokens, cached_tokens, completion_tokens) with costs by ``prices`` (model, input, cached, output: USD a million tokens).

    Cached tokens are part of the prompt's. A model without a price costs nothing.
    """
    price = prices.select(F.col("model").alias("_model"), *(F.col(c).cast("decimal(18,8)").alias(f"_{c}") for c in ("input", "cached", "output")))
    cached = F.coalesce("cached_tokens", F.lit(0))

    def cost(tokens, column):
        return (F.coalesce(tokens * F.col(column), F.lit(0)) / 1_000_000).cast("decimal(18,8)")

    out = calls.join(price, F.col("model") == F.col("_model"), "left")
    out = out.withColumns({"prompt_cost_usd": cost(F.col("prompt_tokens") - cached, "_input"), "cached_cost_usd": cost(cached, "_cached"), "completion_cost_usd": cost(F.col("completion_tokens"), "_output")})
    return out.drop("_model", "_input", "_cached", "_output").withColumn("total_cost_usd", F.col("prompt_cost_usd") + F.col("cached_cost_usd") + F.col("completion_cost_usd"))


def billed(calls: DataFrame) -> DataFrame:
    """``calls`` (prompt_tokens, cached_tokens, completion_tokens, total_tokens, cost) with the billed cost split by shares of tokens.

    Cached tokens count within the prompt's share too. Without a cost or tokens all are 0.
    """
    cost = F.coalesce(F.col("cost").cast("decimal(18,8)"), F.lit(0).cast("decimal(18,8)"))
    part = lambda c: F.coalesce((cost * F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.col("total_tokens"))).cast("decimal(18,8)"), F.lit(0).cast("decimal(18,8)"))
    return calls.withColumns({"prompt_cost_usd": part("prompt_tokens"), "completion_cost_usd": part("completion_tokens"), "cached_cost_usd": part("cached_tokens"), "total_cost_usd": F.when(F.col("total_tokens") > 0, cost).otherwise(cost)})


def panel_cost(models: DataFrame, requests: int) -> DataFrame:
    """``model, cost`` of so many requests, and their sum (model null): tokens a request by price a million (input, output, prompt_tokens, completion_tokens)."""
    each = (F.col("prompt_tokens") * F.col("input") + F.col("completion_tokens") * F.col("output")) / 1_000_000
    return models.rollup("model").agg(F.sum(each * requests).alias("cost"))


def cost_summary(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost in total, by provider, and by provider and model: one aggregation over grouping sets."""
    return calls.rollup("provider", "model").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.grouping_id().alias("level"),
    )
