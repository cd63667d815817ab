"""Arithmetic of cost, ratios and batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars for a million tokens at standard rates, and the estimate's constants.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00)}
BATCH_DISCOUNT = 0.5
CHARS_PER_TOKEN, OVERHEAD_TOKENS, OUTPUT_TOKENS = 4.0, 32, 350
TRUNCATE_CHARS = 6000
MOST_SPEND, LEAST_PRICED = 25.0, 50
MOST_TOKENS_PER_S = 500.0


def cost(tokens_in: Column, tokens_out: Column, model: Column, factor: float = 1.0) -> Column:
    """Dollars at standard rates times ``factor``; an unknown model fails the job."""
    out = F.raise_error(F.concat(F.lit("no price for model "), model)).cast("double")
    for name, (p_in, p_out) in PRICES.items():
        out = F.when(model == name, F.lit(factor) * (tokens_in / F.lit(1e6) * p_in + tokens_out / F.lit(1e6) * p_out)).otherwise(out)
    return out


def batch_cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    return cost(tokens_in, tokens_out, model, BATCH_DISCOUNT)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, 0.0).otherwise(num.cast("double") / F.nullif(den, F.lit(0)).cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))


def cost_per_1k(throughput: Column, hourly: Column) -> Column:
    """Dollars for a thousand documents. A throughput that is not positive and finite and a negative rate fail the job."""
    bad = throughput.isNull() | F.isnan(throughput) | (F.abs(throughput) == float("inf")) | (throughput <= 0) | (hourly < 0)
    return F.when(bad, F.raise_error(F.lit("throughput must be finite and positive, and the rate not negative")).cast("double")).otherwise(F.lit(1000.0) / throughput / F.lit(3600.0) * hourly)


def whole_batches(n: Column, size: Column) -> Column:
    return n - F.pmod(n, size)


def effective_batch(*factors: Column) -> Column:
    out = F.lit(1)
    for f in factors:
        out = out * F.greatest(F.lit(1), f)
    return out


def implausible(p50_ms: Column, tokens: Column) -> Column:
    """A latency below what the tokens need at the fastest believable rate, or no tokens at all."""
    return (tokens <= 0) | (p50_ms <= tokens * 1000.0 / MOST_TOKENS_PER_S)
