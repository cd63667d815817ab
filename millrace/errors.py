"""Errors that guards raise; each carries how many rows offend and the first ten of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    def __init__(self, message: str, count: int = 0, sample: list | None = None) -> None:
        self.count, self.sample = count, sample or []
        more = f" (+{count - len(self.sample)} more)" if count > len(self.sample) else ""
        super().__init__(f"{message}: {', '.join(map(str, self.sample))}{more}" if count else message)


SAMPLE = 10


def sampled(df: DataFrame, key: str) -> DataFrame:
    """``(n, sample array)``: how many rows offend, and the first ten of their keys in order. One row."""
    top = df.select(key).orderBy(key).limit(SAMPLE).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return df.agg(F.count("*").alias("n")).crossJoin(top)  # one row each


def message(text: Column, n: Column, sample: Column) -> Column:
    """An error's text as a column: the keys of the sample and how many more there are."""
    listed = F.concat(text, F.lit(": "), F.array_join(sample.cast("array<string>"), ", "))
    return F.concat(listed, F.when(n > F.size(sample), F.format_string(" (+%d more)", n - F.size(sample))).otherwise(""))


def none_of(df: DataFrame, key: str, text: str) -> None:
    """Raises if ``df`` has a row. The first ten keys in order are the sample."""
    r = sampled(df, key).first()
    if r["n"]:
        raise ContractError(text, r["n"], list(r["sample"]))
