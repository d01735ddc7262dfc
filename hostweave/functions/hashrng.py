"""Keyed randomness: the same draws for any partitioning, and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def u(seed: int, stream: str, *keys) -> Column:
    """Uniform in (0, 1), from the first 13 hex digits of the MD5 of seed:stream:keys."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[_col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def pick(seed: int, stream: str, n, *keys) -> Column:
    """Uniform in 0 .. n - 1."""
    return F.floor(u(seed, stream, *keys) * _col(n)).cast("long")


def race(seed: int, stream: str, weight, *keys) -> Column:
    """Exponential key of a weighted draw without replacement: the k smallest are the draw, their order its order. Rounded, so that engines agree."""
    return F.round(-F.ln(u(seed, stream, *keys)) / _col(weight), 9)


def first_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows by a total order, as a distributed top-k."""
    return df.orderBy(*order).limit(k)


def first_k_per(df: DataFrame, by: list[str], k, *order) -> DataFrame:
    """Adds draw_rank (from 0) and keeps ranks below k, a number or column, in each group."""
    ranked = df.withColumn("draw_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return ranked.where(F.col("draw_rank") < (F.lit(k) if isinstance(k, int) else _col(k)))


def sql_u(seed: int, stream: str, *keys: str) -> str:
    """DuckDB twin of u()."""
    text = ", ".join([f"'{seed}'", f"'{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST(('0x' || substr(md5(concat_ws(':', {text})), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_race(seed: int, stream: str, weight: str, *keys: str) -> str:
    return f"round(-ln({sql_u(seed, stream, *keys)}) / CAST({weight} AS DOUBLE), 9)"
