"""Sequential recurrences as parallel prefix scans over blocks of time.

A recurrence is evaluated in three steps: every block of a key is summarised on its
own (what it does to any incoming state), the summaries of a key, one row per block,
are composed in order, and every block is evaluated again from its incoming state. So
a key's history is spread over as many tasks as it has blocks, and only summaries meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeframe.functions.columns import DAY, bucket

BLOCK = 365 * DAY


def _carried(blocks: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return blocks.groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.sort_values("__b")), schema)


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, n: int, alpha: float, to: str, block: int = BLOCK) -> DataFrame:
    """df with an exponential average in column `to`.

    Valid values only: the first n-1 give nothing, the n-th gives the mean of the first n, each
    later one adds alpha times its distance. Rows without a value hold the last average.
    """
    rows, names = df.withColumn("__b", bucket(order, block)), list(df.columns)
    decay = 1.0 - alpha

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        b = 0.0
        for v in x:
            b = decay * b + alpha * v
        return pd.DataFrame([[*key, len(x), b, x[:n].tolist()]], columns=[*keys, "__b", "m", "b", "first"])

    schema = _types(df, keys) + ", __b long, m long, b double, first array<double>"
    blocks = rows.groupBy(*keys, "__b").applyInPandas(summary, schema)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total, y, out = 0, 0.0, float("nan"), []
        for m, b, first in zip(pdf["m"], pdf["b"], pdf["first"], strict=True):
            out.append((seen, total, y))
            j = n - seen  # values of this block that the seed still takes
            if j > 0:
                total += float(np.sum(first[: min(j, m)]))
                if m >= j:
                    y = total / n
                    early = sum(alpha * decay ** (m - k - 1) * first[k] for k in range(j))
                    y = decay ** (m - j) * y + (b - early)
            else:
                y = decay**m * y + b
            seen += m
        out = pd.DataFrame(out, columns=["seen", "total", "y"], index=pdf.index)
        return pd.concat([pdf[[*keys, "__b"]], out], axis=1)

    carry = _carried(blocks, keys, fold, _types(df, keys) + ", __b long, seen long, total double, y double")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen, total, y = int(pdf["seen"].iloc[0]), float(pdf["total"].iloc[0]), float(pdf["y"].iloc[0])
        out = np.empty(len(pdf))
        for k, v in enumerate(pdf[value].to_numpy(float)):
            if v == v:
                seen += 1
                if seen <= n:
                    total += v
                    if seen == n:
                        y = total / n
                else:
                    y = y + alpha * (v - y)
            out[k] = y
        pdf[to] = out
        return pdf[[*names, to]]

    result = T.StructType([*df.schema.fields, T.StructField(to, T.DoubleType())])
    found = rows.join(carry, [*keys, "__b"]).groupBy(*keys, "__b").applyInPandas(apply, result)
    return found.withColumn(to, F.when(~F.isnan(to), F.col(to)))


def automaton(df: DataFrame, keys: list[str], order: str, value: str, states: list[int], start: int, step: Callable[[int, float], int], to: str, block: int = BLOCK) -> DataFrame:
    """df with a finite automaton's state after each row, and before it (`to`_before).

    step gets the state and the value (NaN where there is none).
    """
    rows, names = df.withColumn("__b", bucket(order, block)), list(df.columns)

    def run(state: int, x: np.ndarray) -> list[int]:
        out = []
        for v in x:
            state = step(state, v)
            out.append(state)
        return out

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([[*key, [run(s, x)[-1] for s in states]]], columns=[*keys, "__b", "ends"])

    blocks = rows.groupBy(*keys, "__b").applyInPandas(summary, _types(df, keys) + ", __b long, ends array<int>")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for ends in pdf["ends"]:
            out.append(state)
            state = int(ends[states.index(state)])
        return pdf[[*keys, "__b"]].assign(state=out)

    carry = _carried(blocks, keys, fold, _types(df, keys) + ", __b long, state int")

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        first = int(pdf["state"].iloc[0])
        after = run(first, pdf[value].to_numpy(float))
        pdf[to] = after
        pdf[f"{to}_before"] = [first, *after[:-1]]
        return pdf[[*names, to, f"{to}_before"]]

    result = T.StructType([*df.schema.fields, T.StructField(to, T.IntegerType()), T.StructField(f"{to}_before", T.IntegerType())])
    return rows.join(carry, [*keys, "__b"]).groupBy(*keys, "__b").applyInPandas(apply, result)
