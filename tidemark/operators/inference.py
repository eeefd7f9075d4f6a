"""Row-wise calls of an external model, as one narrow Arrow-batched stage."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(df: DataFrame, predict: Callable[[str], dict], labels: list[str], key: str = "id", text: str = "text", tries: int = 3, at_once: int = 8, wait: float = 1.0, reasoning: bool = False) -> DataFrame:
    """(key, labels..., [reasoning,] error): ``predict`` per text with retries; a row whose calls all fail keeps its key and the error, cut to 100 characters."""
    types, more = dict(df.dtypes), ["reasoning"] * reasoning

    def call(t):
        for n in range(tries):
            try:
                got = predict(t)
                missing = [c for c in labels if not isinstance(got.get(c), bool)]
                if missing:
                    raise ValueError(f"no boolean for {missing}")
                return [got[c] for c in labels] + [got.get(c) for c in more] + [None]
            except Exception as e:  # noqa: BLE001  an error of the model becomes a row
                last = f"{type(e).__name__}: {e}"[:100]
                if n + 1 < tries:
                    time.sleep(wait * 2**n)
        return [None] * (len(labels) + len(more)) + [last]

    def run(batches):
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(call, b[text]))
                yield pd.DataFrame({key: b[key]} | {c: [g[i] for g in got] for i, c in enumerate([*labels, *more, "error"])})

    schema = f"`{key}` {types[key]}, " + ", ".join(f"{c} boolean" for c in labels) + "".join(f", {c} string" for c in more) + ", error string"
    return df.select(key, text).mapInPandas(run, schema)


def with_reasoning(predict: Callable[[str], tuple[str, dict]]) -> Callable[[str], dict]:
    """A model that answers (reasoning, labels), as one whose labels come with ``reasoning``."""

    def both(t: str) -> dict:
        reasoning, labels = predict(t)
        return {**labels, "reasoning": reasoning}

    return both


def capped_remaining(df: DataFrame, done: DataFrame, cap: int, key: str = "id") -> DataFrame:
    """At most ``cap`` rows in all, those done before included: the first of the others in the order of their keys."""
    left = max(0, cap - done.select(key).distinct().count())
    return remaining(df, done, key).orderBy(key).limit(left)


def dry_run(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """(n, n_done, n_to_do) without calling or writing anything."""
    d = done.select(key).distinct().withColumn("__d", F.lit(1))
    return df.select(key).join(d, key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("__d").alias("n_done"), F.sum(F.col("__d").isNull().cast("long")).alias("n_to_do"))


def remaining(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not done yet; rows that ended in an error count as done."""
    return df.join(done.select(key), key, "left_anti")


def keyword_stub(words: dict[str, list[str]]) -> Callable[[str], dict]:
    """A deterministic stand-in for a model: a label is true if one of its words occurs."""

    def predict(t: str) -> dict:
        low = (t or "").lower()
        return {k: any(w in low for w in ws) for k, ws in words.items()}

    return predict
