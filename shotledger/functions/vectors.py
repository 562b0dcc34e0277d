"""Vectors as arrays, with their math in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a small constant on each norm."""
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def normalised(a: Column) -> Column:
    return F.transform(doubles(a), lambda x: x / (norm(a) + EPS))


def _summed(df: DataFrame, keys: list[str], vector: str, *metrics: str) -> DataFrame:
    """keys and _s, a summary that partial summaries of a group add up to: what moves is one for each group and task, not a row for each dimension."""
    held = df.select(*keys, doubles(F.col(vector)).alias("_v")).filter(F.col("_v").isNotNull())
    return held.groupBy(*keys).agg(Summarizer.metrics(*metrics).summary(array_to_vector(F.col("_v"))).alias("_s"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """For each group the mean vector, from partial sums, so that no group's vectors are gathered. Vectors of a group are equally long; null ones don't count, nor do null components.

    A summary's own mean is moved from row to row and gathers errors, which give a mean of zero a sign. Its L1 norms are plain
    sums: of what lies above zero, of what lies below, and of a one for each component that isn't null.
    """
    v = doubles(F.col(vector))
    above, below, there = F.transform(v, lambda x: F.greatest(x, F.lit(0.0))), F.transform(v, lambda x: F.greatest(-x, F.lit(0.0))), F.transform(v, lambda x: x.isNotNull().cast("double"))
    sums = _summed(df.select(*keys, F.concat(above, below, there).alias("_parts")), keys, "_parts", "normL1").select(*keys, vector_to_array("_s.normL1").alias("_l"))
    size = F.expr("size(_l) div 3").cast("int")
    above, below, there = (F.slice("_l", size * i + 1, size) for i in range(3))
    total = F.zip_with(above, below, lambda x, y: x - y)
    return sums.select(*keys, F.zip_with(total, there, lambda x, n: x / F.nullif(n, F.lit(0.0))).alias(out))


def spread(df: DataFrame, keys: list[str], vector: str, out: str = "spread") -> DataFrame:
    """For each group the mean over dimensions of the population deviation, and the number of vectors."""
    made = _summed(df, keys, vector, "variance", "count").select(*keys, vector_to_array("_s.variance").alias("_v"), F.col("_s.count").alias("n"))
    # The summary's variance is that of a sample.
    whole = F.transform("_v", lambda x: F.sqrt(x * (F.col("n") - 1) / F.col("n")))
    return made.select(*keys, (F.aggregate(whole, F.lit(0.0), lambda s, x: s + x) / F.size("_v")).alias(out), "n")
