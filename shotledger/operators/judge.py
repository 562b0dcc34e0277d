"""Blind comparison: labels, wins, mean scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blind_labels(versions: DataFrame, sample: str, version: str) -> DataFrame:
    """Versions of a sample with labels A, B, C ... in an order that only the sample and the version decide."""
    order = W.partitionBy(sample).orderBy(F.md5(F.concat_ws("|", F.col(sample).cast("string"), version)), version)
    return versions.withColumn("label", F.char(F.row_number().over(order) + 64))


def decoded(verdicts: DataFrame, labels: DataFrame, sample: str, winner: str) -> DataFrame:
    """verdicts with the version that their label stands for; a label that stands for none gives null."""
    return verdicts.join(labels.select(sample, F.col("label").alias(winner), F.col("version").alias("winner_version")), [sample, winner], "left")


def wins(verdicts: DataFrame, task: str, version: str, versions: list[str]) -> DataFrame:
    """Wins of each version by task, and over all tasks in the row "all"."""
    every = verdicts.select(F.explode(F.array(F.col(task), F.lit("all"))).alias(task), version)
    return every.groupBy(task).agg(*(F.count_if(F.col(version) == v).alias(f"wins_{v}") for v in versions), F.count(version).alias("n_judged"))


def mean_scores(scores: DataFrame, task: str, axis: str, version: str, score: str, versions: list[str]) -> DataFrame:
    """Mean score of each version by task (and "all") and axis. What is no number is skipped; nothing left is 0."""
    every = scores.select(F.explode(F.array(F.col(task), F.lit("all"))).alias(task), axis, version, F.col(score).try_cast("double").alias("_s"))
    return every.groupBy(task, axis).agg(*(F.coalesce(F.avg(F.when(F.col(version) == v, F.col("_s"))), F.lit(0.0)).alias(f"mean_{v}") for v in versions))


def assembled(parts: DataFrame, keys: list[str], order: str, label: str, text: str, out: str = "message") -> DataFrame:
    """Labelled lines of a message, in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(": ", label, text).alias("line"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(out))
