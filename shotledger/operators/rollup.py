"""Folding samples into prompts, prompts into tasks, and what surrounds that."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.operators.lineage import first_of_each


def fold_samples(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row for each prompt: k_count and of each metric the mean and sample deviation of its non-null values.

    All values null: both are null. One value: the deviation is null. Partial sums combine before the shuffle.
    """
    each = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("k_count"), *each)


def macro_mean(prompts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row for each task: every prompt weighs the same, however many samples it has. Takes fold_samples(), never its averages."""
    each = [x for m in metrics for x in (F.avg(f"{m}_mean").alias(f"{m}_mean"), F.stddev_samp(f"{m}_mean").alias(f"{m}_std"))]
    return prompts.groupBy(*keys).agg(F.count("*").alias("n_prompts"), F.max("k_count").alias("k_samples"), *each)


def with_totals(rows: DataFrame, keys: list[str], by: str, aggregates: list[Column], total: str = "all") -> DataFrame:
    """Aggregates by keys and each value of `by`, and over all its values (the row `total`)."""
    every = rows.select("*", F.explode(F.array(F.col(by), F.lit(total))).alias("_by")).drop(by).withColumnRenamed("_by", by)
    return every.groupBy(*keys, by).agg(*aggregates)


def row_mean(columns: list[str]) -> Column:
    """Mean of the non-null columns of a row; null if all are null."""
    have = F.array_compact(F.array(*columns))
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have))


def task_score(rows: DataFrame, headline: list[str], structural: str, task: str = "task_id", structural_task: str = "T5") -> DataFrame:
    """rows with task_score: the mean of the headline metrics that are there; on the structural task its own metric alone."""
    return rows.withColumn("task_score", F.when(F.col(task) == structural_task, F.col(structural)).otherwise(row_mean(headline)))


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the one that is last in order."""
    last = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def first_metadata(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """For each key the columns of its row that is first in order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_m")).select(*keys, "_m.*")


def update_then(rows: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with new values of columns where updates has one, and the old elsewhere."""
    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = rows.join(new, keys, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value; null is a value."""
    return rows.groupBy(F.col(column).cast("string").alias("bucket")).agg(F.count("*").alias("n"))


def outcomes(rows: DataFrame, keys: list[str], ok: str, skipped: str | None = None) -> DataFrame:
    """Manifest summaries: for each key, and over all (null keys), n_total, n_ok, n_failed and n_skipped of its rows."""
    skip = F.coalesce(F.col(skipped), F.lit(False)) if skipped else F.lit(False)
    good = F.coalesce(F.col(ok), F.lit(False)) & ~skip
    counts = [F.count("*").alias("n_total"), F.count_if(good).alias("n_ok"), F.count_if(~good & ~skip).alias("n_failed"), F.count_if(skip).alias("n_skipped")]
    return rows.rollup(*keys).agg(*counts) if len(keys) == 1 else rows.groupingSets([[F.col(k) for k in keys], []], *keys).agg(*counts)


def by_task(rows: DataFrame, task: str = "task_id", *more: str) -> DataFrame:
    """rows in order of their task's name, nulls as an empty one."""
    return rows.orderBy(F.coalesce(F.col(task).cast("string"), F.lit("")), *more)


def by_hit_rate(rows: DataFrame, rate: str = "hit_rate", category: str = "category") -> DataFrame:
    """rows from the best rate down, equal ones by category."""
    return rows.orderBy(F.desc(rate), category)


def limited(rows: DataFrame, order: list[str], n: int, per: list[str] | None = None) -> DataFrame:
    """The first n rows in order, or of each group; 0 keeps all."""
    if not n:
        return rows
    return first_of_each(rows, per, n, order) if per else rows.orderBy(*order).limit(n)


def together(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, by the names of their columns; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def details(rows: DataFrame, keys: list[str], name: str, value: str, out: str = "details") -> DataFrame:
    """For each key a map from name to value, of rows in which names don't repeat, and the list of its values by name."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name), F.col(value))))
    listed = rows.groupBy(*keys).agg(pairs.alias("_p"))
    return listed.select(*keys, F.map_from_entries("_p").alias(out), F.transform("_p", lambda p: p[value]).alias(f"{out}_list"))
