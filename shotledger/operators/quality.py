"""Quality reports on detections, and on configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def records(found: DataFrame, expected: str = "expected", actual: str = "actual", error: str = "error") -> DataFrame:
    """A row for each video: diff, whether counts match, and a note. Rows with an error keep only what was expected."""
    failed = F.col(error).isNotNull()
    diff = F.when(~failed, F.col(actual) - F.col(expected))
    return found.withColumn(actual, F.when(~failed, F.col(actual))).withColumn("diff", diff).withColumn(
        "matches_expected", F.coalesce(F.col("diff") == 0, F.lit(False))
    ).withColumn("note", F.when(failed, F.lit("ERROR")).when(F.col("diff") != 0, F.concat(F.lit("diff="), F.col("diff").cast("string"))).otherwise(F.lit("")))


def summary(recorded: DataFrame) -> DataFrame:
    """Counts of exact, off-by-one, off-more and failed rows, and rates over all rows."""
    d = F.abs("diff")
    out = recorded.agg(F.count("*").alias("total"), F.count_if(d == 0).alias("exact"), F.count_if(d == 1).alias("off_by_one"), F.count_if(d > 1).alias("off_more"), F.count_if(F.col("note") == "ERROR").alias("failed"))
    return out.withColumn("hit_rate", F.bround(F.col("exact") / F.nullif(F.col("total"), F.lit(0)), 3))


def by_category(recorded: DataFrame, category: str = "category") -> DataFrame:
    out = recorded.groupBy(F.coalesce(category, F.lit("unknown")).alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("matches_expected")).alias("exact"))
    return out.withColumn("hit_rate", F.bround(F.col("exact") / F.col("total"), 3))


def count_agreement(found: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n_available videos that the first detector has a count of, and n_agree of them on which the second has the same."""
    have = F.col(first).isNotNull()
    return found.agg(F.count_if(have).alias("n_available"), F.count_if(have & F.coalesce(F.col(first) == F.col(second), F.lit(False))).alias("n_agree"))


def recommendations(report: DataFrame) -> DataFrame:
    """What follows from a summary() with the columns of count_agreement(), a row each. The rate is that of the counts, not rounded; no rows are a rate of 0."""
    rate = F.coalesce(F.col("exact") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    agree = F.col("n_agree") / F.nullif(F.col("n_available"), F.lit(0))
    rules = [(rate >= 0.85, "ready"), ((rate >= 0.70) & (rate < 0.85), "review"), (rate < 0.70, "retune"), (F.col("off_by_one") > F.col("off_more"), "off by one dominates"), (agree < 0.7, "detectors disagree")]
    return report.select(F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)))).alias("recommendation"))


def config_errors(configs: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """configs: snapshot_id, models map<string,struct<model,captured_at>>. The key and error of each rule that is broken."""
    models = configs.select(key, F.explode("models").alias("name", "m"))
    rules = [
        configs.filter(F.coalesce("snapshot_id", F.lit("")) == "").select(key, F.lit("missing snapshot_id").alias("error")),
        configs.filter(F.coalesce(F.size("models"), F.lit(0)) <= 0).select(key, F.lit("no models").alias("error")),
        models.filter(~F.contains("m.model", F.lit("@")) & (F.coalesce("m.captured_at", F.lit("")) == "")).select(key, F.concat(F.lit("no date: "), "name").alias("error")),
    ]
    return reduce(DataFrame.unionByName, rules)
