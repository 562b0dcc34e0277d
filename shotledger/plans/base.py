"""Relations of the evaluation domain, derived from the generic tables, and a registry of queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.functions.vectors import doubles
from shotledger.operators.lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see, which is deleted when the session's process ends: the result is read from it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.Path(path))
    return path


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_each(c: Column | str) -> Column:
    """The numbers of a list rounded as by r6. One below zero that rounds to zero keeps its sign, as in the SQL."""
    return F.transform(c, lambda x: F.signum(x) * r6(F.abs(x)))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, sample_id, k, psq, ee_v3, ses, ts: each user's events of a type are a prompt's samples."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    order = W.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    n = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return e.select(
        F.col("event_type").alias("task_id"), F.col("user_id").alias("sample_id"), (F.row_number().over(order) - 1).alias("k"),
        F.when(F.col("value") >= 2, F.col("value") / 487).alias("psq"), F.when(n % 7 != 0, n / 100).alias("ee_v3"), F.when(n % 11 != 0, 1 - n / 200).alias("ses"), "event_id", n.alias("n"),
    )


RESULTS = r"""results AS (SELECT event_type AS task_id, user_id AS sample_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS k,
  CASE WHEN value >= 2 THEN value / 487 END AS psq, CASE WHEN n % 7 <> 0 THEN n / 100 END AS ee_v3, CASE WHEN n % 11 <> 0 THEN 1 - n / 200 END AS ses, event_id, n
  FROM (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS n FROM events))"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_start, frame_end: each turn of a conversation is a shot as long as its text."""
    c = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    line = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.greatest(F.length("text"), F.lit(1))).over(line)
    return c.select(F.col("conv_id").alias("video_id"), "turn", (end - F.greatest(F.length("text"), F.lit(1))).alias("frame_start"), (end - 1).alias("frame_end"))


SHOTS = """shots AS (SELECT conv_id AS video_id, turn, (e - l)::BIGINT AS frame_start, (e - 1)::BIGINT AS frame_end FROM (SELECT *, greatest(length(text), 1) AS l,
  sum(greatest(length(text), 1)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, shot_id, vec_id, v: vectors of frames in four shots a label."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("label").alias("sample_id"), (F.col("vec_id") % 4).alias("shot_id"), "vec_id", doubles(F.col("embedding")).alias("v"))


FRAMES = "frames AS (SELECT label AS sample_id, vec_id % 4 AS shot_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
#: Mean vectors of the shots, as lists in order of dimension.
MEANS = """dims AS (SELECT sample_id, shot_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM frames),
avgs AS (SELECT sample_id, shot_id, d, avg(x) AS x, stddev_pop(x) AS s, count(*) AS n FROM dims GROUP BY ALL),
means AS (SELECT sample_id, shot_id, list(x ORDER BY d) AS v, avg(s) AS spread, max(n) AS n FROM avgs GROUP BY ALL)"""
COS = "list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"
CLIP = "least(1.0, greatest(0.0, {x}))"
