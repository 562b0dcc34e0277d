"""Cutting the lineage of iterations, and numbering and scanning rows in order without one task for a group."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors see: spark.checkpoint.dir. Only a session without other machines may do with a local one."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder.

    A checkpoint keeps the size that was estimated for its plan, and a join's is the product of its sides': over the rounds of
    an iteration it becomes a number that fills the driver. So the rows are taken up anew, as a table of unknown size.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()._jdf
    bare = spark._jsparkSession.internalCreateDataFrame(done.queryExecution().analyzed().rdd(), done.schema(), False)
    return DataFrame(bare, spark)


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """rows with their number in their group, from 0 by order, which should leave no ties.

    Rows are dealt out by ranges of group and order; each range is numbered alone and goes on from the rows of its group
    in ranges before it, of which only the counts are summed. No group is one task's.
    """
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy(*group, "_range").orderBy(*order)
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    match = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group] + [F.col("d._range") == F.col("c._range")]
    joined = dealt.withColumn("_in", F.row_number().over(inside) - 1).alias("d").join(counts.alias("c"), match)
    return joined.select(*(F.col(f"d.{c}") for c in rows.columns), (F.col("c._before") + F.col("d._in")).cast("long").alias(out))


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows in ranges of group and order, which each row's _range names: what before() works on. order should leave no ties."""
    return cut(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))


def before(ranged: DataFrame, group: list[str], order: list[str], **scans: tuple[str, Column]) -> DataFrame:
    """dealt() rows with columns of what stands before each row in its group: name=(kind, value), kind one of sum (0 before
    the first row), max, last (the value of the row before, null or not) and known (the last value that isn't null).

    All four can be put together from parts, so each range is scanned alone, ranges are summed up in a row each, and a
    range begins with what the ranges of its group before it add up to. No group is one task's.
    """
    boxed = {n: F.struct(v.alias("v")) if kind == "last" else v for n, (kind, v) in scans.items()}
    parts = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True), "known": lambda v: F.last(v, ignorenulls=True)}
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.struct(*order)), "known": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))}
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    inside = earlier(W.partitionBy(*group, "_range").orderBy(*order))
    carried = earlier(W.partitionBy(*group).orderBy("_range"))
    totals = ranged.groupBy(*group, "_range").agg(*(whole[kind](boxed[n]).alias(f"_t_{n}") for n, (kind, _) in scans.items()))
    carry = totals.select(*group, "_range", *(parts[kind](F.col(f"_t_{n}")).over(carried).alias(f"_c_{n}") for n, (kind, _) in scans.items()))
    within = ranged.withColumns({f"_i_{n}": parts[kind](boxed[n]).over(inside) for n, (kind, _) in scans.items()})
    match = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group] + [F.col("a._range") == F.col("b._range")]
    joined = within.alias("a").join(carry.alias("b"), match)

    def whole_of(name: str, kind: str) -> Column:
        here, there = F.col(f"a._i_{name}"), F.col(f"b._c_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        return F.greatest(here, there) if kind == "max" else F.coalesce(here, there)["v"] if kind == "last" else F.coalesce(here, there)

    return joined.select(*(F.col(f"a.{c}") for c in ranged.columns), *(whole_of(n, kind).alias(n) for n, (kind, _) in scans.items()))


def first_of_each(rows: DataFrame, group: list[str], n: int, order: list, salts: int = 64) -> DataFrame:
    """The first n rows of each group: first of each of its salted parts, then of what those keep."""
    columns = rows.columns
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
    part = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order))
    kept = salted.withColumn("_n", part).filter(F.col("_n") <= n)
    return kept.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).select(*columns)


def stride_buckets(rows: DataFrame, group: list[str], order: list[str], buckets: int, out: str = "bucket") -> DataFrame:
    """rows dealt in turn to so many buckets of their group: every row whose number leaves the same rest has the same bucket."""
    return numbered(rows, group, order, "_number").withColumn(out, F.col("_number") % buckets).drop("_number")
