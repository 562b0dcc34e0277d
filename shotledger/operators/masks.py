"""Masks as runs of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.operators import lineage


def union(runs: DataFrame, keys: list[str], start: str = "run_start", length: str = "run_len") -> DataFrame:
    """Runs of the pixels that any of a frame's runs covers, apart and in order."""
    rows = runs.filter(F.col(length) > 0).groupBy(*keys, F.col(start).cast("long").alias(start)).agg(F.max(F.col(start) + F.col(length)).alias("_end"))
    order = [start]
    seen = lineage.before(lineage.dealt(rows, keys, order), keys, order, _before=("max", F.col("_end")))
    marked = seen.withColumn("_new", F.coalesce((F.col(start) > F.col("_before")).cast("long"), F.lit(1)))
    numbered = lineage.before(marked, keys, order, _run=("sum", F.col("_new"))).withColumn("_run", F.col("_run") + F.col("_new"))
    return numbered.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max("_end").alias("_end")).select(*keys, start, (F.col("_end") - F.col(start)).alias(length))


def measures(runs: DataFrame, keys: list[str], width: str, start: str = "run_start", length: str = "run_len", least: int = 100) -> DataFrame:
    """Area, bounding box and whether the mask counts, of runs that are apart."""
    end = F.col(start) + F.col(length) - 1
    wraps = F.floor(end / F.col(width)) > F.floor(F.col(start) / F.col(width))
    x0, x1 = F.when(wraps, 0).otherwise(F.col(start) % F.col(width)), F.when(wraps, F.col(width) - 1).otherwise(end % F.col(width))
    out = runs.groupBy(*keys).agg(F.sum(length).alias("area"), F.min(x0).alias("x0"), F.min(F.floor(F.col(start) / F.col(width))).alias("y0"), F.max(x1).alias("x1"), F.max(F.floor(end / F.col(width))).alias("y1"))
    return out.withColumn("hit", F.col("area") >= least)


def complement(runs: DataFrame, frames: DataFrame, keys: list[str], pixels: str, start: str = "run_start", length: str = "run_len") -> DataFrame:
    """Runs of a frame's pixels 0..pixels-1 that none of its runs, which are apart, covers; a frame without runs is one run."""
    ends = runs.select(*keys, F.col(start).cast("long").alias("_begin"), (F.col(start) + F.col(length)).cast("long").alias("_end"))
    ranged = lineage.dealt(ends, keys, ["_begin"])
    inner = lineage.before(ranged, keys, ["_begin"], _at=("max", F.col("_end"))).join(frames.select(*keys), keys, "left_semi").select(*keys, F.coalesce("_at", F.lit(0)).alias("_at"), F.col("_begin").alias("_next"))
    last = frames.join(ranged.groupBy(*keys).agg(F.max("_end").alias("_at")), keys, "left").select(*keys, F.coalesce("_at", F.lit(0)).alias("_at"), F.col(pixels).alias("_next"))
    return inner.union(last).select(*keys, F.col("_at").alias(start), (F.col("_next") - F.col("_at")).alias(length)).filter(F.col(length) > 0)


def decoded(masks: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Runs of set pixels from run lengths that alternate, unset first. Each length is a row, and starts are running sums over a mask's rows."""
    rows = masks.select(*keys, F.posexplode(counts).alias("_i", "_n"))
    starts = lineage.before(lineage.dealt(rows, keys, ["_i"]), keys, ["_i"], run_start=("sum", F.col("_n").cast("long")))
    return starts.filter("_i % 2 = 1 AND _n > 0").select(*keys, "run_start", F.col("_n").cast("long").alias("run_len"))


def clipped(boxes: DataFrame, width: int, height: int, least: int = 16, score: str | None = None, min_score: float = 0.3) -> DataFrame:
    """Boxes (x0, y0, x1, y1) held to the picture; those with a side under `least` go, and those whose score is under min_score."""
    clip = {"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width)), "y0": F.greatest("y0", F.lit(0)), "y1": F.least("y1", F.lit(height))}
    kept = boxes.withColumns(clip).filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    return kept.filter(F.col(score) >= min_score) if score else kept
