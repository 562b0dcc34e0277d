"""Shots and segments: numbering, cutting, agreement of detectors, runs, frames in shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.functions.scalars import picked, seconds
from shotledger.operators import lineage


def enriched(shots: DataFrame, video: str, fps: Column) -> DataFrame:
    """shots (frame_start, frame_end inclusive) with their number from 1, length and times."""
    order = W.partitionBy(video).orderBy("frame_start", "frame_end")
    return shots.withColumns(
        {
            "shot_id": F.row_number().over(order), "duration_frames": F.col("frame_end") - F.col("frame_start") + 1, "t_start": seconds(F.col("frame_start"), fps),
            "t_end": seconds(F.col("frame_end") + 1, fps), "duration_sec": F.bround((F.col("frame_end") - F.col("frame_start") + 1) / fps, 3),
        }
    )


def merged_cuts(frames: DataFrame, video: str, frame: str, gap: int = 3, rounds: int = 60) -> DataFrame:
    """A row for each cut that is kept: those more than gap after the last that was kept, from the first on.

    Each cut's successor is the first cut beyond the gap, whoever keeps it; what the first cut of a video reaches over
    successors is kept. Links double in length in each round, so that rounds grow with the logarithm of what a video keeps.
    """
    cuts = frames.select(F.col(video).alias("v"), F.col(frame).cast("long").alias("c")).filter("c IS NOT NULL").distinct()
    # From the last cut down, each cut stands before the question for what lies beyond it, and the last known cut is the answer.
    lines = cuts.select("v", F.explode(F.array(F.struct((-F.col("c")).alias("o"), F.lit(1).alias("kind"), F.col("c").alias("c")), F.struct((-F.col("c") - gap).alias("o"), F.lit(0).alias("kind"), F.col("c").alias("c")))).alias("l")).select("v", "l.*")
    order = ["o", "kind", "c"]
    answered = lineage.before(lineage.dealt(lines, ["v"], order), ["v"], order, next=("known", F.when(F.col("kind") == 1, F.col("c"))))
    links = lineage.cut(answered.filter((F.col("kind") == 0) & F.col("next").isNotNull()).select("v", "c", "next"))
    kept = lineage.cut(cuts.groupBy("v").agg(F.min("c").alias("c")))
    for _ in range(rounds):
        reached = kept.join(links, ["v", "c"]).select("v", F.col("next").alias("c"))
        # What is reached over links of one length was not reached over shorter ones.
        after = lineage.cut(kept.union(reached))
        links, grown = links.select("v", "c", F.col("next").alias("n")).join(links.select("v", F.col("c").alias("n"), "next"), ["v", "n"]).select("v", "c", "next"), after
        links = lineage.cut(links)
        kept = grown
        if links.isEmpty():
            return kept.select(F.col("v").alias(video), F.col("c").alias("cut"))
    raise RuntimeError(f"the cuts did not settle in {rounds} rounds")


def segments(cuts: DataFrame, totals: DataFrame, video: str) -> DataFrame:
    """Inclusive segments that the cuts leave of frames 0..total-1; one segment without cuts. A cut begins a segment, so that
    one at frame 0 leaves the empty segment [0, -1] before it."""
    own = cuts.select(video, F.col("cut").cast("long").alias("cut"))
    ranged = lineage.dealt(own, [video], ["cut"])
    ended = lineage.before(ranged, [video], ["cut"], frame_start=("max", F.col("cut"))).select(video, F.coalesce("frame_start", F.lit(0)).alias("frame_start"), (F.col("cut") - 1).alias("frame_end"))
    last = totals.join(ranged.groupBy(video).agg(F.max("cut").alias("_last")), video, "left")
    return ended.join(totals.select(video), video, "left_semi").union(last.select(video, F.coalesce("_last", F.lit(0)).alias("frame_start"), (F.col("total") - 1).alias("frame_end")))


def inclusive(ranges: DataFrame, start: str, end: str, label: str, kept: str = "general") -> DataFrame:
    """Half-open ranges of one label as inclusive ones, the empty left out."""
    return ranges.filter((F.col(label) == kept) & (F.col(end) > F.col(start))).withColumn(end, F.col(end) - 1)


def consensus(*detectors: Column) -> Column:
    """The first list that is there and not empty."""
    return F.coalesce(*(F.when(F.size(d) > 0, d) for d in detectors))


def agreement(a: Column, b: Column, tolerance: Column) -> Column:
    """Two lists of starts: whether they are as many and each start lies within the tolerance of its counterpart. A list that isn't there doesn't agree."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.struct(
        F.coalesce(F.size(a) == F.size(b), F.lit(False)).alias("shot_count_match"),
        F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False)).alias("boundaries_within_tolerance"),
        F.when(a.isNull() | b.isNull(), F.lit("unavailable")).otherwise(F.lit("")).alias("note"),
    )


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order, which should leave no ties: number (from 1), start (position from 0), length and value."""
    ranged = lineage.dealt(rows.select(*keys, *order, *([] if value in [*keys, *order] else [value])), keys, order)
    seen = lineage.before(ranged, keys, order, _at=("sum", F.lit(1).cast("long")), _was=("last", F.col(value)))
    marked = seen.withColumn("_new", ((F.col("_at") == 0) | ~F.col("_was").eqNullSafe(F.col(value))).cast("long"))
    numbered = lineage.before(marked, keys, order, run=("sum", F.col("_new"))).withColumn("run", F.col("run") + F.col("_new"))
    return numbered.groupBy(*keys, "run").agg(F.min("_at").alias("run_start"), F.count("*").alias("run_len"), F.first(value).alias(value))


def cells(start: Column, end: Column) -> Column:
    """The fewest dyadic cells (level, cell) that make up the frames start..end: two of a level at the most; none if end is before start."""
    shift = lambda x, l: F.call_function("shiftright", x, l)
    first, last = start.cast("long"), end.cast("long") + 1

    def of(level: Column) -> Column:
        low, high = -shift(-first, level), shift(last, level)
        odd = lambda x: (x.bitwiseAND(F.lit(1)) == 1) & (low < high)
        return F.array_compact(F.array(F.when(odd(low), F.struct(level.alias("level"), low.alias("cell"))), F.when(odd(high), F.struct(level.alias("level"), (high - 1).alias("cell")))))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(last - first, F.lit(1)) + 1)).cast("int"))
    return F.flatten(F.transform(levels, of))


def frames_in_shots(frames: DataFrame, shots: DataFrame, video: str, frame: str) -> DataFrame:
    """Each frame with the shots that hold it, which may overlap.

    A shot is copied to the dyadic cells that it is made of, some two for each doubling of its length, and a frame asks for the cell that it
    lies in on each level that some shot has: an equi-join on video, level and cell, in which every pair meets once.
    """
    parts = shots.withColumn("_cell", F.explode(cells(F.col("frame_start"), F.col("frame_end")))).select("*", F.col("_cell.level").alias("_level"), F.col("_cell.cell").alias("_at")).drop("_cell")
    # At most 64 numbers.
    levels = sorted(r[0] for r in parts.select("_level").distinct().collect())
    asked = frames.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_at", F.call_function("shiftright", F.col(frame).cast("long"), F.col("_level")))
    return asked.join(parts, [video, "_level", "_at"]).drop("_level", "_at")


def sampled_frames(start: Column, end: Column, stride: int = 1, most: int = 8) -> Column:
    """Frame numbers: every stride-th of a shot, thinned evenly to `most`."""
    every = F.sequence(start, F.greatest(start, end), F.lit(stride).cast("long"))
    return F.transform(picked(F.size(every), most), lambda i: F.get(every, i))
