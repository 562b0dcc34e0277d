"""Metrics from tables of scores. Null is "not evaluable" and skipped; failures that count are 0 and say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.functions.scalars import unit
from shotledger.functions.vectors import cosine_or_zero, dot, mean_vectors, normalised, spread
from shotledger.operators.align import both_sides, pairs_in_group


#: Fixed value: the reason of a prompt without masks.
NO_MASKS = "required edit-region masks were missing"


def psq(shots: DataFrame, keys: list[str], musiq: str = "musiq", aesthetic: str = "aes") -> DataFrame:
    """Mean over shots of half MUSIQ/100 and half AES/10; null where no shot has both."""
    return shots.groupBy(*keys).agg(F.avg(0.5 * (F.col(musiq) / 100 + F.col(aesthetic) / 10)).alias("psq"))


def effect_rated(pairs: DataFrame, keys: list[str], shot: str, rating: str) -> DataFrame:
    """Rated effect: frame pairs to shots to their mean; an unreadable or failed rating is 0."""
    shots = pairs.groupBy(*keys, shot).agg(F.avg(F.coalesce(rating, F.lit(0.0))).alias("_s"))
    return shots.groupBy(*keys).agg(F.avg("_s").alias("ee_v3"), F.count("*").alias("n_shots"))


def effect_voted(votes: DataFrame, keys: list[str], shot: str, delta: str, vote: str, least: float = 0.05) -> DataFrame:
    """Share of shots whose score rose by more than least and whose votes are all yes."""
    shots = votes.groupBy(*keys, shot).agg((F.bool_and(F.coalesce(vote, F.lit(False))) & (F.max(delta) > least)).alias("_ok"))
    return shots.groupBy(*keys).agg(F.avg(F.coalesce(F.col("_ok"), F.lit(False)).cast("int")).alias("ee"))


def effect_scaled(delta: Column, most: Column) -> Column:
    """A rise as a share of the most that the task allows, 0 to 1."""
    return unit(F.greatest(F.lit(0.0), delta) / F.greatest(most, F.lit(1e-6)))


def propagation_harmonic(shots: DataFrame, keys: list[str], effect: str) -> DataFrame:
    """Coverage (mean effect) and consistency (1 - population deviation / mean), and their harmonic mean; null under two shots."""
    rows = shots.groupBy(*keys).agg(F.count(effect).alias("n"), F.avg(effect).alias("coverage"), F.stddev_pop(effect).alias("_s"))
    steady = unit(1 - F.col("_s") / (F.col("coverage") + 1e-6))
    rows = rows.withColumn("consistency", F.when(F.col("n") >= 2, steady)).drop("_s")
    total = F.col("coverage") + F.col("consistency")
    return rows.withColumn("csep", F.when(F.col("n") >= 2, F.when(total > 0, 2 * F.col("coverage") * F.col("consistency") / F.nullif(total, F.lit(0.0))).otherwise(0.0)))


def propagation_vectors(shots: DataFrame, keys: list[str], shot: str, vector: str, effect: str) -> DataFrame:
    """Consistency (mean cosine of pairs of shots) and coverage (mean effect, missing 0), and their geometric mean."""
    means = mean_vectors(shots, [*keys, shot], vector)
    pairs = pairs_in_group(means, keys, shot, "vector")
    steady = pairs.groupBy(*keys).agg(unit(F.avg(cosine_or_zero(F.col("vector_a"), F.col("vector_b")))).alias("consistency"), F.count("*").alias("n_pairs"))
    cover = shots.groupBy(*keys, shot).agg(F.avg(F.coalesce(effect, F.lit(0.0))).alias("_e")).groupBy(*keys).agg(F.avg("_e").alias("coverage"))
    return cover.join(steady, keys).withColumn("csep_v2", F.sqrt(F.col("coverage") * F.col("consistency")))


def propagation_rated(pairs: DataFrame, effects: DataFrame, keys: list[str], rating: str, effect: str) -> DataFrame:
    """Mean pair rating (failure 0) and mean rated effect, their geometric mean, and the ratings as a map "a-b" to rating."""
    rated = F.coalesce(rating, F.lit(0.0))
    entry = F.struct(F.concat_ws("-", "a", "b").alias("pair"), rated.alias("score"))
    steady = pairs.groupBy(*keys).agg(F.avg(rated).alias("consistency"), F.count("*").alias("n_pairs"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("pair_scores"))
    cover = effects.groupBy(*keys).agg(F.avg(F.coalesce(effect, F.lit(0.0))).alias("coverage"))
    return cover.join(steady, keys, "left").withColumn("csep_v3", F.sqrt(F.col("coverage") * F.col("consistency")))


def preservation(source: DataFrame, edit: DataFrame, keys: list[str], shot: str, vector: str, masked: str | None = None) -> DataFrame:
    """Mean similarity of source and edited shots, how many were scored and skipped, how many lacked their mask (which are skipped), and nep_reason:
    why there is no mean, where masks were wanted and missing."""
    rows = both_sides(source.withColumnRenamed(vector, "_s"), edit.withColumnRenamed(vector, "_e"), [*keys, shot])
    mask = F.coalesce(F.col(masked), F.lit(False)) if masked else F.lit(True)
    usable = F.col("present") & mask
    out = rows.groupBy(*keys).agg(
        F.avg(F.when(usable, unit(dot(F.col("_s"), F.col("_e"))))).alias("nep"), F.count_if(usable).alias("n_scored"),
        F.count_if(~usable).alias("n_skipped"), F.count_if(F.col("present") & ~mask).alias("n_mask_missing"),
    )
    return out.withColumn("nep_reason", F.when((F.col("n_scored") == 0) & (F.col("n_mask_missing") > 0), NO_MASKS))


def off_target(shots: DataFrame, keys: list[str], absent: str, before: str, after: str, slack: float = 0.02) -> DataFrame:
    """Mean rise beyond the slack over the shots that weren't to change; 0 where there is none."""
    rise = F.when(F.col(absent), F.greatest(F.lit(0.0), F.col(after) - F.col(before) - slack))
    return shots.groupBy(*keys).agg(F.coalesce(F.avg(rise), F.lit(0.0)).alias("off_target"))


def side_effect_safety(id_drift: Column, off: Column) -> Column:
    """1 less the worse of drift and off-target change; a drift that couldn't be measured doesn't count."""
    return unit(1 - F.greatest(F.greatest(F.lit(0.0), off), F.when(id_drift.isNotNull(), F.greatest(F.lit(0.0), id_drift))))


def identity_drift(faces: DataFrame, keys: list[str], shot: str, side: str, area: str, vector: str, face: str) -> DataFrame:
    """Mean over shots of 1 - cosine of the largest faces on both sides (of equal ones the first by its number, face); null where no shot has both."""
    big = faces.groupBy(*keys, shot).pivot(side, ["source", "edit"]).agg(F.max_by(vector, F.struct(F.col(area), -F.col(face))))
    rows = big.withColumn("_d", F.when(F.col("source").isNotNull() & F.col("edit").isNotNull(), F.greatest(F.lit(0.0), 1 - cosine_or_zero(F.col("source"), F.col("edit")))))
    return rows.groupBy(*keys).agg(F.avg("_d").alias("id_drift"))


def cross_shot_identity(frames: DataFrame, keys: list[str], shot: str, vector: str, tau: float = 0.05) -> DataFrame:
    """Mean cosine of the shots' normalised mean vectors, times a factor that falls to 0 as the frames of each shot become one still."""
    means = mean_vectors(frames, [*keys, shot], vector).withColumn("vector", normalised(F.col("vector")))
    pairs = pairs_in_group(means, keys, shot, "vector").groupBy(*keys).agg(F.avg(dot(F.col("vector_a"), F.col("vector_b"))).alias("similarity"))
    moves = spread(frames, [*keys, shot], vector).filter("n >= 2").groupBy(*keys).agg(F.least(F.lit(1.0), F.avg("spread") / tau).alias("acp"))
    return pairs.join(moves, keys, "left").withColumn("cxs_id", unit(F.col("similarity") * F.coalesce("acp", F.lit(0.0))))


def content_alignment(matched: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean over expected positions of the dot product of what is there with what should be; a missing one is 0."""
    return matched.groupBy(*keys).agg(unit(F.avg(F.coalesce(dot(F.col(a), F.col(b)), F.lit(0.0)))).alias("content_alignment"))


def structural_fidelity(content: Column, count_correct: Column | None = None) -> Column:
    """Content alignment; in the older form half of it and half the correct count."""
    return F.coalesce(content, F.lit(0.0)) if count_correct is None else 0.5 * (count_correct + content)


#: Tasks for which a metric means nothing, and why.
NOT_FOR = {"nep": ("T3", "T5", "T6", "T7"), "ee_v3": ("T5", "T7"), "csep_v3": ("T5", "T7"), "id_drift": ("T1",)}
NO_NEP, NO_EFFECT = "NEP not applicable for this task", "not v3-applicable"


def routed(rows: DataFrame, task: str = "task_id", nep_applies: str | None = None, reason: str | None = None) -> DataFrame:
    """rows whose metrics are null where their task has none, with nep_reason and ee_reason. nep_applies and reason: columns of a prompt's own mask policy."""
    skip = {c: F.col(task).isin(*tasks) for c, tasks in NOT_FOR.items()}
    if nep_applies:
        skip["nep"] = ~F.coalesce(F.col(nep_applies), F.lit(False))
    out = rows.withColumns({c: F.when(~s, F.col(c)) for c, s in skip.items() if c in rows.columns})
    why = F.coalesce(F.col(reason), F.lit(NO_NEP)) if reason else F.lit(NO_NEP)
    return out.withColumn("nep_reason", F.when(skip["nep"], why)).withColumn("ee_reason", F.when(skip["ee_v3"], F.concat(F.lit("task "), task, F.lit(" " + NO_EFFECT))))
