"""Invariants of the metrics, and where null and zero part."""

import pytest
from pyspark.sql import functions as F

from shotledger.operators import metrics, rollup


def one(df, column):
    return df.collect()[0][column]


def harmonic(spark, values):
    return metrics.propagation_harmonic(spark.createDataFrame([(1, v) for v in values], "s int, e double"), ["s"], "e").collect()[0]


def test_equal_strong_effects_propagate(spark):
    r = harmonic(spark, [1.0, 1.0, 1.0])
    assert r["csep"] > 0.99 and r["coverage"] == 1.0


def test_one_shot_of_three_hardly_propagates(spark):
    r = harmonic(spark, [1.0, 0.0, 0.0])
    assert r["coverage"] < 0.5 and r["csep"] < 0.6


def test_a_single_shot_is_not_evaluable(spark):
    assert harmonic(spark, [0.7])["csep"] is None


@pytest.mark.parametrize(("votes", "expected"), [([True, True, False], 0.0), ([True] * 3, 1.0), ([True, None, True], 0.0)])
def test_all_votes_must_be_yes(spark, votes, expected):
    rows = spark.createDataFrame([(1, 0, 0.5, v) for v in votes], "s int, shot int, d double, v boolean")
    assert one(metrics.effect_voted(rows, ["s"], "shot", "d", "v"), "ee") == expected


def shots(spark, rows):
    return spark.createDataFrame(rows, "s int, shot int, v array<double>, masked boolean")


def test_an_unchanged_video_is_preserved_and_extra_shots_ignored(spark):
    source = shots(spark, [(1, 0, [1.0, 0.0], True), (1, 1, [0.0, 1.0], True)]).drop("masked")
    edit = shots(spark, [(1, 0, [1.0, 0.0], True), (1, 1, [0.0, 1.0], True), (1, 9, [1.0, 0.0], True)])
    r = metrics.preservation(source, edit, ["s"], "shot", "v", "masked").collect()[0]
    assert r["nep"] > 0.999 and r["n_scored"] == 2 and r["n_skipped"] == 0


def test_missing_masks_are_counted_and_skipped(spark):
    source = shots(spark, [(1, 0, [1.0], True), (1, 1, [1.0], True)]).drop("masked")
    edit = shots(spark, [(1, 0, [1.0], False), (1, 1, [1.0], None)])
    r = metrics.preservation(source, edit, ["s"], "shot", "v", "masked").collect()[0]
    assert r["nep"] is None and r["n_mask_missing"] == 2


@pytest.mark.parametrize(("drift", "off", "expected"), [(0.0, 0.0, 1.0), (2.0, 0.0, 0.0), (0.1, 0.3, 0.7), (None, 0.3, 0.7), (None, 0.0, 1.0)])
def test_side_effects(spark, drift, off, expected):
    row = spark.createDataFrame([(drift, off)], "d double, o double")
    assert one(row.select(metrics.side_effect_safety(F.col("d"), F.col("o")).alias("x")), "x") == pytest.approx(expected)


def test_off_target_without_absent_shots_is_zero(spark):
    rows = spark.createDataFrame([(1, False, 0.1, 0.9)], "s int, absent boolean, b double, a double")
    assert one(metrics.off_target(rows, ["s"], "absent", "b", "a"), "off_target") == 0.0


def test_stills_have_no_identity_and_near_copies_have(spark):
    still = [(1, s, [1.0, 0.0]) for s in (0, 1) for _ in range(3)]
    rows = spark.createDataFrame(still, "s int, shot int, v array<double>")
    assert one(metrics.cross_shot_identity(rows, ["s"], "shot", "v"), "cxs_id") == 0.0
    near = [(1, s, [1.0, 0.1 * i]) for s in (0, 1) for i in (-1, 0, 1)]
    assert one(metrics.cross_shot_identity(spark.createDataFrame(near, "s int, shot int, v array<double>"), ["s"], "shot", "v"), "cxs_id") > 0.5


def test_failed_ratings_are_zero_not_null(spark):
    rows = spark.createDataFrame([(1, 0, 0.8), (1, 0, None), (1, 1, 0.6)], "s int, shot int, r double")
    assert one(metrics.effect_rated(rows, ["s"], "shot", "r"), "ee_v3") == pytest.approx(0.5)


def test_psq_is_null_where_nothing_can_be_scored(spark):
    rows = spark.createDataFrame([(1, 60.0, 6.0), (2, None, 6.0)], "s int, musiq double, aes double")
    assert {r["s"]: r["psq"] for r in metrics.psq(rows, ["s"]).collect()} == {1: pytest.approx(0.6), 2: None}


def test_prompts_weigh_the_same_whatever_their_samples(spark):
    rows = spark.createDataFrame([("T1", "a", 1.0), ("T1", "a", 1.0), ("T1", "a", 1.0), ("T1", "b", 0.0), ("T1", "c", None)], "t string, s string, m double")
    prompts = rollup.fold_samples(rows, ["t", "s"], ["m"])
    assert {r["s"]: r["m_std"] for r in prompts.collect()} == {"a": 0.0, "b": None, "c": None}
    r = rollup.macro_mean(prompts, ["t"], ["m"]).collect()[0]
    assert (r["m_mean"], r["n_prompts"], r["k_samples"]) == (0.5, 3, 3)


def test_older_structural_fidelity(spark):
    row = spark.createDataFrame([(0.6534995436668396, 1)], "c double, n int")
    x = row.select(metrics.structural_fidelity(F.col("c")).alias("new"), metrics.structural_fidelity(F.col("c"), F.col("n")).alias("old")).collect()[0]
    assert x["old"] == pytest.approx(0.8267497718334198) and x["new"] == pytest.approx(0.6534995436668396)


def test_missing_positions_count_as_zero(spark):
    rows = spark.createDataFrame([(1, [1.0], [1.0]), (1, None, [1.0])], "s int, a array<double>, b array<double>")
    assert one(metrics.content_alignment(rows, ["s"], "a", "b"), "content_alignment") == 0.5


def test_task_score_skips_nulls(spark):
    rows = spark.createDataFrame([("T1", 0.4, None, 0.9), ("T5", 0.4, 0.2, 0.9), ("T2", None, None, 0.1)], "task_id string, a double, b double, tsf double")
    got = {r["task_id"]: r["task_score"] for r in rollup.task_score(rows, ["a", "b"], "tsf").collect()}
    assert got == {"T1": 0.4, "T5": 0.9, "T2": None}
