"""Queries that fold results."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.operators import rollup
from shotledger.plans.base import RESULTS, query, r6, read, results, scratch
from shotledger.sources.documents import markdown
from shotledger.streaming import leaderboard

M = ["psq", "ee_v3", "ses"]
FOLD = "fold AS (SELECT task_id, sample_id, count(*) AS k_count, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in M) + " FROM results GROUP BY ALL)"
ROUNDED = ", ".join(f"round({m}_mean, 6) AS {m}_mean, round({m}_std, 6) AS {m}_std" for m in M)


def _rounded(df, *keys):
    return df.select(*keys, *(r6(f"{m}_{x}").alias(f"{m}_{x}") for m in M for x in ("mean", "std")))


def _fold(spark, sf_dir):
    return rollup.fold_samples(results(spark, sf_dir), ["task_id", "sample_id"], M)


@query(f"WITH {RESULTS}, {FOLD} SELECT task_id, sample_id, k_count, {ROUNDED} FROM fold")
def k_sample_fold(spark, sf_dir):
    return _rounded(_fold(spark, sf_dir), "task_id", "sample_id", "k_count")


MACRO = "macro AS (SELECT task_id, count(*) AS n_prompts, max(k_count) AS k_samples, " + ", ".join(f"avg({m}_mean) AS {m}_mean, stddev_samp({m}_mean) AS {m}_std" for m in M) + " FROM fold GROUP BY ALL)"


@query(f"WITH {RESULTS}, {FOLD}, {MACRO} SELECT task_id, n_prompts, k_samples, {ROUNDED} FROM macro")
def task_macro_mean(spark, sf_dir):
    return _rounded(rollup.macro_mean(_fold(spark, sf_dir), ["task_id"], M), "task_id", "n_prompts", "k_samples")


@query(f"""WITH {RESULTS}, r AS (SELECT task_id, (n % 4)::VARCHAR AS op, psq FROM results)
SELECT task_id, coalesce(op, 'all') AS op, count(*) AS n, round(avg(psq), 6) AS psq FROM r GROUP BY GROUPING SETS ((task_id, op), (task_id))""")
def operation_breakdown(spark, sf_dir):
    rows = results(spark, sf_dir).select("task_id", (F.col("n") % 4).cast("string").alias("op"), "psq")
    return rollup.with_totals(rows, ["task_id"], "op", [F.count("*").alias("n"), r6(F.avg("psq")).alias("psq")])


FIVE = ["psq", "ee_v3", "csep_v3", "nep", "ses"]
SCORED = "five AS (SELECT task_id, sample_id, psq, ee_v3, ses, CASE WHEN k % 4 > 0 THEN 0.5 * ee_v3 + 0.25 END AS csep_v3, CASE WHEN task_id <> 'click' THEN 1 - psq END AS nep FROM results), f AS (SELECT task_id, sample_id, " + ", ".join(f"avg({m}) AS {m}" for m in FIVE)
SCORED += " FROM five GROUP BY ALL), m AS (SELECT task_id, " + ", ".join(f"avg({m}) AS {m}" for m in FIVE) + f" FROM f GROUP BY ALL), s AS (SELECT task_id, CASE WHEN task_id = 'view' THEN ses ELSE list_avg(list_filter([{', '.join(FIVE)}], lambda x: x IS NOT NULL)) END AS task_score FROM m)"


@query(f"WITH {RESULTS}, {SCORED} SELECT task_id, round(task_score, 6) AS task_score, round(avg(task_score) OVER (), 6) AS overall FROM s")
def task_scores(spark, sf_dir):
    """The mean of the five headline metrics, of which a task may have none of some, and the mean over tasks."""
    rows = results(spark, sf_dir).withColumns({"csep_v3": F.when(F.col("k") % 4 > 0, 0.5 * F.col("ee_v3") + 0.25), "nep": F.when(F.col("task_id") != "click", 1 - F.col("psq"))})
    macro = rollup.macro_mean(rollup.fold_samples(rows, ["task_id", "sample_id"], FIVE), ["task_id"], FIVE)
    scored = rollup.task_score(macro, [f"{m}_mean" for m in FIVE], "ses_mean", structural_task="view")
    overall = scored.agg(F.avg("task_score"))
    return scored.select("task_id", r6("task_score").alias("task_score"), r6(overall.scalar()).alias("overall"))


@query(f"""WITH {RESULTS}, {FOLD}, {MACRO} SELECT 'm' AS baseline, task_id, n_prompts, k_samples, round(psq_mean, 6) AS psq_mean, round(psq_std, 6) AS psq_std, round(ee_v3_mean, 6) AS ee_v3_mean, round(ee_v3_std, 6) AS ee_v3_std FROM macro""")
def streamed_leaderboard(spark, sf_dir):
    """Results that arrive in batches: some first with other values, then all, then some of those again, late and as they were."""
    final = results(spark, sf_dir).select(F.lit("m").alias("baseline"), "task_id", F.col("sample_id").cast("string").alias("sample_id"), "k", "psq", "ee_v3", F.lit(2).cast("long").alias("updated_at"), "n")
    first = final.filter("n % 3 = 0").withColumns({"psq": F.col("ee_v3") / 2, "ee_v3": F.lit(0.5), "updated_at": F.lit(1).cast("long")})
    folder, schema = scratch(spark, "stream"), "baseline string, task_id string, sample_id string, k int, psq double, ee_v3 double, updated_at long"
    late = first.filter("n % 2 = 0").unionByName(final.filter("n % 5 = 0"))
    for batch in (first, final, late):
        batch.drop("n").write.mode("append").json(f"{folder}/in")
        leaderboard.follow(spark, f"{folder}/in", schema, f"{folder}/board", ["psq", "ee_v3"], f"{folder}/checkpoint").awaitTermination()
    board = leaderboard.current(spark, f"{folder}/board", ["psq", "ee_v3"])
    return board.select("baseline", "task_id", "n_prompts", "k_samples", *(r6(f"{m}_{x}").alias(f"{m}_{x}") for m in ("psq", "ee_v3") for x in ("mean", "std")))


@query(f"""WITH {RESULTS}, {FOLD}, {MACRO} SELECT '| task_id | n_prompts | psq_mean |' || chr(10) || '|---|---|---|' || chr(10) ||
string_agg('| ' || task_id || ' | ' || n_prompts || ' | ' || coalesce(format('{{:.4f}}', psq_mean), '') || ' |', chr(10) ORDER BY task_id) AS markdown FROM macro""")
def leaderboard_markdown(spark, sf_dir):
    return markdown(rollup.macro_mean(_fold(spark, sf_dir), ["task_id"], M), ["task_id", "n_prompts", "psq_mean"], ["task_id"])


@query(f"WITH {RESULTS} SELECT task_id, sample_id, k, round(psq, 6) AS psq FROM results QUALIFY row_number() OVER (PARTITION BY task_id, sample_id ORDER BY k DESC) = 1")
def latest_result_wins(spark, sf_dir):
    return rollup.latest_wins(results(spark, sf_dir).select("task_id", "sample_id", "k", "psq"), ["task_id", "sample_id"], ["k"]).withColumn("psq", r6("psq"))


@query(f"""WITH {RESULTS}, r AS (SELECT task_id, sample_id, k, coalesce(CASE WHEN event_id % 3 = 0 THEN ses END, psq) AS psq FROM results),
f AS (SELECT task_id, sample_id, avg(psq) AS m FROM r GROUP BY ALL) SELECT task_id, count(*) AS n_prompts, round(avg(m), 6) AS psq_mean FROM f GROUP BY task_id""")
def partial_update(spark, sf_dir):
    rows = results(spark, sf_dir)
    new = rows.filter(F.col("event_id") % 3 == 0).select("task_id", "sample_id", "k", F.col("ses").alias("psq"))
    again = rollup.fold_samples(rollup.update_then(rows.select("task_id", "sample_id", "k", "psq"), new, ["task_id", "sample_id", "k"], ["psq"]), ["task_id", "sample_id"], ["psq"])
    return rollup.macro_mean(again, ["task_id"], ["psq"]).select("task_id", "n_prompts", r6("psq_mean").alias("psq_mean"))


@query("""SELECT event_type AS task_id, arg_min(user_id, event_id) AS baseline, arg_min(props, event_id) AS snapshot FROM events GROUP BY 1""")
def first_shard_metadata(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("task_id"), F.col("user_id").alias("baseline"), F.col("props").alias("snapshot"), "event_id")
    return rollup.first_metadata(e, ["task_id"], ["baseline", "snapshot"], "event_id")


@query("SELECT CASE WHEN value >= 2 THEN floor(value / 20)::BIGINT::VARCHAR END AS bucket, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.when(F.col("value") >= 2, F.floor(F.col("value") / 20)).alias("v"))
    return rollup.histogram(e, "v")


@query(f"""WITH {RESULTS} SELECT task_id, sample_id, list(k ORDER BY k) AS ks, list(round(psq, 6) ORDER BY k) AS psqs FROM results WHERE psq IS NOT NULL GROUP BY ALL""")
def nested_details(spark, sf_dir):
    rows = results(spark, sf_dir).filter("psq IS NOT NULL").groupBy("task_id", "sample_id").agg(F.array_sort(F.collect_list(F.struct("k", "psq"))).alias("d"))
    return rows.select("task_id", "sample_id", F.transform("d", lambda x: x["k"]).alias("ks"), F.transform("d", lambda x: r6(x["psq"])).alias("psqs"))
