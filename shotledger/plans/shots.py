"""Queries on shots and segments, and on the quality of their detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.functions import scalars
from shotledger.operators import quality, segments
from shotledger.plans.base import SHOTS, query, r6, read, shots

CUTS = """cuts AS (SELECT DISTINCT user_id, ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 60000000)::BIGINT AS f, event_type FROM events),
clicks AS (SELECT DISTINCT user_id, f FROM cuts WHERE event_type = 'click')"""
KEPT = """kept AS (WITH RECURSIVE w(user_id, cut) AS (SELECT user_id, min(f) FROM clicks GROUP BY user_id
  UNION ALL (SELECT w.user_id, min(c.f) FROM w JOIN clicks c ON c.user_id = w.user_id AND c.f - w.cut > 600 GROUP BY w.user_id, w.cut)) SELECT * FROM w)"""


def _minutes(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_type", "event_id").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = e.groupBy("user_id").agg(F.min("us").alias("t0"))
    return e.join(first, "user_id").select("user_id", F.floor((F.col("us") - F.col("t0")) / 60_000_000).alias("f"), "event_type", "event_id")


def _kept(spark, sf_dir):
    clicks = _minutes(spark, sf_dir).filter("event_type = 'click'").select("user_id", "f").distinct()
    return segments.merged_cuts(clicks, "user_id", "f", gap=600)


@query(f"WITH {CUTS}, {KEPT} SELECT user_id, cut FROM kept")
def greedy_cut_merge(spark, sf_dir):
    return _kept(spark, sf_dir)


@query(f"""WITH {CUTS}, {KEPT}, t AS (SELECT user_id, max(f) + 1 AS total FROM cuts GROUP BY 1), s AS (SELECT user_id, cut AS st FROM kept UNION ALL SELECT user_id, -1 FROM t)
SELECT user_id, greatest(st, 0)::BIGINT AS frame_start, (coalesce(lead(st) OVER (PARTITION BY user_id ORDER BY st), total) - 1)::BIGINT AS frame_end FROM s JOIN t USING (user_id)""")
def cut_segments(spark, sf_dir):
    totals = _minutes(spark, sf_dir).groupBy("user_id").agg((F.max("f") + 1).alias("total"))
    return segments.segments(_kept(spark, sf_dir), totals, "user_id")


@query(f"""WITH {SHOTS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_start, frame_end) AS shot_id, frame_end - frame_start + 1 AS duration_frames,
round_even(frame_start / 16, 3) AS t_start, round_even((frame_end + 1) / 16, 3) AS t_end, round_even((frame_end - frame_start + 1) / 16, 3) AS duration_sec FROM shots""")
def shot_table(spark, sf_dir):
    rows = segments.enriched(shots(spark, sf_dir), "video_id", F.lit(16.0))
    return rows.select("video_id", F.col("shot_id").cast("long").alias("shot_id"), "duration_frames", "t_start", "t_end", "duration_sec")


@query("""SELECT o_orderkey, o_custkey AS s, o_custkey + o_orderkey % 50 - 1 AS e FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 50 > 0""")
def half_open_ranges(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("s"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("e"), "o_orderstatus")
    return segments.inclusive(o, "s", "e", "o_orderstatus", "O").select("o_orderkey", "s", "e")


DETECTED = f"""{SHOTS}, det AS (SELECT video_id, list(frame_start ORDER BY frame_start) FILTER (video_id % 5 <> 0) AS a, list(frame_start + (video_id % 9) ORDER BY frame_start) FILTER (turn < 6) AS b,
  list(frame_start ORDER BY frame_start) AS c FROM shots GROUP BY video_id)"""


def _detected(spark, sf_dir):
    s = shots(spark, sf_dir)
    lists = lambda c, keep: F.array_sort(F.collect_list(F.when(keep, c)))
    d = s.groupBy("video_id").agg(lists(F.col("frame_start"), F.col("video_id") % 5 != 0).alias("a"), lists(F.col("frame_start") + F.col("video_id") % 9, F.col("turn") < 6).alias("b"), lists(F.col("frame_start"), F.lit(True)).alias("c"))
    return d.select("video_id", *(F.when(F.size(x) > 0, F.col(x)).alias(x) for x in "abc"))


@query(f"WITH {DETECTED} SELECT video_id, coalesce(a, b, c) AS starts, len(coalesce(a, b, c)) AS n_shots FROM det")
def detector_consensus(spark, sf_dir):
    d = _detected(spark, sf_dir).withColumn("starts", segments.consensus(F.col("a"), F.col("b"), F.col("c")))
    return d.select("video_id", "starts", F.size("starts").cast("long").alias("n_shots"))


@query(f"""WITH {DETECTED} SELECT video_id, coalesce(len(a) = len(b), false) AS shot_count_match,
coalesce(len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda x: abs(x[1] - x[2]) > 0.25 * 16)) = 0, false) AS boundaries_within_tolerance, CASE WHEN a IS NULL OR b IS NULL THEN 'unavailable' ELSE '' END AS note FROM det""")
def detector_agreement(spark, sf_dir):
    return _detected(spark, sf_dir).withColumn("g", segments.agreement(F.col("a"), F.col("b"), F.lit(0.25 * 16))).select("video_id", "g.*")


@query("""WITH m AS (SELECT user_id, event_id, value > 40 AS v, row_number() OVER w - 1 AS p, coalesce(value > 40 IS DISTINCT FROM lag(value > 40) OVER w, true) AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN p = 0 OR nw THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p) AS run FROM m) SELECT user_id, run::BIGINT AS run, min(p) AS run_start, count(*) AS run_len, bool_or(v) AS v FROM r GROUP BY user_id, run""")
def run_lengths(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "ts", "event_id", "value").withColumn("v", F.col("value") > 40)
    return segments.runs(e, ["user_id"], ["ts", "event_id"], "v").select("user_id", "run", "run_start", "run_len", "v")


@query(f"""WITH {SHOTS}, f AS (SELECT user_id AS video_id, event_id, (event_id * 7919) % 6000 AS frame FROM events)
SELECT f.video_id, f.event_id, frame, turn, frame_start FROM f JOIN shots s ON f.video_id = s.video_id AND frame BETWEEN frame_start AND frame_end""")
def frames_in_shots(spark, sf_dir):
    f = read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", ((F.col("event_id") * 7919) % 6000).alias("frame"))
    return segments.frames_in_shots(f, shots(spark, sf_dir), "video_id", "frame").select("video_id", "event_id", "frame", "turn", "frame_start")


@query(f"""WITH {SHOTS}, s AS (SELECT video_id, turn, range(frame_start, frame_end + 1, 5) AS f FROM shots) SELECT video_id, turn,
CASE WHEN len(f) = 1 THEN f ELSE list_transform(range(0, least(len(f), 8)), lambda i: f[floor(i * (len(f) - 1) / greatest(least(len(f), 8) - 1, 1))::BIGINT + 1]) END AS frames FROM s""")
def sampled_frames(spark, sf_dir):
    return shots(spark, sf_dir).select("video_id", "turn", segments.sampled_frames(F.col("frame_start"), F.col("frame_end"), 5, 8).alias("frames"))


@query(f"""WITH {SHOTS}, p AS (SELECT video_id, turn, (frame_end - frame_start) % 11 AS a, turn + 2 AS b FROM shots), q AS (SELECT *, least(a, b) AS n, greatest(1, least(a, b, 3)) AS m FROM p)
SELECT video_id, turn, CASE WHEN n < 1 THEN []::INT[] WHEN m = 1 THEN [floor((n - 1) / 2)::INT] ELSE list_transform(range(0, m), lambda i: round_even(i * (n - 1) / greatest(m - 1, 1), 0)::INT) END AS pairs FROM q""")
def paired_indices(spark, sf_dir):
    s = shots(spark, sf_dir)
    return s.select("video_id", "turn", scalars.paired((F.col("frame_end") - F.col("frame_start")) % 11, F.col("turn") + 2, 3).alias("pairs"))


FOUND = """found AS (SELECT conv_id AS video_id, count(*) AS actual, 5 - conv_id % 4 AS expected, CASE WHEN conv_id % 13 = 0 THEN 'unreadable' END AS error,
  CASE WHEN conv_id % 3 > 0 THEN 'c' || conv_id % 3 END AS category FROM conversations GROUP BY conv_id),
rec AS (SELECT *, CASE WHEN error IS NULL THEN actual - expected END AS diff, coalesce(error IS NULL AND actual = expected, false) AS matches FROM found)"""


def _recorded(spark, sf_dir):
    c = read(spark, sf_dir, "conversations", "conv_id").groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("actual"))
    v = F.col("video_id")
    return quality.records(c.select(v, "actual", (5 - v % 4).alias("expected"), F.when(v % 13 == 0, "unreadable").alias("error"), F.when(v % 3 > 0, F.concat(F.lit("c"), (v % 3).cast("string"))).alias("category")))


@query(f"""WITH {FOUND} SELECT count(*) AS total, count_if(diff = 0) AS exact, count_if(abs(diff) = 1) AS off_by_one, count_if(abs(diff) > 1) AS off_more, count_if(error IS NOT NULL) AS failed,
round_even(count_if(diff = 0) / count(*), 3) AS hit_rate FROM rec""")
def detection_summary(spark, sf_dir):
    return quality.summary(_recorded(spark, sf_dir))


@query(f"WITH {FOUND} SELECT video_id, diff, matches AS matches_expected, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN diff <> 0 THEN 'diff=' || diff ELSE '' END AS note FROM rec")
def detection_records(spark, sf_dir):
    return _recorded(spark, sf_dir).select("video_id", "diff", "matches_expected", "note")


@query(f"WITH {FOUND} SELECT coalesce(category, 'unknown') AS category, count(*) AS total, count_if(matches) AS exact, round_even(count_if(matches) / count(*), 3) AS hit_rate FROM rec GROUP BY 1")
def category_hit_rates(spark, sf_dir):
    return quality.by_category(_recorded(spark, sf_dir))


@query(f"""WITH {DETECTED}, {FOUND}, s AS (SELECT count_if(diff = 0) / count(*) AS h, count_if(abs(diff) = 1) AS o, count_if(abs(diff) > 1) AS m FROM rec), g AS (SELECT count_if(len(a) = len(b)) / nullif(count(a), 0) AS g FROM det)
SELECT unnest(list_filter([CASE WHEN h >= .85 THEN 'ready' END, CASE WHEN h >= .7 AND h < .85 THEN 'review' END, CASE WHEN h < .7 THEN 'retune' END, CASE WHEN o > m THEN 'off by one dominates' END, CASE WHEN g < .7 THEN 'detectors disagree' END],
lambda x: x IS NOT NULL)) AS recommendation FROM s, g""")
def detection_advice(spark, sf_dir):
    counted = _detected(spark, sf_dir).select(*(F.when(F.col(x).isNotNull(), F.size(x)).alias(x) for x in "ab"))
    agreement = quality.count_agreement(counted, "a", "b")
    report = quality.summary(_recorded(spark, sf_dir))
    return quality.recommendations(report.withColumns({c: agreement.select(c).scalar() for c in agreement.columns}))


@query("""SELECT s_suppkey AS snapshot, e AS error FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'missing snapshot_id' END, CASE WHEN s_nationkey % 5 = 0 THEN 'no models' END,
CASE WHEN s_nationkey % 5 > 0 AND s_suppkey % 3 > 0 AND s_suppkey % 4 = 0 THEN 'no date: m' END], lambda x: x IS NOT NULL)) AS e FROM supplier)""")
def config_violations(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.lit("m@2026-01-01")).otherwise(F.lit("m"))
    models = F.when(F.col("s_nationkey") % 5 > 0, F.create_map(F.lit("m"), F.struct(name.alias("model"), F.when(key % 4 > 0, F.lit("2026-01-01")).alias("captured_at"))))
    named = s.select(key.alias("snapshot"), F.when(key % 7 > 0, key.cast("string")).alias("snapshot_id"), models.alias("models"))
    return quality.config_errors(named, "snapshot").select("snapshot", "error")
