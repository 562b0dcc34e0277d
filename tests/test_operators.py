import itertools
import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.functions import prompts, scalars, vectors
from shotledger.operators import align, identity, lineage, masks, promptgen, quality, scoring, segments
from shotledger.sources import commits, documents
from shotledger.streaming import leaderboard
from tests.compare import duck


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def plain_cuts(cuts, gap):
    kept = []
    for c in sorted(set(cuts)):
        if not kept or c - kept[-1] > gap:
            kept.append(c)
    return kept


def test_cuts_are_kept_by_their_distance_to_the_last_kept(spark):
    rng = random.Random(0)
    videos = {"a": [3, 5, 7, 8, 20, 22], "b": [0], None: [4, 1], "c": [rng.randrange(4000) for _ in range(900)], "d": list(range(200)), "e": [None, 7, 7]}
    rows = spark.createDataFrame([(v, c) for v, cuts in videos.items() for c in cuts], "v string, f int")
    got = {}
    for r in segments.merged_cuts(rows.filter("v IS NOT NULL"), "v", "f").collect():
        got.setdefault(r["v"], []).append(r["cut"])
    assert {v: sorted(x) for v, x in got.items()} == {v: plain_cuts([c for c in cuts if c is not None], 3) for v, cuts in videos.items() if v}
    assert segments.merged_cuts(rows.filter("f < 0"), "v", "f").count() == 0
    with pytest.raises(RuntimeError):
        segments.merged_cuts(rows, "v", "f", gap=0, rounds=2)


def windowed(rows, line, value):
    """What window functions give: (sum, max, last, known) before each row."""
    before = line.rowsBetween(W.unboundedPreceding, -1)
    return rows.select("i", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("s"), F.max(value).over(before).alias("m"), F.lag(value).over(line).alias("l"), F.last(value, ignorenulls=True).over(before).alias("k"))


def test_scans_of_one_large_group_equal_windows_and_are_many_tasks(spark, apart):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else None if i % 31 == 0 else f"g{i % 50}", i * 7919 % 3000, i, rng.choice([None, *range(-5, 40)])) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, o int, i int, v int")
    ranged = lineage.dealt(rows, ["g"], ["o"])
    assert ranged.filter("g = 'hot'").select("_range").distinct().count() > 1 and all(r[0] < 1500 for r in ranged.groupBy("_range").count().select("count").collect())
    v = F.col("v")
    got = lineage.before(ranged, ["g"], ["o"], s=("sum", v), m=("max", v), l=("last", v), k=("known", v)).select("i", "s", "m", "l", "k")
    assert sorted(got.collect()) == sorted(windowed(rows, W.partitionBy("g").orderBy("o"), "v").collect())
    assert lineage.before(lineage.dealt(rows.filter("i < 0"), ["g"], ["o"]), ["g"], ["o"], s=("sum", v)).count() == 0


def test_runs_of_a_large_group(spark, apart):
    rng = random.Random(4)
    flags = [rng.choice([True, True, None, False]) for _ in range(2000)]
    rows = spark.createDataFrame([("hot", i, f) for i, f in enumerate(flags)] + [("x", 0, True)], "g string, o int, f boolean")
    want, at = [], 0
    for f, part in itertools.groupby(flags):
        n = len(list(part))
        want.append((at, n, f))
        at += n
    got = segments.runs(rows, ["g"], ["o"], "f").filter("g = 'hot'").orderBy("run").collect()
    assert [(r["run_start"], r["run_len"], r["f"]) for r in got] == want and [r["run"] for r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize(("start", "end"), [(0, 0), (5, 5), (0, 1023), (3, 1_000_000), (-9, 12), (7, 6), (2**40, 2**40 + 12345), (1, 2**41)])
def test_dyadic_cells_make_up_an_interval(spark, start, end):
    got = sorted((c["cell"] << c["level"], (c["cell"] + 1 << c["level"]) - 1) for c in value(spark, segments.cells(F.lit(start).cast("long"), F.lit(end).cast("long"))))
    assert len(got) <= 2 * max(1, (end - start + 2).bit_length())
    assert (got[0][0], got[-1][1]) == (start, end) if end >= start else got == []
    assert all(a[1] + 1 == b[0] for a, b in itertools.pairwise(got))


def test_frames_meet_overlapping_and_long_shots(spark):
    rng = random.Random(5)
    shots = [(rng.choice("ab"), s, s + rng.choice([0, 3, 50, 100_000, -1])) for s in (rng.randrange(-100, 5000) for _ in range(80))]
    frames = [(rng.choice("abc"), rng.randrange(-200, 6000)) for _ in range(200)]
    df = segments.frames_in_shots(spark.createDataFrame(frames, "v string, f int"), spark.createDataFrame(shots, "v string, frame_start long, frame_end long"), "v", "f")
    assert sorted((r["v"], r["f"], r["frame_start"], r["frame_end"]) for r in df.collect()) == sorted((v, f, s, e) for v, f in frames for w, s, e in shots if v == w and s <= f <= e)
    assert "BroadcastNestedLoop" not in df._jdf.queryExecution().toString()


def test_keywords_meet_objects_by_their_beginnings(spark):
    words = [("paint", ["Red", "a", ""]), ("none", ["zzzz", "rednes"]), ("long", ["chair leg", "redness", "ir l"]), ("null", [None, "ä"])]
    items = [(1, ["Dark redness", "x"]), (2, ["", "chair legs"]), (3, ["ÄÖ", None]), (4, [])]
    rules = spark.createDataFrame(words, "op string, kws array<string>")
    df = align.first_keyword_hit(rules, spark.createDataFrame(items, "k int, objects array<string>"), "op", "kws", "k", "objects")
    want = {(k, op): hit for k, objects in items for op, kws in words for hit in [next((o for w in kws if w is not None for o in objects if o is not None and w.lower() in o.lower()), None)] if hit is not None}
    assert {(r["k"], r["op"]): r["object"] for r in df.collect()} == want
    many = spark.range(100_000).select(F.lit("op").alias("op"), F.array(F.concat(F.lit("word"), F.col("id").cast("string"))).alias("kws"))
    plan = align.first_keyword_hit(many, spark.createDataFrame(items, "k int, objects array<string>"), "op", "kws", "k", "objects")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 1000])
def test_a_keyed_permutation_names_every_place_once(spark, n):
    for key in ("a", "b"):
        got = [r[0] for r in spark.range(n).select(promptgen.permuted(F.col("id"), n, "s", F.lit(key))).collect()]
        assert sorted(got) == list(range(n))


def test_a_long_bank_is_sampled_without_a_cross_join(spark):
    bank = spark.range(30_000).select(F.concat(F.lit("v"), "id").alias("v"))
    items = spark.range(200).select(F.col("id").alias("k"))
    df = promptgen.from_bank(items, bank, "k", "v", 3, "s")
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    rows = df.collect()
    assert len(rows) == 600 and len({(r["k"], r["v"]) for r in rows}) == 600 and {r["rank"] for r in rows} == {1, 2, 3} and len({r["v"] for r in rows}) > 500
    assert promptgen.from_bank(items, bank.filter("v = 'v1'"), "k", "v", 3, "s").count() == 200 and promptgen.from_bank(items, bank.limit(0), "k", "v", 3, "s").count() == 0


def test_vector_means_and_spreads_by_partial_sums(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 2 else f"g{i % 7}", [rng.random() for _ in range(5)] if i % 11 else None) for i in range(400)] + [("one", [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    means = {r["g"]: r["vector"] for r in vectors.mean_vectors(df, ["g"], "v").collect()}
    spreads = {r["g"]: (r["spread"], r["n"]) for r in vectors.spread(df, ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        own = [v for h, v in rows if h == g and v]
        assert means[g] == pytest.approx([statistics.fmean(x) for x in zip(*own, strict=True)], abs=1e-12)
        assert spreads[g] == (pytest.approx(statistics.fmean(statistics.pstdev(x) for x in zip(*own, strict=True)), abs=1e-9), len(own))


def test_a_cut_at_the_first_frame_leaves_an_empty_segment(spark):
    cuts = spark.createDataFrame([("a", 0), ("a", 10)], "v string, cut long")
    totals = spark.createDataFrame([("a", 20), ("b", 5)], "v string, total long")
    got = sorted((r["v"], r["frame_start"], r["frame_end"]) for r in segments.segments(cuts, totals, "v").collect())
    assert got == [("a", 0, -1), ("a", 0, 9), ("a", 10, 19), ("b", 0, 4)]


@pytest.fixture
def apart(spark):
    """Small ranges stay tasks of their own, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("reply", "expected"), [("4", 0.8), ("Score: 3/5", 0.6), ("4.55", 0.8), ("10", None), ("-3", 0.6), ("7", 1.0), ("", None), (None, None)])
def test_ratings(spark, reply, expected):
    assert value(spark, scalars.rating(F.lit(reply).cast("string"))) == (None if expected is None else pytest.approx(expected))


def test_seconds_round_half_to_even(spark):
    assert value(spark, scalars.seconds(F.lit(1), F.lit(16.0))) == 0.062


@pytest.mark.parametrize(("label", "expected"), [("b", "B"), (" A.", "A"), ("", None), ("D", None), (None, None)])
def test_winners(spark, label, expected):
    assert value(spark, scalars.winner(F.lit(label).cast("string"))) == expected


def test_orders_with_a_bad_entry_are_null(spark):
    order = lambda xs, text: value(spark, scalars.expected_order(F.lit(xs).cast("array<string>") if xs else F.lit(None).cast("array<string>"), F.lit(text)))
    assert (order(["2", "1"], ""), order(["2", "x"], ""), order(None, "Shot order 3, 1, 2 please"), order(None, "none")) == ([2, 1], None, [3, 1, 2], None)


def test_overlapping_masks_count_once(spark):
    runs = spark.createDataFrame([("f", 0, 60), ("f", 50, 50), ("f", 200, 5), ("f", 100, 0)], "f string, run_start long, run_len long")
    joined = masks.union(runs, ["f"])
    assert sorted((r["run_start"], r["run_len"]) for r in joined.collect()) == [(0, 100), (200, 5)]
    m = masks.measures(joined.withColumn("w", F.lit(64)), ["f"], "w").collect()[0]
    assert (m["area"], m["x0"], m["y0"], m["x1"], m["y1"], m["hit"]) == (105, 0, 0, 63, 3, True)


def test_a_chain_of_neighbours_is_one_cluster(spark):
    rows = [("v", 1, [1.0, 0.0]), ("v", 2, [0.8, 0.6]), ("v", 3, [0.28, 0.96]), ("v", 4, [-1.0, 0.0]), ("w", 5, [1.0, 0.0])]
    got = identity.single_link(spark.createDataFrame(rows, "g string, i long, e array<double>"), "g", "i", "e", 0.75).collect()
    assert {(r["i"], r["cluster_id"]) for r in got} == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 0)}


def test_sample_files(spark):
    paths = spark.createDataFrame([("d/a.mp4",), ("d/a_k0.mp4",), ("d/b_k0.mp4",), ("d/b_k1.mp4",), ("d/b_k7.mp4",), ("d/x.txt",)], "path string")
    pick = lambda k: sorted((r["sample_id"], r["k"], r["path"]) for r in documents.sample_files(paths, k).collect())
    assert pick(1) == [("a", 0, "d/a.mp4"), ("b", 0, "d/b_k0.mp4")]
    assert pick(3) == [("a", 0, "d/a_k0.mp4"), ("b", 0, "d/b_k0.mp4"), ("b", 1, "d/b_k1.mp4")]


def test_documents_of_both_generations_are_read(spark, tmp_path):
    for task, name, doc in (("T1", "a.agg.json", {"sample_id": "a", "k_count": 3, "psq_mean": 0.6, "dps_mean": 0.1}), ("T2", "b.agg.json", {"sample_id": "b", "task_id": "T9"}), ("T2", "c.t5.json", {"sample_id": "c"})):
        (tmp_path / task).mkdir(exist_ok=True)
        (tmp_path / task / name).write_text(json.dumps(doc))
    docs = documents.task_from_path(documents.read_documents(spark, str(tmp_path), documents.PROMPT_AGGREGATE, "*.agg.json"))
    got = {r["sample_id"]: (r["task_id"], r["k_count"], r["psq_mean"], r["ee_mean"]) for r in docs.collect()}
    assert got == {"a": ("T1", 3, 0.6, None), "b": ("T9", None, None, None)}


def test_the_last_log_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video_name,status,url\nv,SUCCESS,old\nw,FAILED,x\n")
    (tmp_path / "zz_b.csv").write_text("video_name,status,url\nv,SUCCESS,new\n")
    log = documents.read_csv(spark, str(tmp_path), "video_name string, status string, url string")
    assert [(r["video_name"], r["url"]) for r in documents.latest_of_log(log, "video_name").collect()] == [("v", "new")]


def test_new_rows_go_back_to_their_places(spark):
    old = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "id string, pos int, t string")
    got = documents.merged_back(old, spark.createDataFrame([("b", "z")], "id string, t string"), "id", "pos").collect()
    assert [(r["id"], r["t"]) for r in got] == [("a", "x"), ("b", "z")]


def test_each_input_is_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(score=pdf["x"] * 2.0)

    out = scoring.score(spark.createDataFrame([(1,), (2,), (1,)], "x long").dropDuplicates(), scorer, "x long, score double")
    assert sorted((r["x"], r["score"]) for r in out.collect()) == [(1, 2.0), (2, 4.0)] and calls.value == 2


ARRIVING = "baseline string, task_id string, sample_id string, k int, psq double, updated_at long"


def arrive(spark, folder, name, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(json.dumps(dict(zip(("baseline", "task_id", "sample_id", "k", "psq", "updated_at"), r, strict=True))) for r in rows))


def followed(spark, folder, check="check", **options):
    paths = {n: str(folder / n) for n in ("in", "out", check)}
    leaderboard.follow(spark, paths["in"], ARRIVING, paths["out"], ["psq"], paths[check], **options).awaitTermination()
    return {(r["baseline"], r["task_id"]): tuple(None if x is None else round(x, 9) for x in r[2:]) for r in leaderboard.current(spark, paths["out"], ["psq"]).collect()}


def test_the_leaderboard_follows_what_arrives_late_again_and_tied(spark, tmp_path):
    rng = random.Random(7)
    rows = [("m", rng.choice(["T1", "T2", None]), rng.choice("abc"), rng.choice([0, 1, None]), rng.choice([None, round(rng.random(), 3)]), rng.choice([1, 2, 2, 3, None])) for _ in range(80)]
    for i in range(4):
        arrive(spark, tmp_path, f"{i}.json", rows[i * 20 : i * 20 + 20] + rows[:5])
        got = followed(spark, tmp_path)
        seen = spark.createDataFrame(rows[: i * 20 + 20], ARRIVING)
        want = leaderboard.board(seen, ["psq"]).collect()
        assert got == {(r["baseline"], r["task_id"]): tuple(None if x is None else round(x, 9) for x in r[2:]) for r in want}
    # The same files in batches of one, by a stream that has lost its checkpoint.
    assert followed(spark, tmp_path, "other", files_per_batch=1) == got
    assert len(commits.batches(spark, str(tmp_path / "out"))) <= leaderboard.KEPT + 1


def test_a_batch_that_comes_again_is_not_added_again(spark, tmp_path):
    arrive(spark, tmp_path, "1.json", [("m", "T1", "a", 0, 0.2, 1), ("m", "T1", "a", 1, 0.4, 1), ("m", "T2", "b", 0, 1.0, 1)])
    assert followed(spark, tmp_path) == {("m", "T1"): (1, 2, 0.3, None), ("m", "T2"): (1, 1, 1.0, None)}
    arrive(spark, tmp_path, "2.json", [("m", "T1", "a", 1, 0.8, 2), ("m", "T1", "c", 0, 0.1, 2)])
    want = {("m", "T1"): (2, 2, 0.3, round(0.08**0.5, 9)), ("m", "T2"): (1, 1, 1.0, None)}
    assert followed(spark, tmp_path) == want
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the run had been lost after the board was committed
    for crc in (tmp_path / "check" / "commits").glob(".1.crc"):
        crc.unlink()
    assert followed(spark, tmp_path) == want


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path):
    root, rows = str(tmp_path / "log"), spark.range(5)
    assert commits.read(spark, root, "id long").count() == 0
    assert commits.commit(rows, root, "a") and not commits.commit(rows, root, "a")
    assert commits.read(spark, root, "id long").count() == 5
    broken = rows.select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(broken, root, "b")
    assert list(commits.batches(spark, root)) == ["a"] and commits.read(spark, root, "id long").count() == 5
    assert commits.commit(rows, root, "b") and commits.read(spark, root, "id long").count() == 10
    commits.batches, known = lambda *_: {}, commits.batches  # as another run that began before "b" was there sees it
    try:
        assert not commits.commit(rows, root, "b")
    finally:
        commits.batches = known
    assert commits.read(spark, root, "id long").count() == 10 and len(list((tmp_path / "log" / "data").iterdir())) == 3  # one of them staged by the lost run


def test_a_second_run_scores_only_what_is_new(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        calls.add(1)
        return float(len(a or "") + 10 * len(b or ""))

    scoring.register("counted", counted)
    rows = spark.createDataFrame([(i, f"a{i % 9}", None if i % 4 == 0 else "b" * (i % 3)) for i in range(60)], "i int, a string, b string")
    distinct = lambda df: df.select("a", "b").distinct().count()
    first = rows.filter("i < 20")
    for df, run, new in ((first, "1", distinct(first)), (rows, "2", distinct(rows) - distinct(first)), (rows, "2", 0), (rows, "3", 0)):
        before = calls.value
        got = scoring.score_new(df, ["a", "b"], "counted", str(tmp_path / "store"), run).collect()
        assert calls.value - before == new and len(got) == df.count() and all(r["score"] == len(r["a"]) + 10 * len(r["b"] or "") for r in got)


def test_clusters_that_do_not_settle_are_an_error(spark):
    angles = [i * 0.1 for i in range(20)]
    rows = spark.createDataFrame([("v", i, [math.cos(x), math.sin(x)]) for i, x in enumerate(angles)], "g string, i long, v array<double>")
    with pytest.raises(RuntimeError):
        identity.single_link(rows, "g", "i", "v", 0.99, rounds=2)


#: Replies, and what they mean: a "no" counts only before the yes, and a leading word must end where it ends.
YES = [("I would say yes, no doubt", True), ("no", False), (" Yes.", True), ("true", True), ("no, rather yes", False), ("I know: yes", False), ("是的", False), ("是 yes", True), ("是", True), ("不, yes", False), ("", False), (None, False), ("yesterday", True), ("nothing", False)]


@pytest.mark.parametrize(("reply", "expected"), YES)
def test_yes_and_no(spark, reply, expected):
    assert value(spark, scalars.says_yes(F.lit(reply).cast("string"))) is expected


OPERATIONS = [("trade places", "reorder"), ("let them trade positions", "reorder"), ("new shot sequence", "reorder"), ("Shot order 1 2", "reorder"), ("please reorder", "reorder"), ("rearrange", "unknown"), ("add one", "unknown"), ("delete it", "unknown"), ("swap", "unknown"), ("reordered", "unknown"), (None, "unknown")]


@pytest.mark.parametrize(("text", "expected"), OPERATIONS)
def test_operations(spark, text, expected):
    assert value(spark, scalars.operation(F.lit(text).cast("string"), F.lit(None).cast("string"))) == expected
    assert value(spark, scalars.operation(F.lit(text).cast("string"), F.lit("reorder"))) == "reorder"


@pytest.mark.parametrize(("given", "text", "expected"), [(None, "shot order 3 1 2", [3, 1, 2]), ([], "shot order 2,1", [2, 1]), ([], "", None), (["3", "x"], "shot order 1", None), (["3", "1"], "shot order 1", [3, 1]), (None, "Shot Order 1,\n 2 then", [1, 2]), (None, "shot order: 1", None)])
def test_expected_orders(spark, given, text, expected):
    assert value(spark, scalars.expected_order(F.lit(given).cast("array<string>") if given is not None else F.lit(None).cast("array<string>"), F.lit(text))) == expected


def test_descriptions_come_from_the_first_character_that_has_one(spark):
    people = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(d).cast("string").alias("desc")) for i, d in (("a", ""), ("a", None), ("b", "other"), ("a", "tall man"))))
    assert value(spark, prompts.entity_description(people, F.lit("a"))) == "tall man" and value(spark, prompts.entity_description(people, F.lit("c"))) is None


@pytest.mark.parametrize(("phrase", "expected"), [("a person with dark red hair color", ("hair color", "dark red")), ("a person with round glasses", ("glasses", "round")), ("a person with a scar", ("attribute", "a scar")), ("a person with hat", ("attribute", "hat")), ("a person with jacket color", ("jacket color", ""))])
def test_attributes_of_phrases(spark, phrase, expected):
    assert tuple(value(spark, prompts.attribute_of(F.lit(phrase)))) == expected


def test_rows_are_numbered_across_ranges(spark):
    rows = spark.createDataFrame([(i % 2 or None, (i * 7) % 50, i) for i in range(50)], "g int, o int, i long")
    got = {r["i"]: r["n"] for r in lineage.numbered(rows, ["g"], ["o"], "n").collect()}
    for g in (None, 1):
        own = sorted(((i * 7) % 50, i) for i in range(50) if (i % 2 or None) == g)
        assert [got[i] for _, i in own] == list(range(25))
    assert sorted(r["i"] for r in lineage.first_of_each(rows, ["g"], 3, ["o"], salts=4).collect()) == sorted(i for g in (None, 1) for _, i in sorted(((i * 7) % 50, i) for i in range(50) if (i % 2 or None) == g)[:3])


def test_pairs_of_vectors_meet_in_tiles(spark):
    angles = [i * 0.37 % 6.28 for i in range(60)]
    rows = spark.createDataFrame([("ab"[i % 2], i, [math.cos(x), math.sin(x)]) for i, x in enumerate(angles)], "g string, i long, v array<double>")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and math.cos(angles[a] - angles[b]) >= 0.9}
    for tile in (7, 1024):
        pairs = identity.similar_pairs(rows, "g", "i", "v", 0.9, tile).collect()
        assert sorted((r["a"], r["b"]) for r in pairs) == sorted(want) and all(r["similarity"] == pytest.approx(math.cos(angles[r["a"]] - angles[r["b"]])) for r in pairs)
        clusters = {r["i"]: r["cluster_id"] for r in identity.single_link(rows, "g", "i", "v", 0.9, tile=tile).collect()}
        assert all(clusters[a] == clusters[b] for a, b in want) and len(clusters) == 60


def test_a_log_goes_on_where_it_stopped(spark, tmp_path):
    rows, path = spark.createDataFrame([(i, f"v{i}") for i in range(9)], "k long, v string"), str(tmp_path / "log")
    documents.append_results(rows.filter("k < 4"), path, ["k"], "k long, v string")
    for _ in range(2):
        assert sorted((r["k"], r["v"]) for r in documents.append_results(rows, path, ["k"], "k long, v string").collect()) == [(i, f"v{i}") for i in range(9)]


def test_partitioned_results_are_pruned_by_task(spark, tmp_path):
    rows = spark.createDataFrame([("m", f"T{i % 3}", i) for i in range(9)], "baseline string, task_id string, v long")
    documents.write_results(rows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("task_id = 'T1'")
    assert sorted(r["v"] for r in got.collect()) == [1, 4, 7] and "PartitionFilters: [isnotnull(task_id" in got._jdf.queryExecution().toString()


def test_advice_follows_the_exact_rate_and_the_detectors(spark):
    def advice(exact, total, agree=9, available=10, one=0, more=0):
        report = spark.createDataFrame([(exact, total, one, more, agree, available)], "exact long, total long, off_by_one long, off_more long, n_agree long, n_available long")
        return [r[0] for r in quality.recommendations(report).collect()]

    assert advice(8496, 10_000) == ["review"] and advice(17, 20) == ["ready"] and advice(0, 0, 0, 0) == ["retune"]
    assert advice(7, 10, 6, 10, one=2, more=1) == ["review", "off by one dominates", "detectors disagree"] and advice(7, 10, 7, 10, one=1, more=1) == ["review"]
    counts = quality.count_agreement(spark.createDataFrame([(3, 3), (3, 4), (3, None), (None, 3), (None, None)], "a int, b int"), "a", "b").first()
    assert (counts["n_available"], counts["n_agree"]) == (3, 1)


def test_captions_keep_their_tags(spark):
    got = value(spark, scalars.multishot_prompt(F.lit("x [wide  shot\n] a\u3000 b\n[close] \n [] c [open")))
    assert (got["prompt"], got["n_shots"]) == ("Shot 1: [wide  shot\n] a bShot 2: [close] Shot 3: [] c ", 3) or (got["prompt"], got["n_shots"]) == ("Shot 1: [wide  shot\n] a bShot 2: [close] Shot 3: [] c", 3)


def test_messages_are_json_with_blanks(spark):
    text = lambda x: F.lit(x).cast("string")
    extra = {"op": text('a "b"\n'), "anchor": text(None), "new_order": F.array(F.lit(3), F.lit(1)), "transition_style": text("é/ü")}
    got = value(spark, prompts.payload(text("T4"), text("do"), text(None), extra, F.array(F.lit(1), F.lit(2))))
    want = {"task_id": "T4", "instruction": "do", "target_phrase": None, "extra": {"op": 'a "b"\n', "transition_style": "é/ü", "new_order": [3, 1]}, "applicable_shots": [1, 2]}
    assert got == "Rewrite this:\n" + json.dumps(want, ensure_ascii=False)


def test_rewritten_prompts_compile_and_leave_other_tasks_alone(spark, capfd):
    rows = spark.createDataFrame([(i, f"T{i % 9}", "desc", f"do {i}", "a person with red hat") for i in range(40)], "i int, task_id string, description string, instruction string, target_phrase string")
    out = promptgen.rewritten(rows, ["i"])
    got = out.collect()
    assert all((r["instruction"] == r["instruction_v1"]) == (r["task_id"] in ("T0", "T8")) for r in got) and "grows beyond 64 KB" not in "".join(capfd.readouterr())
    assert [r["instruction"] for r in sorted(got) if r["task_id"] == "T2"][:2] == ["Put red on the person, in every shot.", "The person now wears red, throughout the video."]


def test_missing_masks_are_named(spark):
    from shotledger.operators import metrics

    source = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [1.0]), ("b", 2, [1.0]), ("c", 1, [1.0])], "s string, shot int, v array<double>")
    edit = spark.createDataFrame([("a", 1, [1.0], False), ("b", 1, [1.0], True), ("b", 2, [1.0], None)], "s string, shot int, v array<double>, m boolean")
    got = {r["s"]: (r["nep"], r["nep_reason"]) for r in metrics.preservation(source, edit, ["s"], "shot", "v", "m").collect()}
    assert got == {"a": (None, metrics.NO_MASKS), "b": (1.0, None), "c": (None, None)}


def plain_merges(angles, least):
    """Of cosines of angles, from the largest down, those that join two clusters."""
    root = list(range(len(angles)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for c, a, b in sorted((-math.cos(angles[a] - angles[b]), a, b) for a in range(len(angles)) for b in range(a + 1, len(angles))):
        if -c >= least and find(a) != find(b):
            root[find(b)] = find(a)
            out.append(1 + c)
    return out


def test_a_spanning_forest_holds_all_thresholds(spark):
    rng = random.Random(9)
    angles = {g: [rng.random() * 6 for _ in range(n)] for g, n in (("a", 30), ("b", 1), ("c", 12))}
    rows = spark.createDataFrame([(g, i, [math.cos(x), math.sin(x)]) for g, xs in angles.items() for i, x in enumerate(xs)], "g string, i long, v array<double>")
    for tile, least in ((7, -1.0), (1024, 0.9)):
        forest = lineage.cut(identity.spanning_forest(rows, "g", "i", "v", least, tile=tile))
        heights = {}
        for r in identity.merge_heights(forest, "g").orderBy("step").collect():
            heights.setdefault(r["g"], []).append(r["distance"])
        for g, xs in angles.items():
            assert heights.get(g, []) == pytest.approx(plain_merges(xs, least))
    clusters = {(r["g"], r["i"]): r["cluster_id"] for r in identity.clusters_at(forest, rows, "g", "i", 0.95).collect()}
    assert clusters == {(r["g"], r["i"]): r["cluster_id"] for r in identity.single_link(rows, "g", "i", "v", 0.95).collect()}


def test_buckets_find_most_links_of_a_large_group(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((200, 32))
    # Each second vector lies at an angle to the one before it whose cosine is about 0.9.
    close = base / np.linalg.norm(base, axis=1, keepdims=True)
    close = close + 0.484 * (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(rng.standard_normal((200, 32)))
    every = np.concatenate([base, close])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    rows = spark.createDataFrame([("hot:x" if i % 200 else "y", i, v.tolist()) for i, v in enumerate(every)], "g string, i long, v array<double>")
    dots = every @ every.T
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if dots[a, b] >= 0.85 and (a % 200 == 0) == (b % 200 == 0)}
    found = {(r["a"], r["b"]): (r["g"], r["similarity"]) for r in identity.near_links(rows, "g", "i", "v", 0.85).collect()}
    # Few bits make buckets that meet in tiles.
    tiled = {(r["a"], r["b"]) for r in identity.near_links(rows, "g", "i", "v", 0.85, bits=2, few=8).collect()}
    assert tiled <= want and len(tiled) / len(want) >= 0.9
    assert len(want) > 140 and set(found) <= want and len(found) / len(want) >= 0.9
    assert all(g == ("y" if a % 200 == 0 else "hot:x") and s == pytest.approx(dots[a, b]) for (a, b), (g, s) in found.items())
    sizes = [r["count"] for r in identity.in_buckets(rows, "g", "i", "v", identity.bands_for(0.85, 0.95, 12), 12, 2).groupBy("bucket").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 400 * 399 // 4


@pytest.mark.parametrize(("least", "recall", "bits"), [(0.85, 0.9, 8), (0.55, 0.95, 12), (1.0, 0.9, 16)])
def test_bands_reach_their_recall(least, recall, bits):
    p = (1 - math.acos(least) / math.pi) ** bits
    assert 1 - (1 - p) ** identity.bands_for(least, recall, bits) >= recall


def test_prompts_whose_numbers_are_cut_short_take_turns_by_their_keys(spark, tmp_path):
    """Keys of six digits share a sample_id of five; the rows lie in falling order."""
    from shotledger.plans.reports import rewritten_prompts

    keys = [k for k in range(100_000, 100_700) if k % 7 == 5]
    rows = [(k, "red ring", "Brand#1", f"TYPE{k}", 3) for k in reversed(keys)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["target_phrase_v1"]: r["instruction"] for r in rewritten_prompts(spark, str(tmp_path)).collect()}
    openings = ("Re-shoot shot 3", "Shot 3 should", "Re-frame shot 3", "Reshoot shot 3")
    assert len(got) == 100 and all(got[f"TYPE{k}"].startswith(openings[i % 4]) for i, k in enumerate(keys))


def test_means_below_zero_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """As their SQL has them. Vectors of label 0 add up to zero exactly, which has no sign."""
    from shotledger.plans import ORACLE, QUERIES

    rng = random.Random(11)
    rows = [(0, [1.0, -4e-7, 1e-7], 1), (28, [1.0, 3e-7, 1e-7], 1)]
    for i in range(50):
        a, b = ([rng.randrange(-1000, 1000) / 4096 for _ in range(3)] for _ in range(2))
        rows += [(28 * (3 * i + k), v, 0) for k, v in enumerate((a, b, [-x - y for x, y in zip(a, b, strict=True)]))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, column in (("shot_mean_vectors", "vector"), ("character_profiles", "centroid")):
        # Lists as text, since -0.0 equals 0.0.
        got = {r["sample_id"]: str(r[column]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {0: "[0.0, 0.0, 0.0]", 1: "[1.0, -0.0, 0.0]"}
        assert got == {k: str(v) for k, v in duck(tmp_path).execute(f"SELECT sample_id, {column} FROM ({ORACLE[name]})").fetchall()}


def test_null_components_do_not_count_in_means(spark):
    inf = math.inf
    rows = spark.createDataFrame([("a", [1.0, None, inf, None]), ("a", [3.0, -2.0, 1.0, None]), ("a", None), ("b", None)], "g string, v array<double>")
    assert {r["g"]: r["vector"] for r in vectors.mean_vectors(rows, ["g"], "v").collect()} == {"a": [2.0, -2.0, inf, None]}


def test_faces_of_every_event_are_clipped(spark):
    from shotledger.plans.edits import clipped_faces

    sizes = {r["k"]: r["count"] for r in clipped_faces(spark, "/root/testdata/sf0.001").groupBy((F.col("event_id") % 10).alias("k")).count().collect()}
    assert set(sizes) == set(range(10))


def test_boxes_under_a_score_go_where_it_is_asked_for(spark):
    boxes = spark.createDataFrame([(1, -5, 20, 0, 30, 0.3), (2, 0, 20, 0, 30, 0.29), (3, 0, 15, 0, 30, 0.9)], "i int, x0 int, x1 int, y0 int, y1 int, s double")
    assert [sorted(r["i"] for r in masks.clipped(boxes, 640, 360, score=s).collect()) for s in (None, "s")] == [[1, 2], [1]]


def test_prompts_of_a_bucket_share_one_state(spark, tmp_path):
    rows = [("m", f"T{i % 3}", f"s{i}", k, float(i % 7 + k), 1) for i in range(600) for k in (0, 1)]
    arrive(spark, tmp_path, "1.json", rows)
    query = leaderboard.follow(spark, f"{tmp_path}/in", ARRIVING, f"{tmp_path}/out", ["psq"], f"{tmp_path}/check")
    query.awaitTermination()
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), query.recentProgress))
    assert 0 < states <= leaderboard.BUCKETS
    assert {r["task_id"]: r["n_prompts"] for r in leaderboard.current(spark, f"{tmp_path}/out", ["psq"]).collect()} == {f"T{i}": 200 for i in range(3)}
