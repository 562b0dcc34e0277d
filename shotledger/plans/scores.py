"""Queries on vectors, metrics, masks and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.functions.vectors import cosine, cosine_or_zero, dot, doubles, mean_vectors, spread
from shotledger.operators import align, identity, masks, metrics
from shotledger.plans.base import CLIP, COS, FRAMES, MEANS, RESULTS, query, r6, r6_each, read, results
from shotledger.plans.base import frames as frame_vectors

K = ["sample_id"]


@query(f"WITH {FRAMES}, {MEANS} SELECT sample_id, shot_id, list_transform(v, lambda x: round(x, 6)) AS vector FROM means")
def shot_mean_vectors(spark, sf_dir):
    m = mean_vectors(frame_vectors(spark, sf_dir), ["sample_id", "shot_id"], "v")
    return m.select("sample_id", "shot_id", r6_each("vector").alias("vector"))


PAIRS = "pr AS (SELECT x.sample_id, x.shot_id AS a, y.shot_id AS b, x.v AS va, y.v AS vb FROM means x JOIN means y ON x.sample_id = y.sample_id AND x.shot_id < y.shot_id)"
COSAB = COS.format(a="va", b="vb")


@query(f"WITH {FRAMES}, {MEANS}, {PAIRS} SELECT sample_id, a, b, round(list_dot_product(va, vb) / ((sqrt(list_dot_product(va, va)) + 1e-8) * (sqrt(list_dot_product(vb, vb)) + 1e-8)), 6) AS cosine FROM pr")
def shot_pair_cosines(spark, sf_dir):
    p = align.pairs_in_group(mean_vectors(frame_vectors(spark, sf_dir), ["sample_id", "shot_id"], "v"), K, "shot_id", "vector")
    return p.select("sample_id", "a", "b", r6(cosine(F.col("vector_a"), F.col("vector_b"))).alias("cosine"))


@query(f"""WITH {FRAMES}, {MEANS}, {PAIRS}, s AS (SELECT sample_id, {CLIP.format(x=f'avg({COSAB})')} AS consistency, count(*) AS n_pairs FROM pr GROUP BY 1),
e AS (SELECT sample_id, shot_id, avg(coalesce(CASE WHEN vec_id % 3 > 0 THEN (vec_id % 10) / 10 END, 0)) AS e FROM frames GROUP BY ALL), c AS (SELECT sample_id, avg(e) AS coverage FROM e GROUP BY 1)
SELECT sample_id, round(coverage, 6) AS coverage, round(consistency, 6) AS consistency, n_pairs, round(sqrt(coverage * consistency), 6) AS csep_v2 FROM c JOIN s USING (sample_id)""")
def propagation_by_vectors(spark, sf_dir):
    f = frame_vectors(spark, sf_dir).withColumn("e", F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 10) / 10))
    out = metrics.propagation_vectors(f, K, "shot_id", "v", "e")
    return out.select("sample_id", r6("coverage").alias("coverage"), r6("consistency").alias("consistency"), "n_pairs", r6("csep_v2").alias("csep_v2"))


SIDES = """src AS (SELECT label * 100 + vec_id // 2 % 23 AS sample_id, (vec_id // 2) AS shot_id, embedding::DOUBLE[] AS s FROM embeddings WHERE vec_id % 2 = 0),
ed AS (SELECT (vec_id // 2) AS shot_id, embedding::DOUBLE[] AS e, vec_id % 5 > 0 AS m FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 7 > 0)"""


def _sides(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    shot = F.floor(F.col("vec_id") / 2).alias("shot_id")
    src = e.filter("vec_id % 2 = 0").select((F.col("label") * 100 + F.floor(F.col("vec_id") / 2) % 23).alias("sample_id"), shot, doubles(F.col("embedding")).alias("v"))
    edit = e.filter("vec_id % 2 = 1 AND vec_id % 7 > 0").select(shot, doubles(F.col("embedding")).alias("v"), (F.col("vec_id") % 5 > 0).alias("masked"))
    return src, src.select("sample_id", "shot_id").join(edit, "shot_id")


@query(f"""WITH {SIDES}, j AS (SELECT sample_id, e IS NOT NULL AS p, coalesce(m, false) AS m, {CLIP.format(x='list_dot_product(s, e)')} AS sim FROM src LEFT JOIN ed USING (shot_id))
SELECT sample_id, round(avg(sim) FILTER (p AND m), 6) AS nep, count_if(p AND m) AS n_scored, count_if(NOT (p AND m)) AS n_skipped, count_if(p AND NOT m) AS n_mask_missing, CASE WHEN count_if(p AND m) = 0 AND count_if(p AND NOT m) > 0 THEN 'required edit-region masks were missing' END AS nep_reason FROM j GROUP BY 1""")
def non_edit_preservation(spark, sf_dir):
    out = metrics.preservation(*_sides(spark, sf_dir), K, "shot_id", "v", "masked")
    return out.withColumn("nep", r6("nep"))


@query(f"WITH {RESULTS} SELECT task_id, sample_id, round(avg(0.5 * (psq * 313 / 100 + ee_v3 * 5 / 10)), 6) AS psq FROM results GROUP BY ALL")
def perceptual_quality(spark, sf_dir):
    rows = results(spark, sf_dir).select("task_id", "sample_id", (F.col("psq") * 313).alias("musiq"), (F.col("ee_v3") * 5).alias("aes"))
    return metrics.psq(rows, ["task_id", "sample_id"]).withColumn("psq", r6("psq"))


@query(f"""WITH {RESULTS}, s AS (SELECT task_id, sample_id, k % 3 AS shot, avg(coalesce(ee_v3, 0)) AS s FROM results GROUP BY ALL)
SELECT task_id, sample_id, round(avg(s), 6) AS ee_v3, count(*) AS n_shots FROM s GROUP BY ALL""")
def rated_effect(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("shot", F.col("k") % 3)
    return metrics.effect_rated(rows, ["task_id", "sample_id"], "shot", "ee_v3").withColumn("ee_v3", r6("ee_v3"))


@query(f"""WITH {RESULTS}, s AS (SELECT task_id, sample_id, k % 3 AS shot, coalesce(bool_and(n % 9 > 0) AND max(ses) > 0.55, false) AS ok FROM results GROUP BY ALL)
SELECT task_id, sample_id, round(avg(ok::INT), 6) AS ee FROM s GROUP BY ALL""")
def voted_effect(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("shot", F.col("k") % 3).withColumn("vote", F.col("n") % 9 > 0)
    return metrics.effect_voted(rows, ["task_id", "sample_id"], "shot", "ses", "vote", 0.55).withColumn("ee", r6("ee"))


@query(f"WITH {RESULTS} SELECT task_id, sample_id, round(avg(CASE WHEN psq IS NOT NULL AND ee_v3 IS NOT NULL THEN {CLIP.format(x='greatest(0, ee_v3 - psq) / greatest(n % 3 / 4, 1e-6)')} END), 6) AS ee_v2 FROM results GROUP BY ALL")
def scaled_effect(spark, sf_dir):
    delta = F.when(F.col("psq").isNotNull(), F.col("ee_v3") - F.col("psq"))
    value = F.when(delta.isNotNull(), metrics.effect_scaled(delta, F.col("n") % 3 / 4))
    return results(spark, sf_dir).groupBy("task_id", "sample_id").agg(r6(F.avg(value)).alias("ee_v2"))


@query(f"""WITH {RESULTS}, g AS (SELECT task_id, sample_id, count(ee_v3) AS n, avg(ee_v3) AS cov, stddev_pop(ee_v3) AS s FROM results GROUP BY ALL),
h AS (SELECT *, CASE WHEN n >= 2 THEN {CLIP.format(x='1 - s / (cov + 1e-6)')} END AS con FROM g)
SELECT task_id, sample_id, n, round(cov, 6) AS coverage, round(con, 6) AS consistency, round(CASE WHEN n >= 2 THEN CASE WHEN cov + con > 0 THEN 2 * cov * con / (cov + con) ELSE 0 END END, 6) AS csep FROM h""")
def harmonic_propagation(spark, sf_dir):
    out = metrics.propagation_harmonic(results(spark, sf_dir), ["task_id", "sample_id"], "ee_v3")
    return out.withColumns({c: r6(c) for c in ("coverage", "consistency", "csep")})


@query(f"""WITH {RESULTS}, x AS (SELECT task_id, sample_id, k, ee_v3 FROM results), p AS (SELECT a.task_id, a.sample_id, a.k AS i, b.k AS j, CASE WHEN (a.k + b.k) % 3 > 0 THEN a.ee_v3 END AS r FROM x a JOIN x b ON a.task_id = b.task_id AND a.sample_id = b.sample_id AND a.k < b.k),
s AS (SELECT task_id, sample_id, avg(coalesce(r, 0)) AS con, count(*) AS n_pairs, map(list(i || '-' || j ORDER BY i || '-' || j), list(coalesce(r, 0) ORDER BY i || '-' || j)) AS pair_scores FROM p GROUP BY ALL), c AS (SELECT task_id, sample_id, avg(coalesce(ee_v3, 0)) AS cov FROM x GROUP BY ALL)
SELECT task_id, sample_id, n_pairs, round(cov, 6) AS coverage, round(con, 6) AS consistency, round(sqrt(cov * con), 6) AS csep_v3, pair_scores FROM c LEFT JOIN s USING (task_id, sample_id)""")
def rated_propagation(spark, sf_dir):
    x = results(spark, sf_dir).select("task_id", "sample_id", "k", "ee_v3")
    p = align.pairs_in_group(x, ["task_id", "sample_id"], "k", "ee_v3").withColumn("r", F.when((F.col("a") + F.col("b")) % 3 > 0, F.col("ee_v3_a")))
    out = metrics.propagation_rated(p, x, ["task_id", "sample_id"], "r", "ee_v3")
    return out.select("task_id", "sample_id", "n_pairs", r6("coverage").alias("coverage"), r6("consistency").alias("consistency"), r6("csep_v3").alias("csep_v3"), "pair_scores")


@query(f"""WITH {RESULTS}, o AS (SELECT task_id, sample_id, coalesce(avg(greatest(0, psq - ee_v3 - 0.02)) FILTER (n % 4 = 0 AND psq IS NOT NULL AND ee_v3 IS NOT NULL), 0) AS off, CASE WHEN sample_id % 3 > 0 THEN avg(psq) - 0.1 END AS drift FROM results GROUP BY task_id, sample_id)
SELECT task_id, sample_id, round(off, 6) AS off_target, round({CLIP.format(x='1 - greatest(greatest(0, off), CASE WHEN drift IS NOT NULL THEN greatest(0, drift) END)')}, 6) AS ses FROM o""")
def side_effect_safety(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("absent", (F.col("n") % 4 == 0) & F.col("psq").isNotNull() & F.col("ee_v3").isNotNull())
    off = metrics.off_target(rows, ["task_id", "sample_id"], "absent", "ee_v3", "psq")
    drift = rows.groupBy("task_id", "sample_id").agg((F.avg("psq") - 0.1).alias("d"))
    both = off.join(drift, ["task_id", "sample_id"]).withColumn("d", F.when(F.col("sample_id") % 3 > 0, F.col("d")))
    return both.select("task_id", "sample_id", r6("off_target").alias("off_target"), r6(metrics.side_effect_safety(F.col("d"), F.col("off_target"))).alias("ses"))


@query(f"""WITH f AS (SELECT label AS sample_id, (vec_id // 10) % 5 AS shot, CASE WHEN vec_id % 2 = 0 THEN 'source' ELSE 'edit' END AS side, (vec_id * 7919) % 17 AS area, vec_id AS face, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT sample_id, shot, arg_max(v, (area, -face)) FILTER (side = 'source') AS va, arg_max(v, (area, -face)) FILTER (side = 'edit') AS vb FROM f GROUP BY ALL) SELECT sample_id, round(avg(greatest(0, 1 - {COSAB})) FILTER (va IS NOT NULL AND vb IS NOT NULL), 6) AS id_drift FROM b GROUP BY 1""")
def identity_drift(spark, sf_dir):
    v = F.col("vec_id")
    f = read(spark, sf_dir, "embeddings").select(F.col("label").alias("sample_id"), (F.floor(v / 10) % 5).alias("shot"), F.when(v % 2 == 0, "source").otherwise("edit").alias("side"), (v * 7919 % 17).alias("area"), v.alias("face"), doubles(F.col("embedding")).alias("v"))
    return metrics.identity_drift(f, K, "shot", "side", "area", "v", "face").withColumn("id_drift", r6("id_drift"))


@query(f"""WITH {FRAMES}, {MEANS}, {PAIRS}, s AS (SELECT sample_id, avg(list_dot_product(va, vb) / ((sqrt(list_dot_product(va, va)) + 1e-8) * (sqrt(list_dot_product(vb, vb)) + 1e-8))) AS sim FROM pr GROUP BY 1),
a AS (SELECT sample_id, least(1.0, avg(spread) / 0.2) AS acp FROM means WHERE n >= 2 GROUP BY 1) SELECT sample_id, round(sim, 6) AS similarity, round(acp, 6) AS acp, round({CLIP.format(x='sim * coalesce(acp, 0)')}, 6) AS cxs_id FROM s LEFT JOIN a USING (sample_id)""")
def cross_shot_identity(spark, sf_dir):
    out = metrics.cross_shot_identity(frame_vectors(spark, sf_dir), K, "shot_id", "v", 0.2)
    return out.select("sample_id", *(r6(c).alias(c) for c in ("similarity", "acp", "cxs_id")))


@query(f"WITH {FRAMES}, {MEANS} SELECT sample_id, shot_id, round(spread, 6) AS spread, n FROM means")
def shot_spread(spark, sf_dir):
    return spread(frame_vectors(spark, sf_dir), ["sample_id", "shot_id"], "v").withColumn("spread", r6("spread"))


@query(f"""WITH {FRAMES}, {MEANS}, d AS (SELECT label AS sample_id, vec_id // 40 AS video, embedding::DOUBLE[] AS ev, (vec_id * 7) % 5 AS wanted FROM embeddings)
SELECT d.sample_id, video, round({CLIP.format(x='avg(coalesce(list_dot_product(ev, v), 0))')}, 6) AS content_alignment FROM d LEFT JOIN means m ON m.sample_id = d.sample_id AND m.shot_id = d.wanted GROUP BY ALL""")
def content_alignment(spark, sf_dir):
    """Each forty vectors are a video, whose vectors of a label are items in order; each should be like the shot that its number names."""
    f = frame_vectors(spark, sf_dir)
    keys = ["sample_id", "video"]
    lists = f.withColumn("video", F.floor(F.col("vec_id") / 40)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("l"))
    wanted = lists.select(*keys, F.transform("l", lambda x: x["vec_id"] * 7 % 5).alias("order"))
    matched = align.by_position(wanted, lists.select(*keys, F.transform("l", lambda x: x["v"]).alias("items")), keys, "order", "items")
    source = mean_vectors(f, ["sample_id", "shot_id"], "v").withColumnRenamed("shot_id", "wanted")
    out = metrics.content_alignment(matched.join(source, ["sample_id", "wanted"], "left"), keys, "item", "vector")
    return out.withColumn("content_alignment", r6("content_alignment"))


@query(f"WITH {SIDES} SELECT sample_id, shot_id, round(list_dot_product(s, e), 6) AS dot, round({COS.format(a='s', b='e')}, 6) AS cosine FROM src JOIN ed USING (shot_id)")
def aligned_similarity(spark, sf_dir):
    src, edit = _sides(spark, sf_dir)
    j = src.join(edit.withColumnRenamed("v", "e"), ["sample_id", "shot_id"])
    return j.select("sample_id", "shot_id", r6(dot(F.col("v"), F.col("e"))).alias("dot"), r6(cosine_or_zero(F.col("v"), F.col("e"))).alias("cosine"))


LINKS = """lk AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35),
both_ AS (SELECT label, a, b FROM lk UNION SELECT label, b, a FROM lk),
reach AS (WITH RECURSIVE w(label, a, b) AS (SELECT label, vec_id, vec_id FROM embeddings UNION SELECT w.label, w.a, k.b FROM w JOIN both_ k ON k.label = w.label AND k.a = w.b) SELECT label, a, min(b) AS root FROM w GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LINKS} SELECT label, a AS vec_id, dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS cluster_id FROM reach")
def identity_clusters(spark, sf_dir):
    out = identity.single_link(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35)
    return out.withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query("""WITH RECURSIVE t(least) AS (VALUES (0.3), (0.35), (0.45)), lk AS (SELECT a.label, least, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id, t WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= least),
w(label, least, a, b) AS (SELECT label, least, vec_id, vec_id FROM embeddings, t UNION SELECT w.label, w.least, w.a, k.b FROM w JOIN lk k ON k.label = w.label AND k.least = w.least AND k.a = w.b),
r AS (SELECT label, least, a, min(b) AS root FROM w GROUP BY ALL) SELECT label, least::DOUBLE AS least, count(DISTINCT root) AS n_clusters FROM r GROUP BY ALL""")
def identity_cluster_counts(spark, sf_dir):
    """How many clusters there are at several thresholds, from one spanning forest."""
    e = read(spark, sf_dir, "embeddings")
    forest = identity.spanning_forest(e, "label", "vec_id", "embedding", 0.3)
    levels = F.explode(F.array(*(F.lit(x) for x in (0.3, 0.35, 0.45)))).alias("least")
    links = forest.select("label", "similarity", levels).filter("similarity >= least").groupBy("label", "least").agg(F.count("*").alias("joined"))
    sizes = e.groupBy("label").agg(F.count("*").alias("items")).select("label", "items", levels)
    return sizes.join(links, ["label", "least"], "left").select("label", "least", (F.col("items") - F.coalesce("joined", F.lit(0))).alias("n_clusters"))


@query(f"""WITH {FRAMES}, dims AS (SELECT sample_id, vec_id % 7 AS cluster, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM frames), m AS (SELECT sample_id, cluster, d, avg(x) AS x FROM dims GROUP BY ALL), c AS (SELECT sample_id, cluster, list(x ORDER BY d) AS v FROM m GROUP BY ALL),
f AS (SELECT sample_id, vec_id % 7 AS cluster, list_sort(list(DISTINCT shot_id)) AS appears_in_shots, count(*) AS n_crops, list_sort(list(vec_id))[1:5] AS samples FROM frames GROUP BY ALL)
SELECT sample_id, cluster, appears_in_shots, n_crops, samples, len(appears_in_shots) >= 2 AS recurring, list_transform(v, lambda x: round(x / (sqrt(list_dot_product(v, v)) + 1e-8), 6)) AS centroid FROM f JOIN c USING (sample_id, cluster)""")
def character_profiles(spark, sf_dir):
    f = frame_vectors(spark, sf_dir).withColumn("cluster", F.col("vec_id") % 7)
    p = identity.profiles(f, ["sample_id", "cluster"], "shot_id", "vec_id", "v")
    return p.select("sample_id", "cluster", "appears_in_shots", "n_crops", "samples", "recurring", r6_each("centroid").alias("centroid"))


RUNS = """rn AS (SELECT user_id, event_type, (event_id * 7919) % 5000 AS s, value::INT % 60 AS l FROM events), p AS (SELECT user_id, event_type, s, l, s + l AS e FROM rn WHERE l > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p), g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, l ROWS UNBOUNDED PRECEDING) AS run FROM m),
un AS (SELECT user_id, event_type, min(s) AS run_start, max(e) - min(s) AS run_len FROM g GROUP BY user_id, event_type, run)"""


def _union(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") * 7919 % 5000).alias("run_start"), (F.bround("value").cast("long") % 60).alias("run_len"))
    return masks.union(e, ["user_id", "event_type"])


@query(f"WITH {RUNS} SELECT user_id, event_type, run_start, run_len FROM un")
def mask_union(spark, sf_dir):
    return _union(spark, sf_dir)


@query(f"""WITH {RUNS}, x AS (SELECT *, run_start + run_len - 1 AS e, (run_start + run_len - 1) // 64 > run_start // 64 AS w FROM un)
SELECT user_id, event_type, sum(run_len)::BIGINT AS area, min(CASE WHEN w THEN 0 ELSE run_start % 64 END) AS x0, min(run_start // 64) AS y0, max(CASE WHEN w THEN 63 ELSE e % 64 END) AS x1, max(e // 64) AS y1, sum(run_len) >= 100 AS hit FROM x GROUP BY ALL""")
def mask_measures(spark, sf_dir):
    return masks.measures(_union(spark, sf_dir).withColumn("w", F.lit(64).cast("long")), ["user_id", "event_type"], "w")


@query("""SELECT 'tk' || doc_id % 4 AS task_id, CASE WHEN doc_id % 4 IN (1, 3) THEN NULL ELSE n_chars / 100000 END AS nep, CASE WHEN doc_id % 4 = 2 THEN 0.2 ELSE 0.1 END::DOUBLE AS delta_max, doc_id FROM documents""")
def task_rule_routing(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "n_chars").withColumn("task_id", F.concat(F.lit("tk"), (F.col("doc_id") % 4).cast("string")))
    rules = spark.createDataFrame([("tk0", True, 0.1), ("tk1", False, 0.1), ("tk2", True, 0.2), ("tk3", False, 0.1)], "task_id string, nep_applies boolean, delta_max double")
    j = d.join(F.broadcast(rules), "task_id")
    return j.select("task_id", F.when(F.col("nep_applies"), F.col("n_chars") / 100000).alias("nep"), "delta_max", "doc_id")
