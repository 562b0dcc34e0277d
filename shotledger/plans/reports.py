"""Queries on nested documents, manifests, ordered reports and prompts in new words."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.functions import prompts, scalars
from shotledger.operators import align, lineage, masks, metrics, promptgen, rollup
from shotledger.plans import base
from shotledger.plans.base import RESULTS, query, r6, read, results
from shotledger.sources import documents

PROMPTS = """pr AS (SELECT p_partkey AS n, lpad(p_partkey::VARCHAR, 5, '0') AS sample_id, 'v' || p_size AS video_id, 'T' || (1 + p_partkey % 7) AS task, p_name || ' it' AS instruction,
CASE 1 + p_partkey % 7 WHEN 2 THEN 'a person with ' || p_name || ' hair color' WHEN 3 THEN p_name || ' look' ELSE p_type END AS phrase, CASE WHEN p_partkey % 3 > 0 THEN 'Older man with a beard and ' || p_name END AS person,
['replace', 'add', 'remove', 'paint'][p_partkey // 7 % 4 + 1] AS op, p_name AS old, p_brand AS new, p_type AS anchor, p_size AS shot FROM part)"""


def _prompts(spark, sf_dir):
    k = F.col("p_partkey")
    phrase = F.when(k % 7 == 1, F.concat(F.lit("a person with "), "p_name", F.lit(" hair color"))).when(k % 7 == 2, F.concat("p_name", F.lit(" look"))).otherwise(F.col("p_type"))
    ops = F.element_at(F.array(*map(F.lit, ("replace", "add", "remove", "paint"))), (F.floor(k / 7) % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        k.alias("n"), F.lpad(k.cast("string"), 5, "0").alias("sample_id"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("video_id"), F.concat(F.lit("T"), (1 + k % 7).cast("string")).alias("task_id"),
        F.concat("p_name", F.lit(" it")).alias("instruction"), phrase.alias("target_phrase"), F.when(k % 3 > 0, F.concat(F.lit("Older man with a beard and "), "p_name")).alias("description"), ops.alias("op"),
        F.col("p_name").alias("old_object"), F.col("p_brand").alias("new_object"), F.col("p_type").alias("anchor"), F.col("p_size").cast("string").alias("target_shot_id"), F.col("p_name").alias("target_framing"),
        F.col("p_brand").alias("camera_move"), F.col("p_type").alias("transition_style"), F.array(F.col("p_size").cast("string"), F.lit("1")).alias("new_order"),
    )


@query(f"""WITH {PROMPTS} SELECT sample_id, video_id, task, phrase AS target_phrase, CASE WHEN n % 5 = 0 THEN op END AS op, person AS description FROM pr""")
def prompt_documents(spark, sf_dir):
    """Prompts as JSON arrays in a folder for each task, written and read back: fields and tasks that documents lack come from the schema and the path."""
    p = _prompts(spark, sf_dir)
    extra = F.when(F.col("n") % 5 == 0, F.struct("op"))
    people = F.when(F.col("description").isNotNull(), F.array(F.struct(F.lit("c").alias("id"), F.col("description").alias("desc"))))
    rows = p.select("n", F.col("task_id").alias("task"), "sample_id", "video_id", people.alias("characters"), F.struct("target_phrase", extra.alias("extra")).alias("edit"))
    path = base.scratch(spark, "prompts")
    documents.write_documents(rows, path, "task", "n")
    docs = documents.read_documents(spark, path, documents.PROMPT + ", task STRING", "part-*")
    docs = documents.task_from_path(docs, "task").withColumn("task", F.regexp_replace("task", "^task=", ""))
    return docs.select("sample_id", "video_id", "task", "edit.target_phrase", F.col("edit.extra.op").alias("op"), prompts.entity_description(F.col("characters"), F.lit("c")).alias("description"))


@query("""SELECT c_custkey, c_mktsegment AS status FROM customer""")
def resumed_log(spark, sf_dir):
    """A CSV log that was broken off after some rows, and goes on where it stopped."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"))
    path, schema = base.scratch(spark, "log"), "c_custkey long, status string"
    documents.append_results(rows.filter("c_custkey % 3 > 0"), path, ["c_custkey"], schema)
    return documents.append_results(rows, path, ["c_custkey"], schema).select("c_custkey", "status")


@query("""SELECT event_type AS task_id, user_id AS sample_id, event_id, round(value, 6) AS value FROM events""")
def result_lines(spark, sf_dir):
    """Results as JSON Lines, partitioned by their task, written and read back."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("task_id"), F.col("user_id").alias("sample_id"), "event_id", "value")
    path = base.scratch(spark, "results")
    documents.write_results(e, path, ("task_id",), "json")
    return spark.read.schema("sample_id long, event_id long, value double, task_id string").json(path).select("task_id", "sample_id", "event_id", r6("value").alias("value"))


@query("""SELECT doc_id, lang, 'all' AS snapshot FROM documents""")
def column_subset(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang")
    return documents.only(d, ["doc_id", "lang", "snapshot"]).withColumn("snapshot", F.coalesce("snapshot", F.lit("all")))


@query("""SELECT coalesce(event_type, 'all') AS task, count(*) AS n_total, count_if(value >= 20 AND event_id % 13 > 0) AS n_ok, count_if(value < 20 AND event_id % 13 > 0) AS n_failed, count_if(event_id % 13 = 0) AS n_skipped
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def manifest_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", (F.col("value") >= 20).alias("ok"), (F.col("event_id") % 13 == 0).alias("no_shots"))
    return rollup.outcomes(e, ["event_type"], "ok", "no_shots").select(F.coalesce("event_type", F.lit("all")).alias("task"), "n_total", "n_ok", "n_failed", "n_skipped")


@query("""SELECT lang, row_number() OVER (ORDER BY coalesce(lang, '')) - 1 AS place FROM (SELECT DISTINCT lang FROM documents)""")
def tasks_in_order(spark, sf_dir):
    kinds = read(spark, sf_dir, "documents", "lang").distinct()
    ordered = rollup.by_task(kinds, "lang")
    return lineage.numbered(ordered.withColumn("g", F.lit(0)).withColumn("o", F.coalesce("lang", F.lit(""))), ["g"], ["o"], "place").select("lang", "place")


@query("""WITH c AS (SELECT source AS category, round(avg((n_chars > 1000)::INT), 3) AS hit_rate FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT category, hit_rate FROM c ORDER BY hit_rate DESC, category LIMIT 3""")
def best_categories(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "source", "n_chars").filter("source IS NOT NULL").groupBy(F.col("source").alias("category")).agg(F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 3).alias("hit_rate"))
    return rollup.by_hit_rate(d).limit(3)


@query("""SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 7""")
def limited_rows(spark, sf_dir):
    return rollup.limited(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 7)


@query("""SELECT task, event_id FROM (SELECT event_type AS task, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5""")
def limited_rows_of_each_task(spark, sf_dir):
    """The last five of each task."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), "event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("late"))
    return rollup.limited(e, ["late", "event_id"], 5, ["task"]).select("task", "event_id")


@query("""SELECT event_type AS task, user_id AS id, props AS note FROM events UNION ALL SELECT lang, doc_id, NULL FROM documents""")
def rows_of_all_tasks(spark, sf_dir):
    """Tables of several tasks as one; what a table lacks is null."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.col("user_id").alias("id"), F.col("props").alias("note"))
    return rollup.together(e, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("task")))


@query("""SELECT event_type AS task, event_id FROM events WHERE event_type IN ('click', 'error')""")
def task_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), "event_id").filter(F.col("task").isin("click", "error"))


@query("""SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labels_with_default(spark, sf_dir):
    return align.looked_up(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels"), ["doc_id"], {"quality": -1, "toxic": 0})


@query("""SELECT count(*) AS n, count_if(l.doc_id IS NULL) AS n_missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def missing_curated(spark, sf_dir):
    return align.missing(read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def valid_samples(spark, sf_dir):
    return align.valid_only(read(spark, sf_dir, "documents", "doc_id", "source"), read(spark, sf_dir, "labels").filter("quality = 1"), ["doc_id"])


@query(f"""WITH {PROMPTS}, m AS (SELECT *, CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 THEN 2 END AS given FROM pr)
SELECT sample_id, CASE WHEN given IS NOT NULL THEN given = 1 ELSE task NOT IN ('T3', 'T5', 'T6', 'T7') END AS nep_applicable,
CASE WHEN given IS NOT NULL THEN 'local' WHEN task IN ('T3', 'T5', 'T6', 'T7') THEN 'global_or_structural' ELSE 'local' END AS edit_scope,
CASE WHEN given IS NOT NULL THEN [old] WHEN task IN ('T3', 'T5', 'T6', 'T7') THEN [] WHEN person IS NOT NULL THEN [person] WHEN task = 'T4' AND op IN ('replace', 'remove') THEN [old] ELSE [] END AS source_queries,
CASE WHEN given IS NOT NULL THEN ['x y', new] WHEN task IN ('T3', 'T5', 'T6', 'T7') OR person IS NOT NULL THEN [] WHEN task = 'T4' AND op IN ('add', 'replace') THEN [new] WHEN task = 'T4' THEN [] ELSE [phrase] END AS edited_queries,
CASE WHEN given = 2 THEN 'minus' WHEN given = 1 THEN 'union' WHEN task IN ('T3', 'T5', 'T6', 'T7') THEN 'none' ELSE 'union' END AS combine,
CASE WHEN given = 2 THEN 'by hand' WHEN given IS NULL AND task IN ('T3', 'T5', 'T6', 'T7') THEN 'task ' || task || ' has no local edit-region mask policy' END AS reason FROM m""")
def mask_query_policies(spark, sf_dir):
    p, second = _prompts(spark, sf_dir), F.col("n") % 4 == 1
    legacy = prompts.mask_policy(*(F.col(c) for c in ("task_id", "description", "op", "old_object", "new_object", "target_phrase")))
    given = F.struct(
        (~second).alias("nep_applicable"), F.lit("local").alias("edit_scope"), F.lit("by_hand").alias("edit_type"), F.col("old_object").alias("source_queries"),
        F.to_json(F.array(F.lit("x y"), F.lit(""), F.col("new_object"))).alias("edited_queries"), F.when(second, "minus").alias("combine"), F.when(second, "by hand").alias("reason"),
    )
    m = prompts.mask_queries(F.when(F.col("n") % 4 < 2, given), F.col("task_id"), legacy)
    return p.select("sample_id", m.alias("m")).select("sample_id", *(F.col(f"m.{c}") for c in ("nep_applicable", "edit_scope", "source_queries", "edited_queries", "combine", "reason")))


REF = "CASE WHEN person IS NULL THEN 'the person' ELSE 'the older man with the beard' END"
A = "CASE WHEN lower({x}[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || {x}"
SHOT = A.format(x="old")


@query(f"""WITH {PROMPTS}, t AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sample_id) - 1 AS i, {REF} AS ref FROM pr)
SELECT sample_id, instruction AS instruction_v1, phrase AS target_phrase_v1, CASE task
WHEN 'T1' THEN ['Replace ' || ref || ' with ' || phrase || ', in every shot they appear.', 'Throughout the video, swap ' || ref || ' for ' || phrase || '.', 'Make ' || ref || ' into ' || phrase || '; keep their actions and positions identical across all shots.', 'Recast ' || ref || ' as ' || phrase || ' for the entire scene.'][i % 4 + 1]
WHEN 'T2' THEN ['Change ' || ref || '''s hair color to ' || old || ', throughout the video.', upper(ref[1:1]) || ref[2:] || ' now has ' || old || ' hair, in every shot.', 'Recolor ' || ref || '''s hair to ' || old || ' across all shots.'][i % 3 + 1]
WHEN 'T3' THEN ['Re-render the entire video in the visual style of ' || old || '.', 'Restyle every shot as ' || old || '.', 'Apply a ' || old || ' look to the whole video, preserving the action and shot order.', 'Make the entire video read as ' || old || '.'][i % 4 + 1]
WHEN 'T4' THEN CASE op WHEN 'replace' THEN ['Replace the ' || old || ' with ' || new || ', wherever it appears.', 'Throughout the video, swap the ' || old || ' for ' || new || '.', 'Where the ' || old || ' would be, show ' || new || ' instead.'][i % 3 + 1]
  WHEN 'add' THEN ['Add ' || new || ' beside the ' || anchor || ', in every shot the ' || anchor || ' is visible.', 'Place ' || new || ' next to the ' || anchor || ', throughout the video.', 'Insert ' || new || ' alongside the ' || anchor || ' in all shots where it appears.'][i % 3 + 1]
  WHEN 'remove' THEN ['Remove the ' || old || ' from every shot.', 'Erase the ' || old || ' entirely from the video.', 'The ' || old || ' should not appear in any shot.'][i % 3 + 1] ELSE '' END
WHEN 'T5' THEN ['Reorder the video to shot order ' || shot || ', 1.', 'Change the shot sequence to ' || shot || ', 1, preserving each shot''s content.', 'Make the edited video play in this shot order: ' || shot || ', 1.'][i % 3 + 1]
WHEN 'T6' THEN ['Re-shoot shot ' || shot || ' as ' || {SHOT} || ' with ' || {A.format(x='new')} || '.', 'Shot ' || shot || ' should be filmed as ' || {SHOT} || '; apply ' || {A.format(x='new')} || '.', 'Re-frame shot ' || shot || ' as ' || {SHOT} || ' and add ' || {A.format(x='new')} || '.', 'Reshoot shot ' || shot || ' with ' || old || ' framing and ' || {A.format(x='new')} || '.'][i % 4 + 1]
ELSE ['Replace every hard cut with ' || {A.format(x='anchor')} || '.', 'Use ' || anchor || ' transitions instead of cuts between every shot.', 'Connect the shots with ' || anchor || ' transitions rather than hard cuts.', 'Smooth the cuts into ' || anchor || ' transitions throughout the video.'][i % 4 + 1] END AS instruction,
CASE task WHEN 'T1' THEN phrase WHEN 'T2' THEN 'a person with ' || old || ' hair' WHEN 'T3' THEN 'a ' || old || ' look' WHEN 'T4' THEN CASE WHEN op = 'remove' THEN 'a scene without the ' || old ELSE new END WHEN 'T5' THEN 'shots reordered to ' || shot || ', 1'
WHEN 'T6' THEN {SHOT} || ' shot' ELSE {A.format(x='anchor')} || ' transition' END AS target_phrase FROM t""")
def rewritten_prompts(spark, sf_dir):
    return promptgen.rewritten(_prompts(spark, sf_dir), ["sample_id", "n"]).select("sample_id", "instruction_v1", "target_phrase_v1", "instruction", "target_phrase")


@query(f"""WITH {PROMPTS} SELECT sample_id, 'Rewrite this:' || chr(10) || '{{"task_id": "' || task || '", "instruction": "' || instruction || '", "target_phrase": ' || CASE WHEN n % 2 = 0 THEN 'null' ELSE '"' || phrase || '"' END || ', "extra": {{' || array_to_string(list_filter(['"op": "' || op || '"',
'"old_object": "' || old || '"', '"new_object": "' || new || '"', CASE WHEN n % 3 = 0 THEN '"anchor": "' || anchor || '"' END, '"camera_move": "a \\"' || new || '\\""', CASE WHEN n % 5 = 0 THEN '"new_order": [' || shot || ', 1]' END], lambda x: x IS NOT NULL), ', ') || '}}, "applicable_shots": '
|| CASE WHEN n % 4 > 0 THEN '[1, ' || shot || ']' ELSE 'null' END || '}}' AS message FROM pr""")
def rewrite_messages(spark, sf_dir):
    p, n = _prompts(spark, sf_dir), F.col("n")
    shot = F.col("target_shot_id").cast("int")
    extra = {"op": F.col("op"), "old_object": F.col("old_object"), "new_object": F.col("new_object"), "anchor": F.when(n % 3 == 0, F.col("anchor")), "transition_style": F.lit(None).cast("string"),
             "camera_move": F.concat(F.lit('a "'), "camera_move", F.lit('"')), "new_order": F.when(n % 5 == 0, F.array(shot, F.lit(1)))}
    message = prompts.payload(F.col("task_id"), F.col("instruction"), F.when(n % 2 > 0, F.col("target_phrase")), extra, F.when(n % 4 > 0, F.array(F.lit(1), shot)))
    return p.select("sample_id", message.alias("message"))


@query(f"""WITH {PROMPTS}, o AS (SELECT sample_id, string_split(old, ' ') AS o, person FROM pr)
SELECT sample_id, unnest(o) AS phrase, 'object' AS kind, unnest(o) AS ref_id FROM o UNION ALL SELECT sample_id, person, 'character', 'c' FROM o WHERE person IS NOT NULL""")
def typed_phrases(spark, sf_dir):
    people = F.when(F.col("description").isNotNull(), F.array(F.struct(F.lit("c").alias("id"), F.col("description").alias("desc"))))
    p = _prompts(spark, sf_dir).select("sample_id", F.explode(prompts.phrases(F.split("old_object", " "), people)).alias("p"))
    return p.select("sample_id", "p.*")


@query("""SELECT o_orderkey, CASE WHEN l <= f THEN [f] WHEN l - f + 1 <= 5 THEN range(f, l + 1) ELSE list_transform(range(5), lambda i: round_even(f + (l - f) * i / 4.0, 0)::BIGINT) END AS frames, floor((f + l) / 2)::BIGINT AS middle,
CASE WHEN n > 0 THEN n // 2 END AS upper_middle, CASE WHEN n > 0 THEN (n - 1) // 2 END AS lower_middle FROM (SELECT o_orderkey, o_custkey AS f, o_custkey + o_orderkey % 23 - 1 AS l, o_orderkey % 23 AS n FROM orders)""")
def keyframe_choices(spark, sf_dir):
    n = F.col("o_orderkey") % 23
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("f"), (F.col("o_custkey") + n - 1).alias("l"), n.alias("n"))
    f, last = F.col("f"), F.col("l")
    return o.select("o_orderkey", scalars.keyframes(f, last, 5).cast("array<bigint>").alias("frames"), scalars.middle(f, last).alias("middle"), scalars.middle_of(F.col("n")).alias("upper_middle"), scalars.middle_of(F.col("n"), True).alias("lower_middle"))


@query("""WITH r AS (SELECT event_id, 'T' || (1 + event_id % 7) AS task_id, value AS v FROM events)
SELECT event_id, task_id, CASE WHEN task_id NOT IN ('T3', 'T5', 'T6', 'T7') THEN v END AS nep, CASE WHEN task_id NOT IN ('T5', 'T7') THEN v + 1 END AS ee_v3, CASE WHEN task_id <> 'T1' THEN v + 2 END AS id_drift,
CASE WHEN task_id IN ('T3', 'T5', 'T6', 'T7') THEN 'NEP not applicable for this task' END AS nep_reason, CASE WHEN task_id IN ('T5', 'T7') THEN 'task ' || task_id || ' not v3-applicable' END AS ee_reason FROM r""")
def routed_metrics(spark, sf_dir):
    v = F.col("value")
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("T"), (1 + F.col("event_id") % 7).cast("string")).alias("task_id"), v.alias("nep"), (v + 1).alias("ee_v3"), (v + 2).alias("id_drift"))
    return metrics.routed(e)


@query("""WITH c AS (SELECT user_id AS f, event_type, (event_id * 37) % 900 AS s, (event_id * 37) % 900 + round_even(value, 0)::INT % 50 + 1 AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY f, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c),
g AS (SELECT f, event_type, coalesce(b, 0) AS x, s AS y FROM m UNION ALL SELECT f, event_type, max(e), 1000 FROM c GROUP BY ALL) SELECT f, event_type, x AS run_start, y - x AS run_len FROM g WHERE y > x""")
def mask_complement(spark, sf_dir):
    c = read(spark, sf_dir, "events").select(F.col("user_id").alias("f"), "event_type", (F.col("event_id") * 37 % 900).alias("run_start"), (F.bround("value").cast("long") % 50 + 1).alias("run_len"))
    frames = c.select("f", "event_type").distinct().withColumn("pixels", F.lit(1000).cast("long"))
    return masks.complement(masks.union(c, ["f", "event_type"]), frames, ["f", "event_type"], "pixels")


@query("""WITH c AS (SELECT p_partkey AS k, [p_partkey % 5, p_size, 3, 0, p_partkey % 4 + 1] AS c FROM part), x AS (SELECT k, unnest([2, 4]) AS i, c FROM c)
SELECT k, list_sum(c[1:i - 1])::BIGINT AS run_start, c[i] AS run_len FROM x WHERE c[i] > 0""")
def decoded_masks(spark, sf_dir):
    k = F.col("p_partkey")
    c = read(spark, sf_dir, "part").select(k.alias("k"), F.array(k % 5, F.col("p_size").cast("long"), F.lit(3).cast("long"), F.lit(0).cast("long"), k % 4 + 1).alias("c"))
    return masks.decoded(c, ["k"], "c")


@query(f"""WITH {RESULTS} SELECT task_id, sample_id, map(list(k::VARCHAR ORDER BY k::VARCHAR), list(n ORDER BY k::VARCHAR)) AS by_sample, list(n ORDER BY k::VARCHAR) AS by_sample_list FROM results GROUP BY ALL""")
def detail_maps(spark, sf_dir):
    rows = results(spark, sf_dir).select("task_id", "sample_id", F.col("k").cast("string").alias("k"), "n")
    return rollup.details(rows, ["task_id", "sample_id"], "k", "n", "by_sample")


FILES = """files AS (SELECT event_id, 'out/' || event_type || '/v' || user_id || CASE event_id % 5 WHEN 4 THEN '' ELSE '_k' || event_id % 5 END || CASE WHEN event_id % 11 = 0 THEN '.json' ELSE '.mp4' END AS path FROM events)"""


@query(rf"""WITH {FILES}, n AS (SELECT path, regexp_extract(path, '([^/]+)\.mp4$', 1) AS name FROM files WHERE path LIKE '%.mp4'), p AS (SELECT path, regexp_replace(name, '_k\d+$', '') AS sample_id, try_cast(nullif(regexp_extract(name, '_k(\d+)$', 1), '') AS INT) AS k FROM n),
c AS (SELECT sample_id, 3 AS wanted, k, max(path) AS path FROM p WHERE k < 3 GROUP BY ALL UNION ALL SELECT sample_id, 1, 0, arg_max(path, (k IS NULL, path)) FROM p WHERE coalesce(k, 0) = 0 GROUP BY sample_id) SELECT wanted, sample_id, k, path FROM c""")
def sample_videos(spark, sf_dir):
    """Files of one sample and of three, told by their names."""
    i = F.col("event_id")
    name = F.concat(F.lit("out/"), "event_type", F.lit("/v"), F.col("user_id").cast("string"), F.when(i % 5 == 4, "").otherwise(F.concat(F.lit("_k"), (i % 5).cast("string"))), F.when(i % 11 == 0, ".json").otherwise(".mp4"))
    paths = read(spark, sf_dir, "events").select(name.alias("path"))
    return documents.sample_files(paths, 3).withColumn("wanted", F.lit(3)).unionByName(documents.sample_files(paths, 1).withColumn("wanted", F.lit(1)))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE lang END AS lang, row_number() OVER (ORDER BY d.doc_id) - 1 AS place FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merged_rows(spark, sf_dir):
    """Rows that were worked on anew go back to their places among all."""
    d = lineage.numbered(read(spark, sf_dir, "documents", "doc_id", "lang").withColumn("g", F.lit(0)), ["g"], ["doc_id"], "place").select("doc_id", "place", "lang")
    new = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return documents.merged_back(d, new, "doc_id", "place")


@query(f"""WITH {RESULTS}, r AS (SELECT task_id, sample_id, k, psq AS content, CASE WHEN n % 3 > 0 THEN (n % 2)::DOUBLE END AS correct FROM results)
SELECT task_id, sample_id, k, round(CASE WHEN correct IS NULL THEN coalesce(content, 0) ELSE 0.5 * (correct + content) END, 6) AS tsf FROM r""")
def structural_scores(spark, sf_dir):
    """The structural score of documents of either generation."""
    correct = F.when(F.col("n") % 3 > 0, (F.col("n") % 2).cast("double"))
    tsf = F.when(correct.isNull(), metrics.structural_fidelity(F.col("psq"))).otherwise(metrics.structural_fidelity(F.col("psq"), correct))
    return results(spark, sf_dir).select("task_id", "sample_id", "k", r6(tsf).alias("tsf"))
