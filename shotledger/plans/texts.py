"""Queries on replies, prompts and their texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from shotledger.functions import scalars
from shotledger.operators import align, judge, lineage, promptgen, scoring
from shotledger.plans.base import query, r6, read, scratch

REPLIES = """replies AS (SELECT event_id, user_id, event_type, CASE event_id % 8 WHEN 0 THEN 'Score: ' || (value::INT % 7) || '/5' WHEN 1 THEN (value::INT % 10) || '.5 because' WHEN 2 THEN '10' WHEN 3 THEN ''
  WHEN 4 THEN 'Yes, it is' WHEN 5 THEN ' No' WHEN 6 THEN '是的 4' ELSE ['I say yes, no doubt', 'no, not a yes', 'I know: yes', '是 yes', '不, yes', 'so yes'][event_id // 8 % 6 + 1] END AS reply FROM events)"""


def _replies(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    v, k = F.bround("value").cast("int"), F.col("event_id") % 8
    reply = (
        F.when(k == 0, F.concat(F.lit("Score: "), (v % 7).cast("string"), F.lit("/5"))).when(k == 1, F.concat((v % 10).cast("string"), F.lit(".5 because"))).when(k == 2, "10").when(k == 3, "")
        .when(k == 4, "Yes, it is").when(k == 5, " No").when(k == 6, "是的 4").otherwise(F.element_at(F.array(*map(F.lit, ("I say yes, no doubt", "no, not a yes", "I know: yes", "是 yes", "不, yes", "so yes"))), (F.floor(F.col("event_id") / 8) % 6 + 1).cast("int")))
    )
    return e.select("event_id", "user_id", "event_type", reply.alias("reply"))


@query(rf"""WITH {REPLIES}, r AS (SELECT event_id, try_cast(nullif(regexp_extract(reply, '\b([0-9](?:\.[0-9])?)\b', 1), '') AS DOUBLE) AS v FROM replies)
SELECT event_id, CASE WHEN v IS NOT NULL THEN least(5, greatest(0, v)) / 5 END AS rating FROM r""")
def judge_ratings(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", scalars.rating(F.col("reply")).alias("rating"))


@query(rf"""WITH {REPLIES}, r AS (SELECT event_id, lower(reply) AS t FROM replies) SELECT event_id, CASE WHEN regexp_matches(t, '^\s*(yes|true|是)($|[^\p{{L}}\p{{N}}_])') THEN true
WHEN regexp_matches(t, '^\s*(no|false|否|不)($|[^\p{{L}}\p{{N}}_])') THEN false ELSE contains(t, 'yes') AND NOT contains(split_part(t, 'yes', 1), 'no') END AS yes FROM r""")
def yes_no_votes(spark, sf_dir):
    return _replies(spark, sf_dir).select("event_id", scalars.says_yes(F.col("reply")).alias("yes"))


@query("""SELECT p_partkey, round(('0x' || md5(p_name || '|' || p_brand)[1:8])::BIGINT / 4294967295.0::DOUBLE, 6) AS score FROM part""")
def batch_scores(spark, sf_dir):
    """A scorer that sees batches of rows, in place of a model: it takes what it is given and adds a score."""

    def scorer(batches):
        for pdf in batches:
            texts = pdf["p_name"] + "|" + pdf["p_brand"]
            yield pdf[["p_partkey"]].assign(score=[round(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) / 4294967295, 6) for t in texts])

    return scoring.score(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand"), scorer, "p_partkey long, score double")


@query("""SELECT p_partkey, round(('0x' || md5(p_name || '|' || p_brand)[1:8])::BIGINT / 4294967295.0::DOUBLE, 6) AS score FROM part""")
def stored_scores(spark, sf_dir):
    """Scores in a store that outlives a run: the second run scores only what the first has not."""
    p, store = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand"), scratch(spark, "scores")
    scoring.score_new(p.filter("p_partkey % 3 > 0"), ["p_name", "p_brand"], "hash", store, "first", digits=1)
    return scoring.score_new(p, ["p_name", "p_brand"], "hash", store, "second", digits=1).select("p_partkey", r6("score").alias("score"))


@query(r"""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b.' WHEN 1 THEN ' A' WHEN 2 THEN 'D' ELSE '' END AS w, doc_id % 10 AS s FROM documents)
SELECT doc_id, CASE WHEN upper(trim(w))[1:1] IN ('A', 'B', 'C') THEN upper(trim(w))[1:1] END AS winner, s::DOUBLE AS score FROM v""")
def verdict_json(spark, sf_dir):
    k = F.col("doc_id") % 4
    d = read(spark, sf_dir, "documents", "doc_id").withColumn("w", F.when(k == 0, "b.").when(k == 1, " A").when(k == 2, "D").otherwise(""))
    body = F.to_json(F.struct(F.col("w").alias("winner"), (F.col("doc_id") % 10).cast("double").alias("score")))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)
    parsed = d.withColumn("v", scalars.lenient_json(reply, "winner string, score double"))
    return parsed.select("doc_id", scalars.winner(F.col("v.winner")).alias("winner"), F.col("v.score").alias("score"))


ORDERS = ("Add a ring", "please REORDER it", "use shot order 3 1 2", "let both trade places", "rearrange them", "Shot order 4,  2\n1 now", "trade positions, then go", "a new shot sequence", "swap both", "shot order: none")


@query(rf"""WITH p AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in ORDERS)}][p_partkey % 11 + 1] AS i, CASE WHEN p_size % 10 = 0 THEN [3, 2, 1] WHEN p_size % 10 = 1 THEN [] END AS g FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 11 IN (1, 2, 3, 5, 6, 7, 9) THEN 'reorder' ELSE 'unknown' END AS op, CASE WHEN len(g) > 0 THEN g WHEN p_partkey % 11 = 2 THEN [3, 1, 2] WHEN p_partkey % 11 = 5 THEN [4, 2, 1] END AS expected FROM p""")
def edit_operations(spark, sf_dir):
    i = F.get(F.array(*map(F.lit, ORDERS)), (F.col("p_partkey") % 11).cast("int"))
    given = F.when(F.col("p_size") % 10 == 0, F.array(*map(F.lit, ("3", "2", "1")))).when(F.col("p_size") % 10 == 1, F.array().cast("array<string>"))
    p = read(spark, sf_dir, "part").select("p_partkey", i.alias("i"), given.alias("g"))
    return p.select("p_partkey", scalars.operation(F.col("i"), F.lit(None).cast("string")).alias("op"), scalars.expected_order(F.col("g"), F.col("i")).alias("expected"))


@query("""SELECT p_partkey, round(('0x' || md5(p_name || '|' || p_brand)[1:8])::BIGINT / 4294967295.0::DOUBLE, 6) AS score FROM part""")
def hash_scores(spark, sf_dir):
    p = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return scoring.score_once(p, ["p_name", "p_brand"], "hash").select("p_partkey", r6("score").alias("score"))


@query(r"""SELECT p_partkey, lpad(p_partkey::VARCHAR, 5, '0') AS id, 'Put ' || (CASE WHEN lower(p_name[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END) || p_name || ' in ' || p_type AS instruction,
nullif(array_to_string(list_filter([p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END], lambda q: q <> ''), '; '), '') AS queries,
'Instruction: ' || p_name || chr(10) || 'Target: ' || (CASE WHEN p_size % 3 = 0 THEN 'the requested change' ELSE p_type END) AS prompt, p_name AS stem FROM part""")
def prompt_texts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 5, "0").alias("id"),
        scalars.filled(F.lit("Put {thing} in {place}"), thing=scalars.article(F.col("p_name")), place=F.col("p_type")).alias("instruction"),
        scalars.queries_joined(F.array("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")))).alias("queries"),
        scalars.prompt_text("Instruction: {instruction}\nTarget: {target}", F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_type"))).alias("prompt"),
        scalars.stem(F.concat(F.lit("a/b.c/"), "p_name", F.lit(".mp4"))).alias("stem"),
    )


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\[\]]', '', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM conversations)
SELECT conv_id, turn, ['Shot 1: [wide  angle] ' || t, 'Shot 2: [close up] ' || t] AS shots, 'Shot 1: [wide  angle] ' || t || 'Shot 2: [close up] ' || t AS prompt, 2 AS n_shots FROM c""")
def caption_shots(spark, sf_dir):
    text = F.regexp_replace("text", r"[\[\]]", "")
    caption = F.concat(F.lit("lead [wide  angle]  "), text, F.lit("\n [close up] "), text, F.lit(" "))
    c = read(spark, sf_dir, "conversations").withColumn("caption", caption)
    return c.select("conv_id", "turn", scalars.shots_of_caption(F.col("caption")).alias("shots"), scalars.multishot_prompt(F.col("caption")).alias("p")).select("conv_id", "turn", "shots", "p.*")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS message FROM conversations GROUP BY conv_id""")
def judge_messages(spark, sf_dir):
    return judge.assembled(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", "text")


VERSIONS = """v AS (SELECT doc_id, unnest(['v1', 'v11', 'v12']) AS version FROM documents),
lab AS (SELECT doc_id, version, chr((64 + row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '|' || version), version))::INT) AS label FROM v)"""


def _labels(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id")
    return judge.blind_labels(d.select("doc_id", F.explode(F.array(*map(F.lit, ("v1", "v11", "v12")))).alias("version")), "doc_id", "version")


@query(f"WITH {VERSIONS} SELECT doc_id, version, label FROM lab")
def blind_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", "version", "label")


@query(f"""WITH {VERSIONS}, ver AS (SELECT d.doc_id, lang AS task_id, version FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id AND label = chr((65 + d.n_chars % 4)::INT))
SELECT coalesce(task_id, 'all') AS task_id, count_if(version = 'v1') AS wins_v1, count_if(version = 'v11') AS wins_v11, count_if(version = 'v12') AS wins_v12, count(version) AS n_judged FROM ver GROUP BY GROUPING SETS ((task_id), ())""")
def win_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    verdicts = d.select("doc_id", F.col("lang").alias("task_id"), F.char(F.col("n_chars") % 4 + 65).alias("winner"))
    return judge.wins(judge.decoded(verdicts, _labels(spark, sf_dir), "doc_id", "winner"), "task_id", "winner_version", ["v1", "v11", "v12"])


@query("""WITH s AS (SELECT event_type AS task, 'axis' || user_id % 3 AS axis, 'v' || event_id % 2 AS version, CASE WHEN event_id % 17 <> 0 THEN value END AS s FROM events)
SELECT coalesce(task, 'all') AS task, axis, round(coalesce(avg(s) FILTER (version = 'v0'), 0), 6) AS mean_v0, round(coalesce(avg(s) FILTER (version = 'v1'), 0), 6) AS mean_v1 FROM s GROUP BY GROUPING SETS ((task, axis), (axis))""")
def judge_mean_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = e.select(F.col("event_type").alias("task"), F.concat(F.lit("axis"), (F.col("user_id") % 3).cast("string")).alias("axis"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("version"),
                 F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("score"))
    out = judge.mean_scores(s, "task", "axis", "version", "score", ["v0", "v1"])
    return out.withColumns({c: r6(c) for c in ("mean_v0", "mean_v1")})


BANK = """bank AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM (SELECT DISTINCT p_type AS v FROM part)), size AS (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS bits FROM bank),
walk(k, rank, x, steps) AS (SELECT n_nationkey, rank, rank - 1, 0 FROM nation, (VALUES (1), (2)) r(rank) UNION ALL
  SELECT k, rank, (b3 << low) + xor(a3, ('0x' || md5('s|' || k || '|3|' || b3)[1:8])::BIGINT % (1 << low)), steps + 1 FROM (
  SELECT *, b2 AS a3, xor(a2, ('0x' || md5('s|' || k || '|2|' || b2)[1:8])::BIGINT % (1 << (bits - low))) AS b3 FROM (
  SELECT *, b1 AS a2, xor(a1, ('0x' || md5('s|' || k || '|1|' || b1)[1:8])::BIGINT % (1 << low)) AS b2 FROM (
  SELECT *, b0 AS a1, xor(a0, ('0x' || md5('s|' || k || '|0|' || b0)[1:8])::BIGINT % (1 << (bits - low))) AS b1 FROM (
  SELECT k, rank, steps, bits, bits // 2 AS low, x >> (bits // 2) AS a0, x % (1 << (bits // 2)) AS b0 FROM walk, size WHERE steps = 0 OR x >= n))))),
c AS (SELECT k, v, rank FROM walk, size, bank WHERE steps > 0 AND x < n AND place = x)"""


def _bank(spark, sf_dir):
    items = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return promptgen.from_bank(items, read(spark, sf_dir, "part", F.col("p_type").alias("v")), "k", "v", 2, "s")


@query("""SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('e|' || event_type || '|' || event_id), event_id) AS rank FROM events QUALIFY rank <= 20""")
def sampled_events(spark, sf_dir):
    """Twenty events of each type, whatever the order in which they lie."""
    return promptgen.sampled(read(spark, sf_dir, "events", "event_type", "event_id"), ["event_type"], ["event_id"], 20, "e")


@query(f"WITH RECURSIVE {BANK} SELECT k, v, rank FROM c")
def bank_samples(spark, sf_dir):
    return _bank(spark, sf_dir)


@query(f"WITH RECURSIVE {BANK} SELECT k || '_T2_' || lpad((row_number() OVER (ORDER BY k::VARCHAR, rank) - 1)::VARCHAR, 4, '0') AS sample_id, v FROM c")
def numbered_prompts(spark, sf_dir):
    rows = _bank(spark, sf_dir).withColumn("video", F.col("k").cast("string")).withColumn("task", F.lit("T2"))
    return promptgen.numbered(rows, "video", "task", ["rank"]).select("sample_id", "v")


@query("""SELECT s_suppkey, ['one', 'two', 'three'][(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 3 + 1] AS pattern FROM supplier""")
def cycled_patterns(spark, sf_dir):
    return promptgen.cycled(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", ["one", "two", "three"]).select("s_suppkey", "pattern")


@query("""WITH i AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, ids, unnest(range(1, 21)) AS try FROM i), x AS (SELECT conv_id, ids, try, unnest(ids) AS id FROM t),
o AS (SELECT conv_id, ids, try, list(id ORDER BY md5('p|' || conv_id || '|' || try || '|' || id), id) AS new_order FROM x GROUP BY ALL), f AS (SELECT conv_id, new_order, min(try) AS try FROM o WHERE new_order <> ids GROUP BY ALL)
SELECT conv_id, new_order, row_number() OVER (PARTITION BY conv_id ORDER BY try) AS rank FROM f QUALIFY rank <= 3""")
def shot_permutations(spark, sf_dir):
    items = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    return promptgen.permutations(items, "conv_id", "ids", 3, 20, "p")


@query("""WITH b AS (SELECT p_partkey, string_split(p_name, ' ') AS o FROM part), r(op, kws) AS (VALUES ('paint', ['red', 'blue']), ('resize', ['small', 'ring', 'widget'])),
x AS (SELECT p_partkey, op, unnest(o) AS obj, generate_subscripts(o, 1) AS oi, kws FROM b, r), y AS (SELECT *, unnest(kws) AS kw, generate_subscripts(kws, 1) AS ki FROM x)
SELECT p_partkey, op, arg_min(obj, ki * 100 + oi) AS object FROM y WHERE contains(lower(obj), kw) GROUP BY ALL""")
def keyword_operations(spark, sf_dir):
    rules = spark.createDataFrame([("paint", ["red", "blue"]), ("resize", ["small", "ring", "widget"])], "op string, kws array<string>")
    items = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("objects"))
    return align.first_keyword_hit(rules, items, "op", "kws", "p_partkey", "objects")


@query("""SELECT d.doc_id, d.lang AS text, 'q' || quality AS text_labelled, c.role || ' ' || c.turn AS text_said FROM documents d JOIN labels l USING (doc_id) JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0""")
def three_versions(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("text"))
    labelled = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("text"))
    said = read(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("text"))
    return align.versions(rows, {"labelled": labelled, "said": said}, ["doc_id"], "text")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, sf_dir):
    done = read(spark, sf_dir, "labels").withColumn("ok", F.col("quality") == 1)
    return align.not_done(read(spark, sf_dir, "documents", "doc_id", "source"), done, ["doc_id"], "ok")


@query("""SELECT doc_id, coalesce('q' || quality, lang) AS lang, CASE WHEN l.doc_id IS NOT NULL THEN lang END AS lang_v1, l.doc_id IS NOT NULL AS is_curated FROM documents d LEFT JOIN labels l USING (doc_id)""")
def curated_override(spark, sf_dir):
    new = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return align.overridden(read(spark, sf_dir, "documents", "doc_id", "lang"), new, ["doc_id"], ["lang"]).select("doc_id", "lang", "lang_v1", "is_curated")


@query("""WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS a, list(turn ORDER BY turn) FILTER (role = 'user') AS u FROM conversations GROUP BY conv_id)
SELECT conv_id, list_filter(a, lambda x: NOT list_contains(coalesce(u, a), x)) AS absent FROM s""")
def absent_shots(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("applies", F.col("role") == "user")
    return align.absent(c, ["conv_id"], "turn", "applies")


@query("""WITH c AS (SELECT s_nationkey AS video, s_suppkey AS cluster, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_suppkey) AS r FROM supplier),
n AS (SELECT c_nationkey AS video, c_custkey AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) SELECT video, name, cluster FROM n LEFT JOIN c USING (video, r)""")
def ranked_names(spark, sf_dir):
    c = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video"), F.col("s_suppkey").alias("cluster"), F.floor(F.col("s_acctbal") / 1000).alias("n"))
    n = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("video"), F.col("c_custkey").alias("name"))
    return align.by_rank(c, n.withColumn("pos", F.col("name")), "video", "cluster", "n", "name", "pos").select("video", "name", "cluster")


@query("""SELECT event_type AS task, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5""")
def first_of_each_task(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("task"), "event_id", "value")
    return lineage.first_of_each(e, ["task"], 5, [F.desc("value"), "event_id"])


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, event_type, n % 4 AS bucket FROM r""")
def stride_buckets(spark, sf_dir):
    return lineage.stride_buckets(read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 4)
