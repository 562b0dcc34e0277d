"""Queries on what prompts mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotledger.functions import prompts
from shotledger.operators import masks
from shotledger.plans.base import query, read

EDITS = """e AS (SELECT p_partkey, 'T' || (1 + p_size % 7) AS task, CASE WHEN p_partkey % 3 = 0 THEN 'young woman in ' || p_name END AS description, CASE p_partkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'replace' WHEN 2 THEN 'remove' WHEN 3 THEN 'paint' END AS op,
p_name AS old, CASE WHEN p_partkey % 7 > 0 THEN p_type ELSE '' END AS new, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS target FROM part)"""


def _edits(spark, sf_dir):
    key = F.col("p_partkey")
    people = F.when(key % 3 == 0, F.array(F.struct(F.lit("x").alias("id"), F.lit("nobody").alias("desc")), F.struct(F.lit("me").alias("id"), F.concat(F.lit("young woman in "), "p_name").alias("desc"))))
    op = F.when(key % 5 == 0, "add").when(key % 5 == 1, "replace").when(key % 5 == 2, "remove").when(key % 5 == 3, "paint")
    return read(spark, sf_dir, "part").select(
        key, F.concat(F.lit("T"), (1 + F.col("p_size") % 7).cast("string")).alias("task"), prompts.entity_description(people, F.lit("me")).alias("description"), op.alias("op"),
        F.col("p_name").alias("old"), F.when(key % 7 > 0, F.col("p_type")).otherwise("").alias("new"), F.when(key % 11 > 0, F.col("p_brand")).alias("target"),
    )


@query(f"""WITH {EDITS} SELECT p_partkey, task NOT IN ('T3', 'T5', 'T6', 'T7') AS nep_applicable,
CASE WHEN task IN ('T3', 'T5', 'T6', 'T7') THEN task WHEN description IS NOT NULL THEN 'legacy_entity' WHEN task = 'T4' THEN 'legacy_object' || coalesce('_' || op, '') ELSE 'legacy_target_phrase' END AS edit_type,
CASE WHEN task IN ('T3', 'T5', 'T6', 'T7') THEN [] WHEN description IS NOT NULL THEN [description] WHEN task = 'T4' AND op IN ('replace', 'remove') THEN [old] ELSE [] END AS source_queries,
list_filter(CASE WHEN task IN ('T3', 'T5', 'T6', 'T7') OR description IS NOT NULL THEN [] WHEN task = 'T4' AND op IN ('add', 'replace') THEN [new] WHEN task = 'T4' THEN [] ELSE [target] END, lambda q: coalesce(q, '') <> '') AS edited_queries FROM e""")
def mask_policies(spark, sf_dir):
    cols = [F.col(c) for c in ("task", "description", "op", "old", "new", "target")]
    return _edits(spark, sf_dir).select("p_partkey", prompts.mask_policy(*cols).alias("m")).select("p_partkey", "m.*")


@query(f"""WITH {EDITS} SELECT p_partkey, CASE WHEN task IN ('T5', 'T7') THEN '' WHEN task = 'T3' THEN 'the original natural realistic scene' WHEN task = 'T6' THEN 'the original camera framing of the scene'
ELSE coalesce(description, CASE WHEN task = 'T4' THEN nullif(new, '') END, 'the original scene') END AS source_text, CASE WHEN task IN ('T5', 'T7') THEN '' ELSE coalesce(target, '') END AS target_text,
map {{'T1': 0.05, 'T2': 0.02, 'T3': 0.05, 'T4': 0.02, 'T6': 0.03}}[task]::DOUBLE AS delta_max FROM e""")
def text_pairs(spark, sf_dir):
    e = _edits(spark, sf_dir)
    pair = prompts.text_pair(F.col("task"), F.col("description"), F.col("new"), F.col("target"))
    return e.select("p_partkey", pair.alias("p"), prompts.delta_max(F.col("task")).alias("delta_max")).select("p_partkey", "p.*", "delta_max")


@query("""WITH d AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Young woman with long hair, wearing a ' || p_name || ' over a shirt, smiling' WHEN 1 THEN 'older man with a beard' WHEN 2 THEN 'Tired mechanic in a ' || p_name || ' and boots' ELSE 'someone' END AS x, p_name, p_size FROM part)
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'the young woman in the ' || lower(p_name) WHEN 1 THEN 'the older man with the beard' WHEN 2 THEN 'the mechanic in the ' || lower(p_name) ELSE 'the person' END AS reference,
CASE WHEN p_size % 3 = 0 THEN 'a person with dark hair' WHEN p_size % 3 = 1 THEN 'a person wearing ' || p_name ELSE 'a person with ' || p_name || ' gloves' END AS target FROM d""")
def short_references(spark, sf_dir):
    k, a = F.col("p_size") % 4, F.col("p_size") % 3
    d = (
        F.when(k == 0, F.concat(F.lit("Young woman with long hair, wearing a "), "p_name", F.lit(" over a shirt, smiling"))).when(k == 1, "older man with a beard")
        .when(k == 2, F.concat(F.lit("Tired mechanic in a "), "p_name", F.lit(" and boots"))).otherwise("someone")
    )
    attribute, new = F.when(a == 0, "hair color").when(a == 1, "hat").otherwise("gloves"), F.when(a == 0, "dark hair").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", prompts.short_reference(d).alias("reference"), prompts.attribute_target(attribute, new).alias("target"))


@query("""SELECT event_type, event_id, greatest(x0, 0) AS x0, least(x1, 640) AS x1, least(y1, 360) AS y1 FROM (SELECT event_type, event_id, (event_id * 31) % 700 - 20 AS x0, (event_id * 31) % 700 - 20 + value::INT % 60 AS x1, (event_id * 17) % 350 AS y0, (event_id * 17) % 350 + 24 AS y1 FROM events)
WHERE least(x1, 640) - greatest(x0, 0) >= 16 AND least(y1, 360) - greatest(y0, 0) >= 16""")
def clipped_faces(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_type", "event_id", (i * 31 % 700 - 20).alias("x0"), (i * 31 % 700 - 20 + F.bround("value").cast("long") % 60).alias("x1"), (i * 17 % 350).alias("y0"), (i * 17 % 350 + 24).alias("y1"))
    return masks.clipped(e, 640, 360).select("event_type", "event_id", "x0", "x1", "y1")
