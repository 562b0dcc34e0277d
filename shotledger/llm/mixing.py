"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.llm.common import cut, n_words

#: The weights of the sources in order, repeating; the mix's size; and the most that a source gives.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slots of the schedule, at least, and slots of a source, about, however small it is.
SLOTS, LEAST = 1 << 16, 64
#: The schedule's line is looked up in so many bins.
BINS = 1 << 12
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Documents in a bucket of a source's shuffled order, about.
BUCKET = 256
#: Hex digits of the MD5 that order the documents.
DIGITS = 15


def _mark(key: str) -> Column:
    """The digest that shuffles documents, as a number under 2^60."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, DIGITS), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, place (1 on, null last), source_size, weight, target.

    Only one row a source reaches the windows below, whatever the number of documents. The sources that reach their
    limit are those whose limit by weight lies under the level that the rest can still share, in order of that limit.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    given = F.array(*(F.lit(w) for w in weights))
    per = per.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.get(given, (F.col("place") - 1) % len(weights)))
    per = per.withColumn("_limit", most * F.col("source_size")).withColumn("_level", F.col("_limit") / F.col("weight"))
    before, every = W.orderBy("_level", "place").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("_full", left / weight_left > F.col("_level"))
    full, free = F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0)).over(every), F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(every)
    level = (share * F.sum("source_size").over(every) - full) / F.nullif(free, F.lit(0))
    per = per.withColumn("target", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("weight") * level).cast("double"))
    return per.select("source", "place", "source_size", "weight", "target")


def schedule(per_source: DataFrame, slots: int = SLOTS, least: int = LEAST) -> DataFrame:
    """Slots of the mix in order: slot, place (of the source), rank (of the slot in its source, 0 on).

    Slot i takes the source in whose part of a line the fractional part of i times the golden ratio falls. The parts
    go by the targets, but none is under `least` slots: a source is cut into as many equal blocks as it has slots, so a
    small one has small blocks and is not missed. The ranks are counted over chunks of slots first, so that a source
    with most slots is no single task's.
    """
    spark = per_source.sparkSession
    some = per_source.filter("target > 0")
    one = some.agg(F.sum("target").alias("all"), F.count("*").alias("n")).first()
    if not one["n"]:
        return spark.createDataFrame([], "slot long, place int, rank long")
    n = max(slots, 2 * least * one["n"])
    share = F.greatest(F.lit(least), F.floor(F.col("target") / one["all"] * n)).cast("long")
    parts = some.select("place", share.alias("_w")).withColumn("_hi", F.sum("_w").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("_w"))
    whole = parts.agg(F.sum("_w")).first()[0]
    in_bin = lambda x: F.floor(x * BINS / whole).cast("int")
    parts = parts.withColumn("_bin", F.explode(F.sequence(in_bin(F.col("_lo")), in_bin(F.col("_hi") - 1))))
    point, chunk = F.col("id") * F.lit(GOLDEN), math.isqrt(n)
    line = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("_chunk"), F.floor((point - F.floor(point)) * whole).alias("_at"))
    line = line.withColumn("_bin", in_bin(F.col("_at"))).join(parts, "_bin").filter("_lo <= _at AND _at < _hi").select("slot", "_chunk", "place")
    line = line.withColumn("_in", F.row_number().over(W.partitionBy("place", "_chunk").orderBy("slot")) - 1)
    held = line.groupBy("place", "_chunk").agg(F.count("*").alias("_n"))
    held = held.select("place", "_chunk", (F.sum("_n").over(W.partitionBy("place").orderBy("_chunk")) - F.col("_n")).alias("_before"))
    return line.join(held, ["place", "_chunk"]).select("slot", "place", (F.col("_before") + F.col("_in")).alias("rank"))


def blocks(per_source: DataFrame, slots: DataFrame) -> DataFrame:
    """per_source with wanted (the target in whole words) and block (words in a block, one for each slot of the source)."""
    held = slots.groupBy("place").agg(F.count("*").alias("_slots"))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    return per_source.join(held, "place", "left").withColumn("wanted", wanted).withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("wanted") / F.coalesce("_slots", F.lit(1)))).cast("long")).drop("_slots")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """A row for each document: the key, source, size, source_size, target and taken, the words that the mix takes of it.

    Each source's documents, shuffled by a digest of the key, form one line of words, which goes on from its start
    again up to `most` times. The n-th slot of a source takes the n-th of the equal blocks of this line, the last of which
    ends where the target is reached: what is taken of a source is its target in whole words. A document gets the words
    of its blocks that lie in it. A null text has size 0 and is never taken; a null source is a source of its own;
    repeated rows are documents of their own with equal sizes; a very long text lies in many blocks. An empty table gives no rows;
    other columns are not looked at. Positions are summed in buckets of the shuffled order first: no source is one
    task's, nor one window's. Only a row for each source goes through windows over all of them.
    """
    sized = cut(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    count = sized.count()
    per = cut(targets(sized, weights, share, most))
    line = cut(schedule(per, slots))
    small = cut(blocks(per, line).select(F.col("source").alias("_source"), "place", "source_size", "target", "wanted", "block"))
    rows = sized.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_mark", _mark("_key"))
    parts = 1 << max(0, math.ceil(math.log2(max(1, count) / BUCKET)))
    rows = rows.withColumn("_bucket", (F.col("_mark") / ((1 << 4 * DIGITS) // parts)).cast("long"))
    sums = rows.groupBy("place", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.select("place", "_bucket", (F.sum("_sum").over(W.partitionBy("place").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inside = W.partitionBy("place", "_bucket").orderBy("_mark", "_key", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(inside)).join(sums, ["place", "_bucket"])
    rows = rows.withColumn("start", F.col("_before") + F.col("_upto") - F.col("size"))
    used = line.select("place", F.col("rank").alias("at"), F.lit(True).alias("_used"))
    # Where a document lies in the line, once for each time that the line goes through it before the target is reached.
    low = lambda turn: turn * F.col("source_size") + F.col("start")
    turns = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda t: (t == 0) | (F.col("size") > 0) & (low(t) < F.col("wanted")))
    laid = rows.withColumn("_low", F.explode(F.transform(turns, low))).withColumn("_high", F.least(F.col("_low") + F.col("size"), "wanted"))
    number = lambda x: F.floor(x / F.col("block")).cast("long")
    cover = F.when(F.col("_high") > F.col("_low"), F.sequence(number(F.col("_low")), number(F.col("_high") - 1))).otherwise(F.array(F.lit(-1).cast("long")))
    pieces = laid.withColumn("at", F.explode(cover)).join(used, ["place", "at"], "left")
    words = F.least("_high", (F.col("at") + 1) * F.col("block")) - F.greatest("_low", F.col("at") * F.col("block"))
    same = ["_key", "source", "size", "source_size", "target", "start"]
    # Rows of size 0 may be alike in all of these; their number is kept.
    out = pieces.groupBy(*same).agg(F.sum(F.when(F.col("_used") & (F.col("at") >= 0), words).otherwise(0)).alias("taken"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_same"))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_same"), F.lit(1)))))
    return out.select(F.col("_key").alias(key), "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them: as many whole times as its words come nearest to.

    Rows of one key and size share what the mix takes of them; a document without words, a null text's too, is not in
    the mix; a null source is one of its own; an empty table gives no rows; the names of other columns don't matter.
    """
    times = mix(docs, key, text, source).filter("size > 0").groupBy(key, "source", "size").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_times")).filter("_times > 0")
    named = times.select(F.col(key).alias("_key"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_times")
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(key).alias("_k"), F.col(source).alias("_s"), n_words(F.col(text)).alias("_n"))
    match = F.col("_k").eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    return own.join(named, match).withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def oracle_sql() -> str:
    w = "CASE (place - 1) % 3 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(WEIGHTS)) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:{DIGITS}])::BIGINT AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM d GROUP BY source),
w AS (SELECT *, {w} AS weight FROM s),
l AS (SELECT *, {MOST} * source_size AS lim, {MOST} * source_size / weight AS lev, sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, ({SHARE} * total - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) > lev AS isfull
    FROM l WINDOW b AS (ORDER BY lev, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, (CASE WHEN isfull THEN lim ELSE weight * (({SHARE} * total - sum(CASE WHEN isfull THEN lim ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER (), 0)) END)::DOUBLE AS target FROM f),
tp AS (SELECT *, greatest({SLOTS}, 2 * {LEAST} * count(*) OVER ()) AS n, sum(target) OVER () AS every FROM t WHERE target > 0),
wd AS (SELECT place, n, greatest({LEAST}, floor(target / every * n))::BIGINT AS w FROM tp),
ed AS (SELECT place, n, sum(w) OVER () AS whole, sum(w) OVER (ORDER BY place) AS hi, sum(w) OVER (ORDER BY place) - w AS lo FROM wd),
sl AS (SELECT i, floor((i * {GOLDEN} - floor(i * {GOLDEN})) * (SELECT max(whole) FROM ed)) AS v FROM (SELECT unnest(range((SELECT max(n)::BIGINT FROM ed))) AS i)),
so AS (SELECT i, place FROM sl JOIN ed ON v >= lo AND v < hi),
rk AS (SELECT place, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS blk FROM so),
p AS (SELECT t.*, floor(target + 0.5)::BIGINT AS wanted, greatest(1, ceil(floor(target + 0.5) / coalesce(k, 1)))::BIGINT AS block
    FROM t LEFT JOIN (SELECT place, count(*) AS k FROM rk GROUP BY place) USING (place)),
li AS (SELECT d.rid, d.doc_id, d.size, p.place, p.source_size, p.target, p.wanted, p.block,
    sum(d.size) OVER (PARTITION BY p.place ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
la AS (SELECT rid, place, block, turn * source_size + start AS low, least(turn * source_size + start + size, wanted) AS high FROM li, (SELECT unnest(range({MOST})) AS turn)),
pc AS (SELECT *, unnest(range((low // block)::BIGINT, ((high - 1) // block)::BIGINT + 1)) AS blk FROM la WHERE high > low),
tk AS (SELECT rid, sum(least(high, (blk + 1) * block) - greatest(low, blk * block))::BIGINT AS taken FROM pc JOIN rk USING (place, blk) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM li LEFT JOIN tk USING (rid)"""
