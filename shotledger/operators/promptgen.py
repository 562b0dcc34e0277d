"""Prompts from items, banks of values and templates, sampled by digests of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.functions import prompts
from shotledger.operators import lineage

#: Tasks whose prompts can be put in new words, and what an edit says beside its text.
TASKS = ("T1", "T2", "T3", "T4", "T5", "T6", "T7")
EXTRA = ("op", "old_object", "new_object", "anchor", "new_order", "target_shot_id", "target_framing", "camera_move", "transition_style")


def mark(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))


def sampled(rows: DataFrame, group: list[str], keys: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each group with their rank from 1, chosen by a digest: the same whatever the partitions and the other groups. Parts of a group choose first."""
    marked = rows.withColumn("_mark", mark(seed, *(F.col(k) for k in [*group, *keys])))
    order = W.partitionBy(*group).orderBy("_mark", *keys)
    return lineage.first_of_each(marked, group, n, ["_mark", *keys]).withColumn("rank", F.row_number().over(order)).drop("_mark")


def permuted(place: Column, n: int, seed: str, *keys: Column) -> Column:
    """Where a place of 0..n-1 goes in an order of them that hangs on seed and keys: no two places go to one.

    A Feistel network of four rounds over the next power of two; what lands outside goes through it again until it lands inside.
    """
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    sizes = (1 << (bits - low), 1 << low)

    def through(x: Column) -> Column:
        halves = F.struct(F.floor(x / sizes[1]).cast("long").alias("a"), (x % sizes[1]).cast("long").alias("b"))

        def turn(h: Column, r: Column) -> Column:
            drawn = F.conv(F.substring(mark(seed, *keys, r, h["b"]), 1, 8), 16, 10).cast("long")
            # The half that is changed keeps its size, which alternates.
            size = F.when(r % 2 == 0, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")
            return F.struct(h["b"].alias("a"), h["a"].bitwiseXOR(drawn % size).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(3)), halves, turn, lambda h: h["a"] * sizes[1] + h["b"])

    # At least half of the places lie inside: a walk of 100 steps outside has a chance of 2^-100.
    return F.aggregate(F.sequence(F.lit(1), F.lit(100)), place.cast("long"), lambda x, i: F.when((i == 1) | (x >= n), through(x)).otherwise(x))


def from_bank(items: DataFrame, bank: DataFrame, key: str, value: str, n: int, seed: str) -> DataFrame:
    """n different values of the bank for each item, with their rank from 1; all of them if there are no more.

    A keyed permutation says which places of the sorted bank an item takes, so that n rows an item meet the bank, by place.
    """
    placed = lineage.numbered(bank.select(value).distinct().withColumn("_g", F.lit(0)), ["_g"], [value], "_place").select("_place", value)
    size = placed.count()
    if not size:
        return items.limit(0).withColumn(value, F.lit(None).cast(bank.schema[value].dataType)).withColumn("rank", F.lit(None).cast("int"))
    drawn = items.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(min(n, size)))))
    drawn = drawn.withColumn("_place", permuted(F.col("rank") - 1, size, seed, F.col(key)))
    return drawn.join(placed, "_place").select(*items.columns, value, "rank")


def numbered(rows: DataFrame, video: str, task: str, order: list[str]) -> DataFrame:
    """sample_id video_task_0000, counted through each task."""
    out = lineage.numbered(rows, [task], [video, *order], "_n")
    return out.withColumn("sample_id", F.format_string("%s_%s_%04d", F.col(video), F.col(task), F.col("_n"))).drop("_n")


def rewritten(rows: DataFrame, order: list[str], task: str = "task_id", description: str = "description", instruction: str = "instruction", target: str = "target_phrase", extra: tuple[str, ...] = EXTRA) -> DataFrame:
    """rows with instruction and target phrase in new words, and what they were as *_v1. A task's wordings are taken in turn by order; a row of another task stays as it is."""
    turns = lineage.numbered(rows, [task], order, "_turn")
    given = {x: F.col(x) for x in extra if x in rows.columns} | {x: F.lit(None).cast("array<string>" if x == "new_order" else "string") for x in extra if x not in rows.columns}
    # What is used again and again has columns of its own, so that no stage grows beyond what can be compiled.
    named = turns.withColumn("_ref", prompts.short_reference(F.coalesce(description, F.lit("")))).withColumn("_parsed", prompts.attribute_of(F.col(target)))
    text, phrase = prompts.rewritten(F.col(task), F.col("_turn"), F.col("_ref"), F.col("_parsed"), F.col(target), given)
    known = F.coalesce(F.col(task).isin(*TASKS), F.lit(False))
    out = named.withColumn("_text", F.when(known, text).otherwise(F.col(instruction))).withColumn("_phrase", F.when(known, phrase).otherwise(F.col(target)))
    out = out.withColumn(f"{instruction}_v1", F.col(instruction)).withColumn(f"{target}_v1", F.col(target))
    return out.withColumn(instruction, F.col("_text")).withColumn(target, F.col("_phrase")).drop("_text", "_phrase", "_turn", "_ref", "_parsed")


def cycled(rows: DataFrame, group: str, order: str, patterns: list[str]) -> DataFrame:
    """Each row's pattern, in turn."""
    turns = lineage.numbered(rows, [group], [order], "_turn")
    return turns.withColumn("pattern", F.element_at(F.array(*map(F.lit, patterns)), (F.col("_turn") % len(patterns) + 1).cast("int"))).drop("_turn")


def permutations(items: DataFrame, key: str, ids: str, n: int, tries: int, seed: str) -> DataFrame:
    """Up to n different orders of an item's ids, none of them as it is: seeded sorts, the identity and repeats left out."""
    each = items.select(key, ids, F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try"))
    by = lambda x: F.struct(mark(seed, F.col(key), F.col("try"), x).alias("m"), x.alias("x"))
    tried = each.withColumn("new_order", F.transform(F.array_sort(F.transform(ids, by)), lambda e: e["x"])).filter(F.col("new_order") != F.col(ids))
    first = tried.groupBy(key, "new_order").agg(F.min("try").alias("try"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("try"))).filter(F.col("rank") <= n).drop("try")
