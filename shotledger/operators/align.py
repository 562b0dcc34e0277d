"""Alignment of source and edited items: by key, in pairs, by position, by rank, by keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.operators import lineage

#: First letters by which words and objects meet.
GRAM = 4


def both_sides(source: DataFrame, edit: DataFrame, keys: list[str]) -> DataFrame:
    """All source items, with the edited one where there is one (present), for counts of what was skipped."""
    return source.join(edit.withColumn("present", F.lit(True)), keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def pairs_in_group(rows: DataFrame, group: list[str], item: str, value: str) -> DataFrame:
    """Pairs of a group's items, a < b: an equi-join on the group with the order as its condition. Groups are a video's shots."""
    a = rows.select(*group, F.col(item).alias("a"), F.col(value).alias(f"{value}_a"))
    b = rows.select(*group, F.col(item).alias("b"), F.col(value).alias(f"{value}_b"))
    return a.join(b, group).filter("a < b")


def by_position(expected: DataFrame, actual: DataFrame, group: list[str], wanted: str, items: str) -> DataFrame:
    """Each position of one list (wanted) with the item at that position of the other; null beyond its end."""
    left = expected.select(*group, F.posexplode(wanted).alias("pos", "wanted"))
    right = actual.select(*group, F.posexplode(items).alias("pos", "item"))
    return left.join(right, [*group, "pos"], "left")


def not_done(rows: DataFrame, done: DataFrame, keys: list[str], ok: str | None = None) -> DataFrame:
    """rows whose key isn't among those done (with success, if a column of it is named)."""
    return rows.join((done.filter(F.col(ok)) if ok else done).select(*keys).distinct(), keys, "left_anti")


def overridden(rows: DataFrame, curated: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the curated columns where there are any; what was there before stays as *_v1, and is_curated says which."""
    new = curated.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("is_curated"))
    out = rows.join(new, keys, "left").withColumn("is_curated", F.coalesce("is_curated", F.lit(False)))
    for c in columns:
        out = out.withColumn(f"{c}_v1", F.when(F.col("is_curated"), F.col(c))).withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out


def missing(rows: DataFrame, curated: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n, and n_missing, the rows that have no curated one."""
    have = curated.select(*keys).distinct().withColumn("_have", F.lit(True))
    return rows.join(have, keys, "left").agg(F.count("*").alias("n"), F.count_if(F.col("_have").isNull()).alias("n_missing"))


def looked_up(rows: DataFrame, items: DataFrame, keys: list[str], columns: dict[str, object]) -> DataFrame:
    """rows with columns of the item of their key; the given default where there is none, or where it has none."""
    found = items.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = rows.join(found, keys, "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_new_{c}"), F.lit(default)).alias(c) for c, default in columns.items()))


def valid_only(rows: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is among the valid ones; repeated valid keys repeat nothing."""
    return rows.join(valid.select(*keys), keys, "left_semi")


def versions(rows: DataFrame, others: dict[str, DataFrame], keys: list[str], column: str) -> DataFrame:
    """Rows whose key every other version has, too, with the versions' values of a column as column_name."""
    for name, other in others.items():
        rows = rows.join(other.select(*keys, F.col(column).alias(f"{column}_{name}")), keys)
    return rows


def absent(shots: DataFrame, group: list[str], shot: str, applies: str) -> DataFrame:
    """For each group the shots that an edit doesn't apply to; where none is marked, it applies to all."""
    lists = shots.groupBy(*group).agg(F.array_sort(F.collect_list(shot)).alias("_all"), F.array_sort(F.collect_list(F.when(F.col(applies), F.col(shot)))).alias("_some"))
    return lists.select(*group, F.when(F.size("_some") > 0, F.array_except("_all", "_some")).otherwise(F.slice("_all", 1, 0)).alias("absent"))


def first_keyword_hit(operations: DataFrame, items: DataFrame, op: str, keywords: str, key: str, objects: str, gram: int = GRAM) -> DataFrame:
    """Operations that apply to an item, with the first object that holds a keyword: keywords in their order, then objects.

    A word lies in an object if its first letters, `gram` at the most, begin somewhere in it and the rest follows: distinct
    objects and words meet by an equi-join on those letters, whatever their number, and only then the items.
    """
    words = operations.select(op, F.posexplode(keywords).alias("_k", "_word")).withColumn("_lower", F.lower("_word")).filter(F.col("_lower").isNotNull())
    named = words.select("_lower").distinct().withColumn("_gram", F.substring("_lower", 1, gram))
    things = items.select(key, F.posexplode(objects).alias("_o", "_object"))
    names = things.select("_object").distinct().withColumn("_text", F.lower("_object")).filter(F.col("_text").isNotNull())
    # Every beginning of up to `gram` letters at every place, and the empty one, which begins an empty word.
    places = F.transform(F.sequence(F.lit(1), F.length("_text")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.substring(F.col("_text"), i, n)))
    begun = F.array_union(F.array(F.lit("")), F.when(F.col("_text") != "", F.array_distinct(F.flatten(places))).otherwise(F.array(F.lit(""))))
    hits = names.select("_object", "_text", F.explode(begun).alias("_gram")).join(named, "_gram").filter(F.contains("_text", F.col("_lower"))).select("_object", "_lower").distinct()
    found = things.join(hits.join(words, "_lower"), "_object")
    return found.groupBy(key, op).agg(F.min_by("_object", F.struct("_k", "_o")).alias("object"))


def by_rank(clusters: DataFrame, named: DataFrame, group: str, cluster: str, size: str, name: str, position: str) -> DataFrame:
    """Names in list order get the clusters in order of size (ties: the lowest id); left-over names get none."""
    ranked = lineage.numbered(clusters.select(group, cluster, (-F.col(size)).alias("_small")), [group], ["_small", cluster], "_r").select(group, "_r", cluster)
    listed = lineage.numbered(named.select(group, name, position), [group], [position], "_r").select(group, "_r", name)
    return listed.join(ranked, [group, "_r"], "left").drop("_r")
