"""Clusters of vectors, and what they show."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.functions.vectors import dot, doubles, mean_vectors, normalised
from shotledger.operators.lineage import cut, first_of_each, numbered

#: Vectors of a group that are compared with each other as one matrix.
TILE = 1024


def _tiles(rows: DataFrame, group: str, item: str, vector: str, tile: int) -> DataFrame:
    """group, i, j, side, item, vector: a group's vectors in slices of about `tile`, each two of which (i <= j) meet in one task."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_slices"))
    own = rows.select(group, F.col(item).alias("item"), doubles(F.col(vector)).alias("v")).join(sizes, group)
    own = own.withColumn("_s", F.pmod(F.xxhash64("item"), F.col("_slices").cast("long")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_slices") - 1), lambda j: F.struct(F.least("_s", j).alias("i"), F.greatest("_s", j).alias("j"), (F.col("_s") > j).cast("int").alias("side")))
    return own.select(group, "item", "v", F.explode(others).alias("t")).select(F.col(group).alias("g"), "t.*", "item", "v")


def _meet(pdf: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one tile the pairs (a < b) whose dot product is at least that, and it; a block of rows at a time."""
    sides = [pdf[pdf["side"] == s] for s in (0, 1)]
    left, right = sides[0], sides[1] if len(sides[1]) else sides[0]
    if not len(left):
        return np.zeros(0, object), np.zeros(0, object), np.zeros(0)
    m, names, others = np.stack(right["v"].tolist()), left["item"].to_numpy(), right["item"].to_numpy()
    found = []
    for lo in range(0, len(left), 256):
        dots = np.stack(left["v"].iloc[lo : lo + 256].tolist()) @ m.T
        x, y = np.nonzero(dots >= least)
        a, b = names[lo + x], others[y]
        low = np.where(a < b, a, b)
        good = (a < b) if right is left else (a != b)
        found.append((low[good], np.where(a < b, b, a)[good], dots[x, y][good]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def similar_pairs(rows: DataFrame, group: str, item: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """Pairs of a group's unit vectors with at least that cosine. All are compared, a matrix of two slices of a group in each task."""
    kind, name = rows.schema[group].dataType.simpleString(), rows.schema[item].dataType.simpleString()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, similarity = _meet(pdf, least)
        return pd.DataFrame({group: pd.Series([pdf["g"].iloc[0]] * len(a), dtype=object), "a": a, "b": b, "similarity": similarity})

    return _tiles(rows, group, item, vector, tile).groupBy("g", "i", "j").applyInPandas(pairs, f"`{group}` {kind}, a {name}, b {name}, similarity double")


def _forest(a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> list[tuple]:
    """Of links, from the most similar down and by their items, those that join what no link before them has joined."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for s, x, y in sorted(zip((-similarity).tolist(), a.tolist(), b.tolist(), strict=True)):
        i, j = find(x), find(y)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((x, y, -s))
    return out


def similar_links(rows: DataFrame, group: str, item: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """Links (a, b, similarity) that hold a spanning forest of all similar_pairs(), the most similar first: from a tile comes its own forest, which grows with its items, not its pairs."""
    kind, name = rows.schema[group].dataType.simpleString(), rows.schema[item].dataType.simpleString()

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _forest(*_meet(pdf, least))
        columns = (group, [pdf["g"].iloc[0]] * len(found)), ("a", [x for x, _, _ in found]), ("b", [y for _, y, _ in found]), ("similarity", [s for _, _, s in found])
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in columns})

    return _tiles(rows, group, item, vector, tile).groupBy("g", "i", "j").applyInPandas(links, f"`{group}` {kind}, a {name}, b {name}, similarity double")


def bands_for(least: float, recall: float, bits: int) -> int:
    """Bands of so many bits that two unit vectors of that cosine share at least one of with a chance of `recall`, without probes."""
    alike = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return 1 if alike >= recall else math.ceil(math.log(1 - recall) / math.log(1 - alike))


def in_buckets(rows: DataFrame, group: str, item: str, vector: str, bands: int, bits: int, probes: int = 2, seed: int = 42) -> DataFrame:
    """bucket, group, item and vector of each vector's buckets: for each band the sides of `bits` random hyperplanes that it lies on, and the
    buckets that it would lie in but for one of the `probes` planes that it is nearest to."""

    @F.pandas_udf("array<string>")
    def keys(vectors: pd.Series) -> pd.Series:
        out, planes = [], {}
        for v in vectors:
            x = np.asarray(v, float)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng(seed).standard_normal((bands, bits, len(x)))
            margins = planes[len(x)] @ x
            own = (margins > 0) @ (1 << np.arange(bits))
            near = np.argsort(np.abs(margins), axis=1)[:, :probes]
            out.append([f"{b}:{k}" for b in range(bands) for k in (int(own[b]), *(int(own[b]) ^ 1 << int(i) for i in near[b]))])
        return pd.Series(out, dtype=object)

    every = rows.select(group, item, doubles(F.col(vector)).alias(vector)).select(group, item, vector, F.explode(keys(F.col(vector))).alias("_key"))
    return every.select(F.concat("_key", F.lit(":"), F.col(group).cast("string")).alias("bucket"), group, item, vector)


def near_links(rows: DataFrame, group: str, item: str, vector: str, least: float, recall: float = 0.95, bits: int = 12, probes: int = 2, few: int = 64, tile: int = TILE) -> DataFrame:
    """Links (group, a, b, similarity) that join most of what all similar_pairs() join, where a group is too large for all of its vectors to meet: those of a bucket meet.

    A pair at the threshold is found with a chance of `recall` or more, a closer one nearly always. The vectors of a bucket of
    few meet by a join, those of a larger one in tiles that only a forest leaves. With more bits buckets are smaller and bands
    more: some log2 of a group's size over a tile's is enough.
    """
    dealt = cut(in_buckets(rows, group, item, vector, bands_for(least, recall, bits), bits, probes).distinct())
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    held = cut(dealt.join(sizes, "bucket"))
    small = held.filter(F.col("_n") <= few).select("bucket", group, item)
    a, b = (small.select("bucket", group, F.col(item).alias(x)) for x in "ab")
    pairs = a.join(b.drop(group), "bucket").filter("a < b").select(group, "a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(rows.select(group, F.col(item).alias(x), F.col(vector).alias(f"_{x}")), [group, x])
    near = pairs.select(group, "a", "b", dot(F.col("_a"), F.col("_b")).alias("similarity")).filter(F.col("similarity") >= least)
    kind = rows.schema[group].dataType
    large = similar_links(held.filter(F.col("_n") > few), "bucket", item, vector, least, tile)
    of = large.select(F.regexp_extract("bucket", r"(?s)^\d+:\d+:(.*)$", 1).cast(kind).alias(group), "a", "b", "similarity")
    return near.union(of).groupBy(group, "a", "b").agg(F.max("similarity").alias("similarity"))


def _topmost(parents: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """parents (keys, root, to), where to is at last its own: each root with where its way ends, by ways that double in length."""
    now = cut(parents)
    for _ in range(rounds):
        step = now.join(now.select(*keys, F.col("root").alias("to"), F.col("to").alias("_far")), [*keys, "to"], "left")
        after = cut(step.select(*keys, "root", F.coalesce("_far", "to").alias("_new"), (F.coalesce("_far", "to") != F.col("to")).alias("_moved")))
        if after.filter("_moved").isEmpty():
            return now
        now = after.select(*keys, "root", F.col("_new").alias("to"))
    raise RuntimeError(f"the ways did not end in {rounds} rounds")


def spanning_forest(rows: DataFrame, group: str, item: str, vector: str, least: float = -1.0, rounds: int = 50, tile: int = TILE) -> DataFrame:
    """The links (group, a, b, similarity) of single-link clustering at every threshold from `least` up: a spanning forest of the pairs with the largest similarities.

    In each round every part takes its most similar link that leads out (ties by the items, so that no circle arises), and
    parts that are linked become one: their number halves at least. What is gone through are the links of the tiles' own forests.
    """
    edges = cut(similar_links(rows, group, item, vector, least, tile))
    now, chosen = cut(rows.select(group, F.col(item).alias("i"), F.col(item).alias("root")).distinct()), [edges.limit(0)]
    for _ in range(rounds):
        ends = [now.select(group, F.col("i").alias(c), F.col("root").alias(f"_{c}")) for c in "ab"]
        edges = cut(edges.select(group, "a", "b", "similarity").join(ends[0], [group, "a"]).join(ends[1], [group, "b"]).filter("_a <> _b"))
        if edges.isEmpty():
            out = chosen[0]
            for c in chosen[1:]:
                out = out.union(c)
            return out
        way = lambda x, y: edges.select(group, F.col(x).alias("root"), F.struct((-F.col("similarity")).alias("s"), "a", "b", F.col(y).alias("to")).alias("e"))
        best = cut(way("_a", "_b").union(way("_b", "_a")).groupBy(group, "root").agg(F.min("e").alias("e")).select(group, "root", "e.*"))
        chosen.append(cut(best.select(group, "a", "b", (-F.col("s")).alias("similarity")).distinct()))
        # Two parts that take one link would lead to each other: the lesser stays.
        back = best.select(group, F.col("root").alias("to"), F.col("to").alias("_back"))
        parents = best.join(back, [group, "to"], "left").select(group, "root", F.when((F.col("_back") == F.col("root")) & (F.col("root") < F.col("to")), F.col("root")).otherwise(F.col("to")).alias("to"))
        top = _topmost(parents, [group], rounds)
        now = cut(now.join(top, [group, "root"], "left").select(group, "i", F.coalesce("to", "root").alias("root")))
    raise RuntimeError(f"the forest did not settle in {rounds} rounds")


def merge_heights(forest: DataFrame, group: str) -> DataFrame:
    """The dendrogram of each group: step (from 1), the items of the link that joins two clusters, and the distance at which it does."""
    ordered = forest.withColumn("distance", 1 - F.col("similarity"))
    return numbered(ordered, [group], ["distance", "a", "b"], "step").select(group, (F.col("step") + 1).alias("step"), "a", "b", "distance")


def single_link(rows: DataFrame, group: str, item: str, vector: str, least: float, rounds: int = 50, tile: int = TILE) -> DataFrame:
    """rows' items with cluster_id: components of the graph of similar pairs, numbered from 0 by their least item in each group."""
    return clusters_at(similar_links(rows, group, item, vector, least, tile), rows, group, item, least, rounds)


def clusters_at(links: DataFrame, rows: DataFrame, group: str, item: str, least: float, rounds: int = 50) -> DataFrame:
    """rows' items with cluster_id: what links (group, a, b, similarity) of at least that similarity join, numbered from 0 by the least item in each group.

    The least label spreads along links, and to the label's own label, until nothing changes.
    """
    links = links.filter(F.col("similarity") >= least)
    both = cut(links.select(group, "a", "b").union(links.select(group, F.col("b").alias("a"), F.col("a").alias("b"))))
    now = cut(rows.select(group, F.col(item).alias("a"), F.col(item).alias("root")).distinct())
    for _ in range(rounds):
        near = both.join(now.select(group, F.col("a").alias("b"), "root"), [group, "b"]).groupBy(group, "a").agg(F.min("root").alias("_n"))
        step = now.join(near, [group, "a"], "left").select(group, "a", "root", F.least("root", "_n").alias("_to"))
        jump = now.select(group, F.col("a").alias("_to"), F.col("root").alias("_far"))
        after = cut(step.join(jump, [group, "_to"]).select(group, "a", F.least("_to", "_far").alias("root"), (F.least("_to", "_far") != F.col("root")).alias("_moved")))
        moved = after.filter("_moved").limit(1).count()
        now = after.drop("_moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"the clusters did not settle in {rounds} rounds")
    number = F.dense_rank().over(W.partitionBy(group).orderBy("root")) - 1
    return now.select(group, F.col("a").alias(item), number.alias("cluster_id"))


def profiles(members: DataFrame, keys: list[str], shot: str, item: str, vector: str, samples: int = 5) -> DataFrame:
    """A row for each cluster: its shots, size, whether it recurs, its centroid and first members."""
    facts = members.groupBy(*keys).agg(F.array_sort(F.collect_set(shot)).alias("appears_in_shots"), F.count("*").alias("n_crops")).withColumn("recurring", F.size("appears_in_shots") >= 2)
    first = first_of_each(members.select(*keys, item), keys, samples, [item]).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("samples"))
    centre = mean_vectors(members, keys, vector).withColumn("centroid", normalised(F.col("vector"))).drop("vector")
    return facts.join(first, keys).join(centre, keys)
