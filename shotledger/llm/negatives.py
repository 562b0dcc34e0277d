"""Hard negatives: exact integer products of anchors and candidates by Strassen's recursion, then heaps of positives and of windows that merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.llm.common import cut

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors and candidates of a tile, about; anchors that are multiplied at a time; sides from which on a product is split.
ANCHORS, CANDIDATES, BAND, LEAF = 2048, 4096, 256, 32
#: Larger products don't fit 64 bits with their multiples by hundredths; they count as this.
MOST = 1 << 56


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of whole numbers by seven products of quarters, which are padded with zeros to be equal. Sums are exact: 64-bit ones wrap around and back."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), a.dtype)
    out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


def matrix(vectors: pd.Series, size: int) -> np.ndarray:
    """Rows of floor(SCALE * x), shorter ones ended with zeros: of 64 bits, or of Python's numbers if any is beyond 2^53."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) < 2.0**45:
        return np.floor(out * SCALE).astype(np.int64)
    whole = [[int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in row] for row in out.tolist()]
    return np.array(whole, object).reshape(out.shape)


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All products of two matrices' rows, held to MOST."""
    top = lambda x: int(np.abs(x).max(initial=0))
    if anchors.dtype == object or candidates.dtype == object or top(anchors) * top(candidates) * anchors.shape[1] >= MOST:
        return np.clip(strassen(anchors.astype(object), candidates.astype(object).T), -MOST, MOST).astype(np.int64)
    return strassen(anchors, np.ascontiguousarray(candidates.T))


def _bands(left: pd.DataFrame, right: pd.DataFrame):
    """Each anchor with a tile's candidates (names, labels, scores) from the best score down, ties by id; bands of anchors are multiplied at a time."""
    if not len(left) or not len(right):
        return
    right = right.sort_values("item", kind="stable")
    size = max(map(len, (*left["v"], *right["v"])))
    names, labels, m = right["item"].to_numpy(), right["label"].to_numpy(), matrix(right["v"], size)
    for lo in range(0, len(left), BAND):
        part = left.iloc[lo : lo + BAND]
        got = scores(matrix(part["v"], size), m)
        for row, line, order in zip(part.itertuples(index=False), got, np.argsort(-got, axis=1, kind="stable"), strict=True):
            yield row, names[order], labels[order], line[order]


def first_positives(left: pd.DataFrame, right: pd.DataFrame, n: int = POSITIVES) -> pd.DataFrame:
    """A tile's heap of each anchor's positives: the first n others of its label."""
    out = []
    for row, names, labels, line in _bands(left, right):
        at = np.flatnonzero((labels == row.label) & (names != row.item))[:n]
        out.extend((row.anchor, row.item, name, score) for name, score in zip(names[at], line[at], strict=True))
    return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive_id", "positive_score"])


def window_negatives(left: pd.DataFrame, right: pd.DataFrame, n: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> pd.DataFrame:
    """A tile's heaps of each anchor's windows: for each of its positives the first n of another label within the window."""
    out = []
    for row, names, labels, line in _bands(left, right):
        other = labels != row.label
        names, line = names[other], 100 * line[other]
        for p in row.positives:
            best, score = p["positive_id"], p["positive_score"]
            first = np.searchsorted(-line, -high * score)
            at = slice(first, min(first + n, np.searchsorted(-line, -low * score, "right")))
            out.extend((row.anchor, row.item, p["place"], best, score, name, s // 100) for name, s in zip(names[at], line[at], strict=True))
    return pd.DataFrame(out, columns=["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])


def usable(rows: DataFrame, item: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """item, label, v of the rows that take part: those with an id, a label and a vector of finite components."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    known = rows.select(F.col(item).alias("item"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return known.filter(F.col("item").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, n_anchors: int = ANCHORS, n_candidates: int = CANDIDATES) -> DataFrame:
    """For each anchor and each of its first `positives` others of its label, the first `negatives` rows of other labels
    within the window: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    rows, anchors: item (an integer), label, v (whole numbers after scaling are compared). A score is the product of two vectors, the
    shorter one ended with zeros; higher ones come first, equal ones by the smaller id. All anchors meet all rows in tiles of
    bounded size, from which only heaps leave, and heaps merge by keeping the first of what they hold, before and after
    the shuffle. Other rows are those of another id: a repeated row counts as often as it stands, a repeated anchor once.
    An anchor without positives, or a window that nothing lies in, gives no rows; an empty table gives none.
    """
    kinds = rows.schema
    keyed = cut(anchors.select("item", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()))
    # Columns of their own: a cogroup confuses those that both of its sides have from one table.
    held = cut(rows.select(*(F.col(c).alias(c) for c in ("item", "label", "v")), F.monotonically_increasing_id().alias("j")))
    n_i, n_j = (max(1, -(-df.count() // size)) for df, size in ((keyed, n_anchors), (held, n_candidates)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = held.withColumn("j", F.pmod(F.xxhash64("j"), F.lit(n_j)).cast("int")).withColumn("i", every(n_i))
    left = keyed.withColumn("i", F.pmod(F.xxhash64("anchor"), F.lit(n_i)).cast("int"))
    name = kinds["item"].dataType.simpleString()
    met = lambda df, f, schema: df.withColumn("j", every(n_j)).groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(f, schema.format(name))
    heaps = met(left, lambda a, c: first_positives(a, c, positives), "anchor long, anchor_id {0}, positive_id {0}, positive_score long")
    best = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    kept = heaps.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives)
    listed = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("place"), "positive_id", "positive_score"))).alias("positives"))
    windows = met(cut(left.join(listed, "anchor")), lambda a, c: window_negatives(a, c, negatives), "anchor long, anchor_id {0}, place int, positive_id {0}, positive_score long, negative_id {0}, negative_score long")
    order = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = windows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, item: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """rows whose label is the next one where the id is divisible by `every`."""
    return rows.withColumn(label, F.when(F.col(item) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)))


def oracle_sql() -> str:
    return f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES}),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.alike AND {LOW} * p.s <= 100 * s.s AND 100 * s.s <= {HIGH} * p.s)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
