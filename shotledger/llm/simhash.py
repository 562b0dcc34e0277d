"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a check of the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotledger.llm.common import cut, tidy
from shotledger.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Bits fall into so many blocks; two fingerprints within DISTANCE agree on all but DISTANCE of them.
BLOCKS = 6
#: A block's members up to this number are joined in pairs; more are dealt out in tiles of TILE members.
FEW, TILE = 32, 512


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < size else [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]
    hashes = np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fingerprint() of each text, as signed numbers."""
    printed = lambda texts: pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))
    yield from tidy(lambda series: map(printed, series))(batches)


def _keys(bits: Column, distance: int, blocks: int) -> Column:
    """For each choice of blocks - distance blocks its number and the fingerprint's bits in them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) & ~((1 << cuts[i]) - 1) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return F.array(*(F.struct(F.lit(n).alias("n"), bits.bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for n, m in enumerate(chosen)))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= distance)


def _tile_links(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Links of one tile's pair of slices that join all that its links join: one from each node to the least of its part."""
    left, right = (pdf.loc[pdf["side"] == s, "fp"].to_numpy(np.int64).view(np.uint64) for s in (0, 1))
    same = not len(right)
    right = left if same else right
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = np.arange(len(nodes))
    la, ra = at[: len(left)], at[len(left) :]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, len(left), 256):
        x, y = _near(left[k : k + 256], right, distance)
        pairs = np.unique(np.stack([root[la[k + x]], root[ra[y]]]), axis=1)
        for i, j in pairs.T[pairs[0] != pairs[1]]:
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        for i in np.flatnonzero(root != root[root]):
            root[i] = find(i)
    root = np.array([find(i) for i in range(len(nodes))], int)
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[moved].view(np.int64), "b": nodes[root[moved]].view(np.int64)})


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, few: int = FEW, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that make the same components as all pairs within distance.

    Fingerprints within the distance agree on blocks - distance whole blocks, so each pair meets under one of the
    choices. A key with few fingerprints is joined with itself and its pairs verified. A key with many is split into
    slices whose pairs meet in tiles, each compared as one matrix, and only a tree of links leaves a tile. Nothing is
    capped, and what leaves a key grows with its members, not with their pairs.
    """
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), distance, blocks)).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("n", "v").agg(F.count("*").alias("members")).filter("members > 1")
    shared = cut(keyed.join(sizes, ["n", "v"]))
    small = shared.filter(F.col("members") <= few).drop("members")
    other = small.select("n", "v", F.col("fp").alias("b"))
    pairs = small.withColumnRenamed("fp", "a").join(other, ["n", "v"]).filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    slices = F.ceil(F.col("members") / tile).cast("int")
    big = shared.filter(F.col("members") > few).withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices").cast("long")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct(F.least("slice", j).alias("i"), F.greatest("slice", j).alias("j"), (F.col("slice") > j).cast("int").alias("side")))
    dealt = big.select("n", "v", "fp", F.explode(tiles).alias("t")).select("n", "v", "fp", "t.*")
    tree = dealt.groupBy("n", "v", "i", "j").applyInPandas(lambda pdf: _tile_links(pdf, distance), "a long, b long")
    return pairs.union(tree).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """A row for each document: the key, fingerprint (16 hex digits) and component_id, the least key that it reaches.

    Documents of one fingerprint are one node of the graph, whatever their number; documents without words all have
    fingerprint zero and link like any other. Repeated rows stay rows, a null key belongs to its fingerprint's
    component without naming it, an empty table gives no rows; very long texts are read whole; other columns are not
    looked at. Texts are read once and never move.
    """
    printed = cut(docs.select(F.col(key).alias(key), fingerprints(F.col(text)).alias("fp")))
    nodes = cut(printed.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = components(links(nodes.select("fp"), distance, blocks)).select(F.col("node").alias("fp"), "root")
    named = cut(nodes.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    out = printed.join(of, "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The rows of docs that stand for their near copies: of each component of near_duplicates() the document of the least key; the columns of docs.

    Of rows of one key and one text one stays; of rows of the least key and different texts within one component, too, one
    stays, and within different components one of each; rows without a key cannot be named and stay; documents without words
    are copies of each other. Long texts are read whole. An empty table gives no rows, and no column's name matters but the
    key's and the text's. Texts are read once for their fingerprints, and move once with the rows that stay.
    """
    named = docs.filter(F.col(key).isNotNull())
    digest = F.xxhash64(text)
    prints = cut(named.select(F.col(key).alias("_key"), digest.alias("_text"), fingerprints(F.col(text)).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct("_key", "_text")).alias("_least")))
    rooted = components(links(nodes.select("fp"), distance, blocks)).select(F.col("node").alias("fp"), "root")
    kept = nodes.join(rooted, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("_least").alias("_least")).select("_least.*")
    # The columns travel as one, whose names meet no others.
    whole = named.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(key).alias("_key"), digest.alias("_text"))
    first = F.row_number().over(W.partitionBy("_key", "_text").orderBy("_text"))
    stay = whole.join(kept, ["_key", "_text"], "left_semi").withColumn("_first", first).filter("_first = 1").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
    return stay.union(docs.filter(F.col(key).isNull()))


COLUMNS = ["doc_id", "fingerprint", "component_id"]
