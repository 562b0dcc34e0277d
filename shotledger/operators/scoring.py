"""Scorers: any function over batches of rows, run once for each distinct input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.functions.scalars import hash_unit
from shotledger.sources import commits

REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str, scorer: Callable[..., Column]) -> None:
    REGISTRY[name] = scorer


register("hash", hash_unit)


def score(rows: DataFrame, batches: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A scorer over batches; what it loads, it loads once for each worker. Filter before it: Catalyst can't look into it."""
    return rows.mapInPandas(batches, schema)


def score_once(rows: DataFrame, keys: list[str], scorer: str, out: str = "score") -> DataFrame:
    """rows with a score by the keys, which is computed once for each distinct set of them."""
    distinct = rows.select(*keys).dropDuplicates().withColumn(out, REGISTRY[scorer](*(F.col(k) for k in keys)))
    return rows.join(distinct, keys, "left")


def score_new(rows: DataFrame, keys: list[str], scorer: str, store: str, run: str, out: str = "score", kind: str = "double", digits: int = 2) -> DataFrame:
    """rows with a score by the keys, of which only inputs that no earlier run has scored are scored, and added to the store by this run.

    The store has a row for each input: a digest of its contents, in a folder by the digest's first `digits` (16 or 256 folders), and the score. A run
    looks into the folders that its inputs fall in, and files carry filters of the digests that they hold, so that most are
    never opened; a filter that errs is put right by the join. A run that comes again adds nothing.
    """
    spark = rows.sparkSession
    # Each key by its length, so that no two sets of keys have one text; a null has none.
    text = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    digest = F.sha2(F.concat(F.lit(f"{scorer};"), *(text(F.col(k)) for k in keys)), 256)
    marked = rows.withColumn("_digest", digest)
    inputs = marked.select("_digest", *keys).dropDuplicates(["_digest"]).withColumn("_part", F.substring("_digest", 1, digits))
    schema = f"_digest string, {out} {kind}, _part string"
    held = commits.read(spark, store, schema).select("_part", "_digest")
    new = inputs.join(held, ["_part", "_digest"], "left_anti").select("_digest", REGISTRY[scorer](*(F.col(k) for k in keys)).cast(kind).alias(out), "_part")
    commits.commit(new.repartition("_part"), store, run, by=["_part"], **{"parquet.bloom.filter.enabled#_digest": "true"})
    scores = commits.read(spark, store, schema).select("_digest", out)
    return marked.join(scores, "_digest", "left").select(*rows.columns, out)
