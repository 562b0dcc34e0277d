"""A leaderboard that is kept current as result documents arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shotledger.operators.rollup import fold_samples, latest_wins, macro_mean
from shotledger.sources import commits

KEYS = ["baseline", "task_id", "sample_id", "k"]
TASK = ["baseline", "task_id"]
#: Prompts are dealt to so many buckets, each with one state: an Arrow table of the latest row of each sample, its version and a digest that decides ties.
BUCKETS = 512
STATE = "rows binary"
#: Boards that are kept, for readers that have begun to read one.
KEPT = 3


def board(results: DataFrame, metrics: list[str], version: str = "updated_at") -> DataFrame:
    """Of each sample the latest result, folded to prompts and then to tasks."""
    latest = latest_of_each(results, version)
    return macro_mean(fold_samples(latest, ["baseline", "task_id", "sample_id"], metrics), TASK, metrics)


def _tie(results: DataFrame) -> Column:
    return F.xxhash64(*sorted(results.columns))


def latest_of_each(results: DataFrame, version: str) -> DataFrame:
    """Of each sample the row of the last version; of equal versions the one that a digest of its values puts last."""
    return latest_wins(results.withColumn("_tie", _tie(results)), KEYS, [version, "_tie"]).drop("_tie")


def _number(results: DataFrame, version: str) -> Column:
    """A version as a number of the same order: exact for whole numbers and microseconds up to 2^53."""
    kind = results.schema[version].dataType
    return (F.unix_micros(version) if isinstance(kind, T.TimestampType) else F.col(version)).cast("double")


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_all().to_pandas()


def _folded(rows: pd.DataFrame, metrics: list[str], name: str) -> pd.DataFrame:
    """Of each prompt the number of its samples and of each metric the mean of those that have it. Equal rows, in whatever order, have equal means."""
    prompts = rows.sort_values(["k", *metrics]).groupby(KEYS[:3], dropna=False, sort=False)
    return prompts[metrics].mean().assign(size=prompts.size()).add_suffix(name)


def _changes(held: pd.DataFrame | None, arrived: pd.DataFrame, metrics: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows that a bucket holds after some arrived, and what its prompts change of their tasks' sums. Of equal versions and digests the held row stays."""
    both = pd.concat([arrived] if held is None else [arrived, held], ignore_index=True)
    now = both.sort_values(["_version", "_tie"], kind="stable").drop_duplicates(KEYS, keep="last")
    folded = _folded(now, metrics, "_now")
    old = _folded(now.iloc[:0] if held is None else held, metrics, "_old").reindex(folded.index)
    out = pd.DataFrame({"prompts": old["size_old"].isna().astype("int64"), "k_samples": folded["size_now"].astype("int64")})
    for m in metrics:
        new, gone = folded[f"{m}_now"].astype(float), old[f"{m}_old"].astype(float)
        out[f"n_{m}"] = new.notna().astype(float) - gone.notna()
        out[f"sum_{m}"] = new.fillna(0.0) - gone.fillna(0.0)
        out[f"square_{m}"] = new.fillna(0.0) ** 2 - gone.fillna(0.0) ** 2
    tasks = out.groupby(level=TASK, dropna=False, sort=False)
    change = tasks.sum().assign(k_samples=tasks["k_samples"].max()).reset_index()
    return now, change.astype({c: object for c in TASK}).where(change.notna(), None) if change[TASK].isna().any(axis=None) else change


def deltas(arrived: DataFrame, metrics: list[str], version: str, buckets: int = BUCKETS) -> DataFrame:
    """For each task that rows arrive of, in parts, what its sums change by: a prompt's old mean goes, the new one comes.

    A streaming DataFrame with a state for each bucket of prompts, which holds the latest row of each of their samples: what
    arrives late, or again, changes nothing. A batch costs what its buckets hold; a task of Python works on a bucket's rows at once.
    """
    sums = [f"{x}_{m}" for m in metrics for x in ("n", "sum", "square")]
    columns = ["baseline", "task_id", "prompts", "k_samples", *sums]
    schema = "baseline string, task_id string, prompts long, k_samples long, " + ", ".join(f"{c} double" for c in sums)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(parts), ignore_index=True)[[*KEYS, *metrics, "_version", "_tie"]]
        # Numbers that are null, or of no rows but nulls, are NaN in both.
        came = came.astype({"k": float, "_version": float} | {m: float for m in metrics}).fillna({"_version": -np.inf})
        now, change = _changes(_unpacked(state.get[0]) if state.exists else None, came, metrics)
        state.update((_packed(now),))
        yield change[columns]

    keyed = arrived.select(*KEYS[:3], F.col("k").cast("double").alias("k"), *(F.col(m).cast("double").alias(m) for m in metrics), _number(arrived, version).alias("_version"), _tie(arrived).alias("_tie"))
    return keyed.withColumn("_bucket", F.pmod(F.xxhash64(*KEYS[:3]), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(step, schema, STATE, "update", GroupStateTimeout.NoTimeout)


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*TASK).agg(F.max("k_samples").alias("k_samples"), *(F.sum(c).alias(c) for c in sums.columns if c not in (*TASK, "k_samples")))


def follow(spark: SparkSession, source: str, schema: str, out: str, metrics: list[str], checkpoint: str, version: str = "updated_at", files_per_batch: int | None = None) -> StreamingQuery:
    """Reads what is new in source and commits a board of sums, a row for each task, after every batch; current() reads the last.

    A batch is added to the board before it, so that one that comes again is done already. A stream that has lost its
    checkpoint begins anew, with the first batch and an empty board.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number == 0:
            commits.delete(spark, out)
        known = commits.batches(spark, out)
        earlier = [folder for name, folder in known.items() if name < f"{number:012d}"]
        sums = batch.unionByName(spark.read.schema(batch.schema).parquet(earlier[-1])) if earlier else batch
        if not commits.commit(_added(sums), out, f"{number:012d}"):
            batch.write.format("noop").mode("overwrite").save()  # the state must see all of a batch, even if its board is there
        for name, folder in list(known.items())[:-KEPT]:
            commits.delete(spark, f"{out}/commits/{name}")
            commits.delete(spark, folder)

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)
    return deltas(stream, metrics, version).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, metrics: list[str]) -> DataFrame:
    """The last board, as board() would give it of all rows that have arrived."""
    sums = spark.read.parquet(list(commits.batches(spark, out).values())[-1])
    made = []
    for m in metrics:
        n, total, square = (F.col(f"{x}_{m}") for x in ("n", "sum", "square"))
        made.append(F.when(n > 0, total / n).alias(f"{m}_mean"))
        made.append(F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), square - total * total / n) / (n - 1))).alias(f"{m}_std"))
    return sums.select(*TASK, F.col("prompts").alias("n_prompts"), "k_samples", *made)
