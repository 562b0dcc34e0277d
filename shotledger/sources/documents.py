"""Readers and writers of nested documents and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.operators.rollup import latest_wins
from shotledger.sources import commits

METRICS = ("psq", "ee", "ee_v2", "ee_v3", "nep", "csep", "csep_v2", "csep_v3", "ses")
#: Both generations of the structural track's documents, and the aggregates of prompts with columns that came and went.
STRUCTURAL = (
    "sample_id STRING, k INT, op STRING, source_shot_count INT, edit_shot_count INT, content_alignment DOUBLE, tsf DOUBLE, expected_order ARRAY<INT>, expected_shot_count INT, count_correct INT"
)
PROMPT_AGGREGATE = "sample_id STRING, task_id STRING, k_count INT, " + ", ".join(f"{m}_mean DOUBLE, {m}_std DOUBLE" for m in (*METRICS, "dps"))
MODELS = "snapshot_id STRING, models MAP<STRING, STRUCT<model: STRING, captured_at: STRING>>, k_samples_no_seed INT, prompt_rewriting_disabled BOOLEAN, archive_uri STRING"

#: A set of prompts, a list of these; both older prompts and those that name their mask queries.
PROMPT = (
    "sample_id STRING, video_id STRING, applicable_shots ARRAY<INT>, characters ARRAY<STRUCT<id: STRING, desc: STRING>>, edit STRUCT<task_id: STRING, instruction: STRING, target_phrase: STRING, target_entity: STRING, "
    "extra: STRUCT<op: STRING, old_object: STRING, new_object: STRING, anchor: STRING, new_order: ARRAY<STRING>, target_shot_id: STRING, target_framing: STRING, camera_move: STRING, transition_style: STRING>, "
    "mask_queries: STRUCT<nep_applicable: BOOLEAN, edit_scope: STRING, edit_type: STRING, source_queries: STRING, edited_queries: STRING, combine: STRING, reason: STRING>>"
)
#: Rows of a JSON array in one document.
PER_DOCUMENT = 500


def read_documents(spark: SparkSession, path: str, schema: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """One JSON document (or list of them) a file, with file_path; what a schema has and a document lacks is null."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def task_from_path(docs: DataFrame, task: str = "task_id") -> DataFrame:
    """docs whose task, where it is missing, is the name of the folder that their file lies in."""
    return docs.withColumn(task, F.coalesce(task, F.nullif(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1), F.lit(""))))


def sample_files(paths: DataFrame, k_samples: int, path: str = "path") -> DataFrame:
    """Files of k samples by their names: sid.mp4 before sid_k0.mp4 for one sample, sid_k0 to sid_k(K-1) for more; missing ones are left out."""
    name = F.regexp_extract(path, r"([^/]+)\.mp4$", 1)
    sid = F.regexp_replace(name, r"_k\d+$", "")
    k = F.nullif(F.regexp_extract(name, r"_k(\d+)$", 1), F.lit("")).cast("int")
    rows = paths.select(path, sid.alias("sample_id"), F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("_plain")).filter("sample_id <> ''")
    rows = rows.filter(F.col("k") == 0) if k_samples == 1 else rows.filter(~F.col("_plain") & (F.col("k") < k_samples))
    best = rows.groupBy("sample_id", "k").agg(F.max_by(path, F.struct(F.col("_plain"), F.col(path))).alias(path))
    return best.select("sample_id", "k", path)


def write_documents(rows: DataFrame, path: str, folder: str, number: str, per_document: int = PER_DOCUMENT) -> None:
    """Rows as JSON arrays of at most about per_document rows each, in a folder for each value of one column. number: an integer that numbers the rows."""
    body = F.struct(*(F.col(c) for c in rows.columns if c not in (folder, number)))
    arrays = rows.groupBy(folder, F.floor(F.col(number) / per_document).alias("_d")).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.to_json(body).alias("j")))).alias("_l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["j"]), ","), F.lit("]"))
    arrays.select(folder, text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy(folder).text(path)


def append_results(rows: DataFrame, path: str, keys: list[str], schema: str, tries: int = 100) -> DataFrame:
    """Appends to a CSV log with headers what it doesn't have yet, by keys, and reads all of it: a run that was broken off goes on where it stopped.

    A batch is seen whole or not at all. Where another run has committed meanwhile, what is missing is found again.
    """
    spark = rows.sparkSession
    for _ in range(tries):
        number = len(commits.batches(spark, path))
        done = commits.read(spark, path, schema, "csv", header=True)
        todo = rows.join(done.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
        if commits.commit(todo, path, f"{number:012d}", "csv", header=True):
            return commits.read(spark, path, schema, "csv", header=True)
    raise RuntimeError(f"other runs were faster {tries} times")


def only(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; one that docs lack is null."""
    return docs.select(*(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def latest_of_log(log: DataFrame, key: str, status: str = "status", ok: str = "SUCCESS") -> DataFrame:
    """Of a generation log's successful rows the one from the file whose name sorts last."""
    return latest_wins(log.filter(F.col(status) == ok), [key], ["file_name"])


def write_results(rows: DataFrame, path: str, by: tuple[str, ...] = ("baseline", "task_id"), kind: str = "parquet", mode: str = "overwrite") -> None:
    """One partitioned dataset in place of a file a row, so that readers prune by baseline and task."""
    rows.write.mode(mode).partitionBy(*by).format(kind).save(path)


def cell(value: Column, kind: str) -> Column:
    return F.coalesce(F.format_string("%.4f", value) if kind in ("double", "float") else value.cast("string"), F.lit(""))


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, markdown: a table of the columns, numbers with four places, null as nothing. For aggregated rows."""
    kinds = dict(rows.dtypes)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c), kinds[c]) for c in columns)), F.lit(" |"))
    lines = rows.select(F.struct(*order).alias("o"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l"))
    head = "| " + " | ".join(columns) + " |\n" + "|" + "---|" * len(columns)
    return lines.select(F.concat_ws("\n", F.lit(head), F.transform("l", lambda x: x["line"])).alias("markdown"))


def merged_back(original: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """original's rows in their order, each replaced by the new row of its key, if there is one."""
    other = [c for c in original.columns if c not in (key, position)]
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in other), F.lit(True).alias("_is_new"))
    out = original.join(fresh, key, "left")
    return out.select(key, position, *(F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in other)).orderBy(position)
