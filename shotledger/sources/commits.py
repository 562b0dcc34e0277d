"""Appending to files so that a reader sees whole batches only: files are staged first, then one small file, put in place at once, names their folder."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, lambda p: files.makeQualified(of(p))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file, or a folder with all that is in it, if it is there."""
    files, at = _files(spark, path)
    files.delete(at(path), True)


def batches(spark: SparkSession, root: str) -> dict[str, str]:
    """The committed batches, in order of their names, with the folders of their files."""
    files, at = _files(spark, root)
    if not files.exists(at(f"{root}/commits")) or not files.listStatus(at(f"{root}/commits")):
        return {}
    named = spark.read.text(f"{root}/commits").select(F.col("_metadata.file_name").alias("batch"), "value").collect()
    return {r["batch"]: f"{root}/data/{r['value']}" for r in sorted(named)}


def commit(rows: DataFrame, root: str, batch: str, kind: str = "parquet", by: tuple[str, ...] = (), **options: object) -> bool:
    """Writes rows, in folders by some of their columns, as a batch of that name (letters, digits and hyphens); False, and nothing changes, if there is one already.

    Readers know only what is committed. A run that is lost before the end leaves staged files that no batch names. Of two runs
    that write one batch the first to put its mark in place wins, and a run that comes again finds its batch done.
    """
    spark, folder = rows.sparkSession, f"commit={uuid.uuid4().hex}"
    if batch in batches(spark, root):
        return False
    rows.write.format(kind).options(**options).partitionBy(*by).save(f"{root}/data/{folder}")
    files, at = _files(spark, root)
    files.mkdirs(at(f"{root}/commits"))
    mark = at(f"{root}/data/_{folder}")
    out = files.create(mark, True)
    out.write(folder.encode())
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(mark, at(f"{root}/commits/{batch}"), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        delete(spark, f"{root}/data/_{folder}")
        delete(spark, f"{root}/data/{folder}")
        if not error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False
    return True


def read(spark: SparkSession, root: str, schema: str, kind: str = "parquet", **options: object) -> DataFrame:
    """All committed rows; none where nothing is committed."""
    folders = list(batches(spark, root).values())
    none = spark.createDataFrame([], schema)
    # Batches are folders of one table, so that folders by columns within them are found.
    return spark.read.schema(schema).format(kind).options(**options, basePath=f"{root}/data").load(folders).select(*none.columns) if folders else none
