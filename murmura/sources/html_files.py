"""Stored HTML files (recursive listing by extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html_files(spark: SparkSession, root: str, ext: str = ".html") -> DataFrame:
    """One row per file: ``path, length, html`` (bytes decoded as UTF-8).

    The binary file source lists files on the executors' file system and
    reads each file whole; a file is the unit of work."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", f"*{ext}").load(root))
    return df.select("path", "length", F.decode(F.col("content"), "UTF-8").alias("html"))


FOLDER = 1024                  # files of a folder


def land_files(texts: DataFrame, root: str) -> None:
    """Write each row of ``texts`` (one string column) to a file of its own below
    ``root``, a new folder that nobody reads before this returns.

    A file costs the same however short its text, so rows, not bytes, are dealt
    evenly to tasks, and a task writes one folder of about FOLDER files: Spark
    lists many folders in a job, but a single one on the driver.  A task moves its
    own files into place (committer version 2); version 1 leaves all of them to
    the driver, one after another.  On a mounted file system (``file:``) they are
    written without a checksum file beside each: the checksummed one may start two
    processes (chmod) for every file."""
    n = texts.count()
    folders = max(1, min(n, max(texts.sparkSession.sparkContext.defaultParallelism, -(-n // FOLDER))))
    cheap = {"mapreduce.fileoutputcommitter.algorithm.version": "2",
             "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    (texts.repartition(folders).withColumn("folder", F.spark_partition_id())
     .write.options(**cheap).option("maxRecordsPerFile", 1).partitionBy("folder").text(root))
