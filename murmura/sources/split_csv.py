"""CSV with line ends inside quoted fields, read by many tasks a file.

``multiLine`` gives a file to one task.  Here a file is read in byte ranges, as
lines: whether a range begins inside a quoted field is the parity of the quotes
before it in the file, a running sum over one number a range.  With it each
task cuts its own lines into records; a record that crosses a border is put
together from its pieces afterwards.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.schema import POST_SCHEMA
from murmura.session import work_dir
from murmura.sources.posts import read_posts_csv

MOST_RANGES = 1_000_000        # whose parity (some 24 bytes each) one broadcast may hold
OUT_BYTES = 4 << 20            # text of one Arrow batch that a task gives back
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _cut(batches):
    """Lines of byte ranges, in file order -> records and pieces of records."""
    out, size = ([], [], [], [], []), 0

    def batch():
        nonlocal out, size
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        b = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["file", "start", "kind", "first", "text"])
        out, size = ([], [], [], [], []), 0
        return b

    def put(kind):
        nonlocal size, first, lines
        text = "\n".join(lines)
        for col, v in zip(out, (*at, kind, first, text)):
            col.append(v)
        size += len(text)
        first, lines = False, []

    at, lines, inside, first, kind = None, [], False, False, _WHOLE
    for b in batches:
        for file, start, odd, crlf, value in zip(*(b[c].to_pylist() for c in ("file", "start", "odd", "crlf", "value"))):
            if (file, start) != at:
                if lines:
                    put(kind if kind == _HEAD else _TAIL)      # the range before ends inside a record
                at, inside, first = (file, start), odd, start == 0
                kind = _HEAD if odd else _WHOLE
            lines.append(value[:-1] if crlf and value.endswith("\r") else value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                put(kind)
                kind = _WHOLE
                if size >= OUT_BYTES:
                    yield batch()
    if lines:
        put(kind if kind == _HEAD else _TAIL)
    if out[0]:
        yield batch()


def read_csv_split(spark: SparkSession, path: str, schema=POST_SCHEMA) -> DataFrame:
    """The rows of ``read_posts_csv``, each file read by as many tasks as it has
    byte ranges of ``spark.sql.files.maxPartitionBytes``.

    Files must be UTF-8 with a header record, quotes around fields alone and
    doubled inside them (a bare quote amid an unquoted field would shift every
    later record: read such files with ``read_posts_csv``).  Lines end with
    ``\\n``, or with ``\\r\\n`` if the file's first line does (inside quotes that
    is then one ``\\n``, as the other reader has it); empty lines are no records.  Files are read three times:
    for the quotes, for the pieces at borders (a few a range) and for the rows.
    Beyond MOST_RANGES ranges ``read_posts_csv`` takes over.  Should the ranges
    change between two readings (executors come and go while
    ``spark.sql.files.minPartitionNum`` is unset), the job stops with an error
    instead of returning other rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    folder = work_dir(spark, "csv-ranges")
    (lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file", "start")
     .agg(F.sum(quotes).alias("n"), F.min_by(F.endswith("value", F.lit("\r")), "at").alias("cr"))
     .write.parquet(f"{folder}/quotes"))
    told = spark.read.schema("file string, start long, n long, cr boolean").parquet(f"{folder}/quotes")
    if told.limit(MOST_RANGES + 1).count() > MOST_RANGES:
        return read_posts_csv(spark, path, schema)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = told.select(F.xxhash64("file").alias("_f"), F.col("start").alias("_s"),
                      (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"),
                      F.max((F.col("start") == 0) & F.col("cr")).over(Window.partitionBy("file")).alias("crlf"))
    known = F.coalesce("odd", F.raise_error(F.lit("byte ranges changed while a CSV file was read")).cast("boolean"))
    # a broadcast join leaves the lines of a range in order and together
    cut = (lines.join(F.broadcast(odd), (F.xxhash64("file") == F.col("_f")) & (F.col("start") == F.col("_s")), "left")
           .select("file", "start", known.alias("odd"), "crlf", "value")
           .mapInArrow(_cut, "file string, start long, kind int, first boolean, text string"))
    cut.where(F.col("kind") != _WHOLE).write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema(cut.schema).parquet(f"{folder}/pieces")
    # a record begins with a range's tail; the heads after it, up to the next tail, complete it
    w = Window.partitionBy("file").orderBy("start", "kind")
    numbered = pieces.select("file", "start", "kind", F.sum((F.col("kind") == _TAIL).cast("long")).over(w).alias("no"))
    joined = (pieces.join(numbered, ["file", "start", "kind"]).groupBy("file", "no")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))),
                                            lambda s: s["text"]), "\n").alias("text"), F.max("first").alias("first")))
    records = cut.where(F.col("kind") == _WHOLE).select("text", "first").unionByName(joined.select("text", "first"))
    fields = F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.where(~F.col("first") & (F.col("text") != "")).select(fields.alias("r")).select("r.*")
