"""Continuous ingest: post files of new runs arrive in a landing folder and
are merged into the per-(user, keyword) stores.

Each micro-batch runs the same plan as the batch ingest (valid -> category
-> relevance -> anti join by url -> embed -> append).  Replays are safe:
the batch is first written to ``{root}/posts_scored/batch_id=N`` (overwrite,
so a replayed id rewrites the same data) and the store append is an anti
join against the store, so a replayed batch adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from murmura.functions.constants import EXCLUDE_CATEGORIES
from murmura.operators.scoring import Scorer
from murmura.operators.store import VectorStore


def ingest_batch_fn(spark: SparkSession, root: str, scorer: Scorer,
                    categories: Sequence[str] = tuple(EXCLUDE_CATEGORIES), embedder=None):
    """The ``foreachBatch`` body (also usable on a static DataFrame)."""
    from murmura.plans.ingest import filter_relevant

    store = VectorStore(spark, root, embedder)

    def run(batch: DataFrame, batch_id: int) -> None:
        scored_path = f"{root}/posts_scored/batch_id={batch_id}"
        rel = filter_relevant(batch, scorer, categories)
        rel.write.mode("overwrite").parquet(scored_path)        # score once, replay-safe
        persisted = batch.sparkSession.read.parquet(scored_path)
        store.append_new(persisted.drop("relevance"))

    return run


def stream_ingest(spark: SparkSession, landing: str, root: str, scorer: Scorer, schema,
                  categories: Sequence[str] = tuple(EXCLUDE_CATEGORIES), embedder=None,
                  checkpoint: str | None = None, files_per_trigger: int | None = None,
                  available_now: bool = True):
    """Start (and, with ``available_now``, drain) the ingest stream.

    Returns the ``StreamingQuery``.  The checkpoint lives below ``root``
    unless given; restarting with the same checkpoint resumes after the last
    committed batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    src = reader.parquet(landing)
    w = (src.writeStream.foreachBatch(ingest_batch_fn(spark, root, scorer, categories, embedder))
         .option("checkpointLocation", checkpoint or f"{root}/_checkpoints/ingest"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
