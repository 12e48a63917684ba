"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.session import work_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back:
    lineage is cut and a lost executor costs no recomputation."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark, least: int = 1) -> int:
    """Shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def own_names(*params: str):
    """Decorator for operators ``fn(df, ...)`` that return the columns of ``df``:
    inside, they are called c0, c1, ..., so no column of the caller can meet an
    internal name.  ``params`` are the parameters that hold column names.  A
    column of the caller with the name of a column that the operator adds is
    replaced by it."""
    def wrap(fn):
        sig = inspect.signature(fn)

        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kw):
            inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
            bound = sig.bind(df, *args, **kw)
            bound.apply_defaults()
            for p in params:
                v = bound.arguments[p]
                bound.arguments[p] = [inner[c] for c in v] if isinstance(v, list) else inner.get(v, v)
            bound.arguments[next(iter(sig.parameters))] = df.toDF(*inner.values())
            out = fn(*bound.args, **bound.kwargs)
            back = {v: k for k, v in inner.items()}
            added = {c.lower() for c in out.columns if c not in back}
            return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns
                                if c not in back or back[c].lower() not in added])
        return run
    return wrap
