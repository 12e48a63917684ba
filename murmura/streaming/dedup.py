"""Streaming url de-duplication of crawl requests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_dedup(requests: DataFrame, key: str = "url", event_time: str | None = None,
                 delay: str = "1 day") -> DataFrame:
    """Each key once.  With ``event_time``, state is bounded by a watermark
    (``dropDuplicatesWithinWatermark``); without, state keeps every key seen
    (exactly the duplicate filter of a crawl frontier)."""
    if event_time:
        return requests.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return requests.dropDuplicates([key])


BUCKETS = 1 << 12              # groups of keys that share a state row


def _earliest_per_second(rows: list[tuple]) -> list[tuple]:
    """Each key's earliest (micros, tie, key, row) in each second, in time order."""
    seen, out = set(), []
    for r in sorted(rows):
        place = (r[2], r[0] // 1_000_000)
        if place not in seen:
            seen.add(place)
            out.append(r)
    return out


def stream_dedup_ttl(requests: DataFrame, ttl_seconds: int, key: str = "url", event_time: str = "ts",
                     delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """A key again only ``ttl_seconds`` after its last row that passed.

    The frontier of a crawl that visits a page anew after a while.  State is one
    number a key, the second of its last row that passed, and goes when the
    watermark (``delay`` behind the newest row) has reached the end of its time, so
    state holds about the keys of ``ttl_seconds + delay``, not every key ever seen.
    Keys stand in ``buckets`` groups by hash, since a call of Python for every key
    costs far more than its rows: a group has one state row with its keys, is
    pruned whenever it has rows and goes when its last key's time ends.  A key held
    longer than its time changes nothing, for rows behind the watermark are
    dropped.  State lives in the session's state store and survives a restart with
    the same checkpoint and number of buckets.

    Times are compared by whole seconds.  Of a key's rows in one second only the
    earliest can pass (ties: by a hash of the row), so a task holds of a group one
    row a key and second of a batch.  Within a batch rows count in time order.  A row
    behind the watermark is dropped, as is one without a time; one that is late
    within ``delay`` passes only if it is ``ttl_seconds`` past the key's last.  A
    null key is a key.  Returns the columns of ``requests``.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    # rows pass Python as JSON: pandas would turn a nullable bigint into a double
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows = (requests.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
            .select(F.col(event_time).alias("at"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
                    F.to_json(F.struct(F.col(key).alias("key")), exact).alias("key"), F.to_json(F.struct("*"), exact).alias("row"))
            .withColumns({"micros": F.unix_micros("at"), "tie": F.xxhash64("row")}))
    out = T.StructType([T.StructField("row", T.StringType())])

    def passing(bucket, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows, kept = [], 0
        for pdf in batches:
            rows.extend(zip(*(pdf[c].tolist() for c in ("micros", "tie", "key", "row"))))
            if len(rows) > max(2 * kept, 1 << 16):
                rows = _earliest_per_second(rows)
                kept = len(rows)
        last = json.loads(state.get[0]) if state.exists else {}
        passed = []
        for micros, _, key, row in sorted(rows):
            before, second = last.get(key), micros // 1_000_000
            if before is None or second >= before + ttl_seconds:
                last[key] = second
                passed.append(row)
        now = state.getCurrentWatermarkMs()
        last = {key: second for key, second in last.items() if (second + ttl_seconds) * 1000 > now}
        if last:
            state.update((json.dumps(last),))
            state.setTimeoutTimestamp((max(last.values()) + ttl_seconds) * 1000)
        elif state.exists:
            state.remove()
        if passed:
            yield pd.DataFrame({"row": passed})

    return (rows.groupBy("bucket").applyInPandasWithState(passing, out, "last string", "append", GroupStateTimeout.EventTimeTimeout)
            .select(F.from_json("row", requests.schema, exact).alias("row")).select("row.*"))
